"""Checks of the two output tables against the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import parse_id_list


def _problem(df: DataFrame, check: str, table: str, first: str, second: str | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.col(first).cast("string").alias("entity_id"), (F.col(second) if second else F.lit("")).alias("other_id"))


def exploded(lists: DataFrame) -> DataFrame:
    """(entity_id, id) of (entity_id, ids)."""
    return lists.select("entity_id", F.explode(parse_id_list(F.col("ids"))).alias("id"))


def read_lists(table: DataFrame, column: str) -> DataFrame:
    """(entity_id, ids) of a submitted table; ValueError where its header is not source1_entity_id and `column`, in order."""
    if table.columns != ["source1_entity_id", column]:
        raise ValueError(f"the header is {table.columns} and must be source1_entity_id, {column}")
    return table.toDF("entity_id", "ids")


def list_problems(lists: DataFrame, table: str) -> DataFrame:
    """Repeated S1 ids, and repeated ids within a list."""
    rows = lists.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = exploded(lists).groupBy("entity_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    return _problem(rows, "duplicate_s1", table, "entity_id").union(_problem(ids, "duplicate_id", table, "entity_id", "id"))


def id_problems(lists: DataFrame, targets: DataFrame, table: str) -> DataFrame:
    """Ids that are no S2 or S3 id, and such that no source has."""
    own = exploded(lists)
    good = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    known = targets.select(F.col("entity_id").alias("id")).distinct()
    return _problem(own.where(~good), "bad_prefix", table, "entity_id", "id").union(_problem(own.where(good).join(known, "id", "left_anti"), "unknown_id", table, "entity_id", "id"))


def validate_outputs(matching: DataFrame, candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(check, table, entity_id, other_id): a row for each problem of the two tables (entity_id, ids); none means they pass.

    Repeats, S1 records that are missing from or unknown to the matching table, ids that are wrong, and matches that are
    no candidates. S1 records missing from the candidates are warnings, `warn_missing_s1`.
    """
    ids = s1.select("entity_id").distinct()
    found, pairs = exploded(matching), exploded(candidates)
    parts = [
        list_problems(matching, "matching"),
        list_problems(candidates, "candidates"),
        _problem(ids.join(matching, "entity_id", "left_anti"), "missing_s1", "matching", "entity_id"),
        _problem(matching.join(ids, "entity_id", "left_anti"), "extra_s1", "matching", "entity_id"),
        id_problems(matching, targets, "matching"),
        _problem(found.join(pairs, ["entity_id", "id"], "left_anti"), "not_candidate", "matching", "entity_id", "id"),
        id_problems(candidates, targets, "candidates"),
        _problem(ids.join(candidates, "entity_id", "left_anti"), "warn_missing_s1", "candidates", "entity_id"),
    ]
    return reduce(DataFrame.union, parts)


def passes(problems: DataFrame) -> bool:
    return problems.where(~F.col("check").startswith("warn_")).isEmpty()
