"""Profiles of a source and of the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.text import parse_id_list


def source_profile(df: DataFrame) -> DataFrame:
    """(country, n, empty_names, empty_addresses) of each country, '' included."""
    return df.groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("business_name") == "").alias("empty_names"), F.count_if(F.col("business_address") == "").alias("empty_addresses"))


def length_profile(df: DataFrame) -> DataFrame:
    """(field, mean_length, median_length, max_length) of names and addresses."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.length(c).alias("n")) for c in ("business_name", "business_address"))))
    return df.select(parts.alias("p")).groupBy("p.field").agg(F.avg("p.n").alias("mean_length"), F.median("p.n").alias("median_length"), F.max("p.n").alias("max_length"))


def prefix_counts(df: DataFrame) -> DataFrame:
    """(prefix, n) of the ids' first two characters, by which a source is named."""
    return df.groupBy(F.substring("entity_id", 1, 2).alias("prefix")).agg(F.count("*").alias("n"))


def postal_examples(df: DataFrame, n: int = 5) -> DataFrame:
    """(country, examples): up to n postal codes of each country, a report of examples, smallest first."""
    codes = df.select("country", F.explode(F.filter(F.split(T.postal_codes(T.normalize_text(F.col("business_address"))), " "), lambda x: x != "")).alias("code")).where("country <> ''").distinct()
    return codes.groupBy("country").agg(F.slice(F.array_sort(F.collect_set("code")), 1, n).alias("examples"))


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    return df.orderBy("entity_id").limit(n)


def match_distribution(truth: DataFrame) -> DataFrame:
    """(n_matches, n_s1, s2_links, s3_links): S1 records by their number of links, and where those lead."""
    ids = parse_id_list(F.col("matched_entity_ids"))
    own = truth.select(F.size(ids).alias("n_matches"), F.size(F.filter(ids, lambda x: x.startswith("S2-"))).alias("a"), F.size(F.filter(ids, lambda x: x.startswith("S3-"))).alias("b"))
    return own.groupBy("n_matches").agg(F.count("*").alias("n_s1"), F.sum("a").alias("s2_links"), F.sum("b").alias("s3_links"))


def truth_profile(truth: DataFrame) -> DataFrame:
    """One row: S1 records, those without, with one and with more links, links to either source, all-empty score."""
    d = match_distribution(truth)
    n = F.col("n_s1")
    own = d.agg(
        F.sum(n).alias("n_s1"),
        F.sum(F.when(F.col("n_matches") == 0, n).otherwise(0)).alias("singletons"),
        F.sum(F.when(F.col("n_matches") == 1, n).otherwise(0)).alias("one_match"),
        F.sum(F.when(F.col("n_matches") > 1, n).otherwise(0)).alias("more_matches"),
        F.sum(F.col("n_matches") * n).alias("links"),
        F.sum("s2_links").alias("s2_links"),
        F.sum("s3_links").alias("s3_links"),
    )
    return own.withColumn("all_empty_f05", F.col("singletons") / F.col("n_s1"))
