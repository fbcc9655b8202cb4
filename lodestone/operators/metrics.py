"""Statistics and scores of candidates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocking import BLOCKER_BITS
from lodestone.operators.decide import entity_score


def candidate_stats(s1: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs, and mean, median and most candidates per S1 record, those without any included."""
    counts = s1.select(F.col("entity_id").alias("s1_id")).join(pairs.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
        F.avg("n").alias("mean_per_s1"),
        F.median("n").alias("median_per_s1"),
        F.max("n").alias("max_per_s1"),
        F.count_if(F.col("n") == 0).alias("s1_without"),
        F.count("*").alias("n_s1"),
    )
    both = own.crossJoin(targets.agg(F.count("*").alias("n_targets")))
    return both.withColumn("reduction_ratio", 1 - F.col("n_pairs") / F.greatest(F.col("n_s1") * F.col("n_targets"), F.lit(1)))


def candidate_recall(pairs: DataFrame, truth: DataFrame, n_links: DataFrame | None = None) -> DataFrame:
    """(blocker, n_found, n_only, recall): true pairs found by any blocker, by each, and by each alone.

    truth: distinct (s1_id, tgt_id). n_links: a row n with what recall is of; links to unknown targets count too.
    """
    found = pairs.join(truth, ["s1_id", "tgt_id"], "left_semi")
    mask = F.col("blockers").cast("int")
    bits = {"all": None} | BLOCKER_BITS
    own = found.agg(*(x for b, bit in bits.items() for x in (
        (F.count("*") if bit is None else F.count_if(mask.bitwiseAND(bit) > 0)).alias(f"{b}_found"),
        (F.lit(0).cast("long") if bit is None else F.count_if(mask == bit)).alias(f"{b}_only"),
    )))
    total = n_links if n_links is not None else truth.agg(F.count("*").alias("n"))
    parts = F.explode(F.array(*(F.struct(F.lit(b).alias("blocker"), F.col(f"{b}_found").alias("n_found"), F.col(f"{b}_only").alias("n_only")) for b in bits)))
    return own.crossJoin(total).select(parts.alias("p"), "n").select("p.*", F.when(F.col("n") > 0, F.col("p.n_found") / F.col("n")).otherwise(0.0).alias("recall"))


def per_s1_counts(kept: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, n_tp) of every S1 record of truth_counts; other records' predictions don't count."""
    own = kept.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("n_tp"))
    out = truth_counts.join(own, "s1_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_pred", "n_tp")})


def macro_from_counts(counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, n_s1, macro_f05, macro_precision, macro_recall); zeros without S1 records. Of a record without links a
    prediction has precision 0 and recall 1; one with neither has 1 and 1."""
    t, p, tp = (F.col(c) for c in ("n_true", "n_pred", "n_tp"))
    both = (t == 0) & (p == 0)
    precision = F.when(both, 1.0).otherwise(tp / F.greatest(p, F.lit(1)))
    recall = F.when(t == 0, 1.0).otherwise(tp / F.greatest(t, F.lit(1)))
    mean = lambda x, name: F.coalesce(F.avg(x), F.lit(0.0)).alias(name)
    return counts.groupBy(*(groups or [])).agg(F.count("*").alias("n_s1"), mean(entity_score(t, p, tp), "macro_f05"), mean(precision, "macro_precision"), mean(recall, "macro_recall"))


def entity_f05(true_ids: Column, pred_ids: Column) -> Column:
    """The score of one S1 record from its two arrays of ids, as sets."""
    a, b = F.array_distinct(true_ids), F.array_distinct(pred_ids)
    return entity_score(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def macro_f05(truth_lists: DataFrame, pred_lists: DataFrame) -> DataFrame:
    """One row: the mean score over the S1 records of truth_lists (entity_id, ids); pred_lists has the same columns. A
    record without prediction has none; predictions for other records are ignored; 0 without records."""
    return macro_f05_joined(truth_lists.select("entity_id", F.col("ids").alias("t")).join(pred_lists.select("entity_id", F.col("ids").alias("p")), "entity_id", "left"))


def macro_f05_joined(both: DataFrame) -> DataFrame:
    """macro_f05() of lists that are joined: t, true ids, and p, predicted ones."""
    empty = F.array().cast("array<string>")
    return both.agg(F.coalesce(F.avg(entity_f05(F.coalesce("t", empty), F.coalesce("p", empty))), F.lit(0.0)).alias("macro_f05"))


def evaluate_decision(kept: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """One row of macro scores of kept pairs (s1_id, label)."""
    return macro_from_counts(per_s1_counts(kept, truth_counts))


def evaluate_rows(kept: DataFrame, candidates: DataFrame, truth_counts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Scores, the all-empty score, recall of the candidates, candidates per S1 record and the share of records without
    links; one row, or one for each value of the second column of groups (s1_id, <name>)."""
    counts = per_s1_counts(kept, truth_counts)
    own = candidates.groupBy("s1_id").agg(F.count("*").alias("n_cands"), F.sum("label").alias("n_found"))
    counts = counts.join(own, "s1_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cands", "n_found")})
    by = []
    if groups is not None:
        counts, by = counts.join(groups, "s1_id"), [groups.columns[1]]
    t, p, tp = (F.col(c) for c in ("n_true", "n_pred", "n_tp"))
    mean = lambda x, name: F.coalesce(F.avg(x), F.lit(0.0)).alias(name)
    both = (t == 0) & (p == 0)
    return counts.groupBy(*by).agg(
        F.count("*").alias("n_s1"),
        mean(entity_score(t, p, tp), "macro_f05"),
        mean(F.when(both, 1.0).otherwise(tp / F.greatest(p, F.lit(1))), "macro_precision"),
        mean(F.when(t == 0, 1.0).otherwise(tp / F.greatest(t, F.lit(1))), "macro_recall"),
        mean((t == 0).cast("double"), "all_empty_f05"),
        F.when(F.sum(t) > 0, F.sum("n_found") / F.sum(t)).otherwise(0.0).alias("candidate_recall"),
        mean(F.col("n_cands"), "candidates_per_s1"),
    )


def country_counts(s1: DataFrame, n: int = 6) -> DataFrame:
    """The n commonest countries: a report of its top, as the feature is defined."""
    return s1.groupBy("country_norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_norm").limit(n)


def match_rate(s1: DataFrame, kept: DataFrame) -> DataFrame:
    """(country_norm, n_s1, match_rate): the share of S1 records with a match."""
    has = kept.select("s1_id").distinct().withColumn("m", F.lit(1.0))
    own = s1.select(F.col("entity_id").alias("s1_id"), "country_norm").join(has, "s1_id", "left")
    return own.groupBy("country_norm").agg(F.count("*").alias("n_s1"), F.avg(F.coalesce("m", F.lit(0.0))).alias("match_rate"))


def error_dump(scored: DataFrame, kept: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """False positives, links scored but not kept (FN_scored) and links that were no candidates, with texts.

    A link to a target that doesn't exist is no candidate and has null texts.
    """
    fp = kept.where("label = 0").select(F.lit("FP").alias("error"), "s1_id", "tgt_id", "score")
    fn = scored.where("label = 1").join(kept.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti").select(F.lit("FN_scored").alias("error"), "s1_id", "tgt_id", "score")
    missing = truth.select("s1_id", "tgt_id").join(scored.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti").select(F.lit("FN_not_candidate").alias("error"), "s1_id", "tgt_id", F.lit(None).cast("double").alias("score"))
    rows = fp.unionByName(fn).unionByName(missing)
    texts = {"name": "business_name", "address": "business_address", "country": "country"}
    for side, df, key in (("s1", s1, "s1_id"), ("cand", targets, "tgt_id")):
        rows = rows.join(df.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{side}_{n}") for n, c in texts.items())), key, "left")
    return rows.select("error", "s1_id", F.col("tgt_id").alias("cand_id"), "score", *(f"{side}_{n}" for n in texts for side in ("s1", "cand")))


