"""Pruning, thresholds, conflicts between S1 records, and the choice of the threshold."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocking import group_rank

Threshold = float | dict[str, float]


def prune(pairs: DataFrame, prob: str = "pruner_prob", top_n: int = 10, min_prob: float = 0.01) -> DataFrame:
    """The top_n pairs of each S1 record, over both sources, of at least min_prob."""
    ranked = pairs.withColumn("_rank", group_rank(["s1_id"], F.col(prob), ["tgt_id"]))
    return ranked.where((F.col("_rank") <= top_n) & (F.col(prob) >= min_prob)).drop("_rank")


def threshold_of(threshold: Threshold) -> Column:
    """The threshold of a pair, by its source if there are several."""
    if not isinstance(threshold, dict):
        return F.lit(float(threshold))
    first, *rest = threshold.items()
    out = F.when(F.col("source") == first[0], float(first[1]))
    for source, value in rest:
        out = out.when(F.col("source") == source, float(value))
    return out


def resolved(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Of each target's pairs the best; the first S1 record on a tie."""
    return pairs.withColumn("_rank", group_rank(["tgt_id"], F.col(score), ["s1_id"])).where("_rank = 1").drop("_rank")


def decide(pairs: DataFrame, threshold: Threshold, score: str = "score", resolve_conflicts: bool = True, max_per_s1: int | None = None) -> DataFrame:
    """The pairs at or over the threshold, one S1 record per target, and max_per_s1 targets per S1 record at most."""
    out = pairs.where(F.col(score) >= threshold_of(threshold))
    if resolve_conflicts:
        out = resolved(out, score)
    if max_per_s1 is not None:
        out = out.withColumn("_rank", group_rank(["s1_id"], F.col(score), ["tgt_id"])).where(F.col("_rank") <= max_per_s1).drop("_rank")
    return out


#: Thresholds that are tried.
GRID = [round(0.30 + 0.01 * i, 2) for i in range(70)]


def f05(p: Column, r: Column) -> Column:
    """F-score that weighs precision twice as much as recall."""
    return F.when(p + r == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_score(n_true: Column, n_pred: Column, n_tp: Column) -> Column:
    """An S1 record's score: 1 if nothing is true and nothing predicted, 0 if only one of them is empty."""
    p, r = n_tp / F.greatest(n_pred, F.lit(1)), n_tp / F.greatest(n_true, F.lit(1))
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0), 0.0).otherwise(f05(p, r))


def threshold_sweep(pairs: DataFrame, truth_counts: DataFrame, score: str = "score", grid: list[float] | None = None, resolve_conflicts: bool = True, max_per_s1: int | None = None) -> DataFrame:
    """(threshold, macro_f05) of every threshold, in one pass.

    pairs: s1_id, tgt_id, label and score; truth_counts: (s1_id, n_true) of every S1 record that counts. A target's winner
    doesn't depend on a threshold, so conflicts are resolved once; each pair counts at all thresholds up to its score, so
    sums over the grid are cumulative sums of a histogram with a row per S1 record and grid step, not a row per pair and
    threshold. What is gathered has a row for each threshold.
    """
    grid = sorted(GRID if grid is None else grid)
    own = resolved(pairs, score) if resolve_conflicts else pairs
    own = own.where(F.col(score) >= grid[0])
    if max_per_s1 is not None:
        own = own.withColumn("_rank", group_rank(["s1_id"], F.col(score), ["tgt_id"])).where(F.col("_rank") <= max_per_s1)
    steps = F.array(*(F.lit(g) for g in grid))
    own = own.join(truth_counts, "s1_id", "left_semi").withColumn("_step", F.size(F.filter(steps, lambda g: g <= F.col(score))))
    hist = own.groupBy("s1_id", "_step").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))
    per = hist.groupBy("s1_id").agg(F.collect_list(F.struct("_step", "n", "tp")).alias("h")).join(truth_counts, "s1_id")
    at = F.transform(F.sequence(F.lit(1), F.lit(len(grid))), lambda k: F.struct(
        k.alias("k"),
        F.aggregate(F.filter("h", lambda x: x["_step"] >= k), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_pred"),
        F.aggregate(F.filter("h", lambda x: x["_step"] >= k), F.lit(0).cast("long"), lambda s, x: s + x["tp"]).alias("n_tp"),
    ))
    scores = per.select("n_true", F.explode(at).alias("e")).select("e.k", entity_score(F.col("n_true"), F.col("e.n_pred"), F.col("e.n_tp")).alias("f"))
    # S1 records without a pair score 1 if they have no link, else 0, at every threshold
    alone = truth_counts.join(per.select("s1_id").withColumn("_p", F.lit(True)), "s1_id", "left")
    alone = alone.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("_p").isNull() & (F.col("n_true") == 0)).cast("double")), F.lit(0.0)).alias("f"))
    alone = alone.select(F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("k"), "f", "n")
    sums = scores.select("k", "f", F.lit(0).cast("long").alias("n")).union(alone).groupBy("k").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    return sums.select(F.element_at(steps, F.col("k")).alias("threshold"), F.when(F.col("n") > 0, F.col("f") / F.col("n")).otherwise(0.0).alias("macro_f05"))


def tune_threshold(pairs: DataFrame, truth_counts: DataFrame, score: str = "score", per_source: bool = False, grid: list[float] | None = None, max_per_s1: int | None = None, resolve_conflicts: bool = True) -> tuple[Threshold, float]:
    """The threshold of the best macro F0.5, the lowest of several, and that score.

    per_source: from the best single threshold on, each source's is tuned in turn, twice, with the other's held; four sweeps,
    or, with max_per_s1, whose choice among both sources depends on both thresholds, a decision for each trial. Warns where
    the best single threshold is at an edge of the grid.
    """
    rows = threshold_sweep(pairs, truth_counts, score, grid, resolve_conflicts, max_per_s1).collect()  # a row for each threshold
    best = max(rows, key=lambda r: (round(r["macro_f05"], 12), -r["threshold"]))
    found, value = best["threshold"], best["macro_f05"]
    if len(rows) > 2 and found in (min(r["threshold"] for r in rows), max(r["threshold"] for r in rows)):
        warnings.warn(f"the best threshold, {found:.2f}, is at an edge of the grid", stacklevel=2)
    if not per_source:
        return found, value
    from lodestone.operators.metrics import evaluate_decision

    now = {"S2": found, "S3": found}
    if max_per_s1 is None:
        # a target's winner depends on no threshold, so the held source's pairs that pass count at every step of a sweep
        own = resolved(pairs, score) if resolve_conflicts else pairs
        for source, other in [("S2", "S3"), ("S3", "S2")] * 2:
            trial = own.where((F.col("source") == source) | (F.col(score) >= now[other]))
            trial = trial.withColumn(score, F.when(F.col("source") == source, F.col(score)).otherwise(F.lit(float("inf"))))
            rows = threshold_sweep(trial, truth_counts, score, grid, False).collect()
            best = max(rows, key=lambda r: (round(r["macro_f05"], 12), -r["threshold"]))
            if best["macro_f05"] > value + 1e-12:
                now, value = now | {source: best["threshold"]}, best["macro_f05"]
        return now, value
    for _ in range(2):
        for source in now:
            for g in sorted(GRID if grid is None else grid):
                trial = now | {source: g}
                got = evaluate_decision(decide(pairs, trial, score, resolve_conflicts, max_per_s1), truth_counts).first()["macro_f05"]
                if got > value + 1e-12:
                    now, value = trial, got
    return now, value


def format_threshold(threshold: Threshold) -> str:
    if isinstance(threshold, dict):
        return ", ".join(f"{k} {v:.2f}" for k, v in threshold.items())
    return f"{threshold:.2f}"
