"""The dataflow from records to decisions, and its three modes: validate, loco (leave one country out) and test."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import decide, features, links, metrics, model, validate
from lodestone.operators.blocking import generate_candidates
from lodestone.plans.config import Config, Paths
from lodestone.sources import tsv
from lodestone.sources.cache import load_source
from lodestone.sources.shared import kept as settled


@dataclass
class Split:
    s1: DataFrame
    targets: DataFrame
    truth: DataFrame | None = None  # distinct (s1_id, tgt_id)
    truth_counts: DataFrame | None = None  # (s1_id, n_true) of every S1 record
    links: DataFrame | None = None  # (s1_id, cand_id, known)


def split_of(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame | None = None, sample_s1: int | None = None, seed: int = 42) -> Split:
    """Normalized sources, and the ground truth, as one split; with sample_s1, that many S1 records and all targets.
    Records are kept once, as all later stages read them."""
    targets = settled(s2.withColumn("source", F.lit("S2")).unionByName(s3.withColumn("source", F.lit("S3"))))
    s1 = settled(s1 if sample_s1 is None else links.sample_records(s1, sample_s1, seed))
    if truth is None:
        return Split(s1, targets)
    own = links.resolve_links(links.ground_truth_links(truth), s1, targets)
    counts = s1.select(F.col("entity_id").alias("s1_id")).join(links.true_counts(own), "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    return Split(s1, targets, settled(links.true_pairs(own)), settled(counts), own)


def load_split(spark: SparkSession, paths: Paths, split: str, config: Config, sample_s1: int | None = None, use_cache: bool = True) -> Split:
    s1, s2, s3 = (load_source(spark, paths.source(split, n), f"{paths.model}/cache" if use_cache else None) for n in (1, 2, 3))
    truth = tsv.read_ground_truth(spark, paths.truth) if split == "train" else None
    return split_of(s1, s2, s3, truth, sample_s1, config.seed)


def build_candidates(split: Split, config: Config, pruner: Model | None = None) -> tuple[DataFrame, Model | None]:
    """Pruned candidate pairs with pruner_prob (and label), and the pruner. Without a pruner, out-of-fold pruners score
    the pairs and one is fitted on all of them for other splits."""
    vectors = split.s1.sparkSession.read.parquet(config.embeddings) if config.embeddings else None
    pairs = settled(generate_candidates(split.s1, split.targets, config.top_k, config.max_df, config.by_country, (vectors, vectors) if config.embeddings else None))
    rows, names = features.pruner_features(pairs, split.s1, split.targets)
    if pruner is None:
        rows = settled(links.labelled(rows, split.truth))
        scored, _ = model.out_of_fold(rows, names, config.pruner, config.prune_folds, "pruner_prob", config.seed)
        pruner = model.fit(model.training_rows(rows, seed=config.seed), names, config.pruner)
    else:
        scored = model.scored(rows, names, pruner, "pruner_prob")
    keep = [c for c in scored.columns if c not in {n for n, _, _ in features.PRUNER_STRINGS} | {"n_blockers"}]
    return settled(decide.prune(scored.select(*keep), "pruner_prob", config.prune_top_n, config.prune_min_prob)), pruner


def matcher_rows(pairs: DataFrame, split: Split, config: Config) -> tuple[DataFrame, list[str]]:
    rows, names = features.build_features(pairs, split.s1, split.targets, config.groups)
    return settled(rows), names


def _tuning(config: Config) -> dict:
    return {"grid": config.grid, "per_source": config.per_source, "max_per_s1": config.max_per_s1, "resolve_conflicts": config.resolve_conflicts}


def _kept(scored: DataFrame, threshold: decide.Threshold, config: Config) -> DataFrame:
    return decide.decide(scored, threshold, "score", config.resolve_conflicts, config.max_per_s1)


def save_run_info(spark: SparkSession, path: str, mode: str, info: dict, config: Config) -> dict:
    """The mode, the time, all settings and the results, written as JSON to the output folder, in whatever store it is."""
    out = {"mode": mode, "time": time.strftime("%Y-%m-%d %H:%M:%S"), "config": asdict(config)} | info
    tsv.write_text(spark, f"{path}/run_info_{mode}.json", json.dumps(out, indent=2, default=str))
    return out


def part_of(split: Split, ids: DataFrame) -> Split:
    """The split with the S1 records of ids (s1_id) only, and all targets."""
    own = lambda df: df.join(ids, "s1_id", "left_semi")
    return Split(split.s1.join(ids.withColumnRenamed("s1_id", "entity_id"), "entity_id", "left_semi"), split.targets, own(split.truth), own(split.truth_counts), own(split.links))


def run_validate(split: Split, config: Config, error_path: str | None = None) -> dict:
    """Fits on a part of the S1 records and scores the others. With strict_split the held-out records' candidates come from
    a pruner fitted on the others' alone; else out-of-fold pruners of all records prune."""
    rest, held = links.holdout_split(split.s1, config.holdout, config.seed)
    if config.strict_split:
        dev_pairs, pruner = build_candidates(part_of(split, rest), config)
        own = part_of(split, held)
        held_pairs = links.labelled(build_candidates(own, config, pruner)[0], own.truth)
        dev, names = matcher_rows(dev_pairs, split, config)
        rows = matcher_rows(held_pairs, split, config)[0]
    else:
        pairs, _ = build_candidates(split, config)
        rows, names = matcher_rows(pairs, split, config)
        dev = rows.join(rest, "s1_id", "left_semi")
    matcher, threshold, oof, _ = model.fit_matcher(dev, names, split.truth_counts.join(rest, "s1_id", "left_semi"), config.matcher, config.match_folds, settled, **_tuning(config))
    scored = settled(model.scored(rows.join(held, "s1_id", "left_semi"), names, matcher))
    kept = _kept(scored, threshold, config)
    counts = split.truth_counts.join(held, "s1_id", "left_semi")
    countries = split.s1.select(F.col("entity_id").alias("s1_id"), "country_norm")
    if error_path:
        wanted = split.links.join(held, "s1_id", "left_semi").select("s1_id", F.col("cand_id").alias("tgt_id")).distinct()
        tsv.write_error_dump(metrics.error_dump(scored, kept, wanted, split.s1, split.targets), error_path)
    return {
        "threshold": threshold,
        "oof_macro_f05": oof,
        "features": len(names),
        "holdout": metrics.evaluate_rows(kept, scored, counts).first().asDict(),
        "by_country": [r.asDict() for r in metrics.evaluate_rows(kept, scored, counts, countries).orderBy("country_norm").collect()],
        "importances": model.importances(matcher, names),
    }


def run_loco(split: Split, config: Config) -> dict:
    """For each country with enough S1 records: fits on all others, and scores it at their threshold and at its own best."""
    pairs, _ = build_candidates(split, config)
    rows, names = matcher_rows(pairs, split, config)
    countries = split.s1.groupBy("country_norm").agg(F.count("*").alias("n")).orderBy("country_norm").collect()
    out = {}
    total = sum(r["n"] for r in countries)
    for country, n in ((r["country_norm"], r["n"]) for r in countries):
        if n < config.loco_min_s1 or n == total:
            continue
        ids = split.s1.where(F.col("country_norm") == country).select(F.col("entity_id").alias("s1_id"))
        dev, held = rows.join(ids, "s1_id", "left_anti"), rows.join(ids, "s1_id", "left_semi")
        counts = split.truth_counts.join(ids, "s1_id", "left_semi")
        matcher, threshold, _, _ = model.fit_matcher(dev, names, split.truth_counts.join(ids, "s1_id", "left_anti"), config.matcher, config.match_folds, settled, **_tuning(config))
        scored = settled(model.scored(held, names, matcher))
        best, best_value = decide.tune_threshold(scored, counts, **_tuning(config))
        out[country] = metrics.evaluate_rows(_kept(scored, threshold, config), scored, counts).first().asDict() | {"threshold": threshold, "best_threshold": best, "best_macro_f05": best_value}
    return {"countries": out}


def run_test(train: Split, test: Split, config: Config, paths: Paths | None = None) -> dict:
    """Fits on the train split, decides on the test split, writes and checks both outputs. Raises where a check fails."""
    pairs, pruner = build_candidates(train, config)
    rows, names = matcher_rows(pairs, train, config)
    matcher, threshold, oof, _ = model.fit_matcher(rows, names, train.truth_counts, config.matcher, config.match_folds, settled, **_tuning(config))
    if paths:
        model.save_model(pruner, f"{paths.model}/pruner")
        model.save_model(matcher, f"{paths.model}/matcher")
    test_pairs, _ = build_candidates(test, config, pruner)
    test_rows, test_names = matcher_rows(test_pairs, test, config)
    if test_names != names:
        raise ValueError("train and test features differ")
    scored = settled(model.scored(test_rows, names, matcher))
    kept = _kept(scored, threshold, config)
    matching, candidates = links.id_lists(test.s1, kept, [-F.col("score")]), links.id_lists(test.s1, scored, [-F.col("pruner_prob")])
    problems = validate.validate_outputs(matching, candidates, test.s1, test.targets)
    if not validate.passes(problems):
        raise ValueError(f"the outputs don't pass: {problems.limit(5).collect()}")
    if paths:
        tsv.write_matching_results(matching, paths.matching)
        tsv.write_candidate_pairs(candidates, paths.candidates)
    return {
        "threshold": threshold,
        "oof_macro_f05": oof,
        "features": len(names),
        "matches": kept.count(),
        "match_rate": [r.asDict() for r in metrics.match_rate(test.s1, kept).orderBy("country_norm").collect()],
        "candidates": metrics.candidate_stats(test.s1, test.targets, scored).first().asDict(),
    }
