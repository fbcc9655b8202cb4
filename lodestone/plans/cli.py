"""Command line: run (validate, loco, test), profile, empty, check, archive, fixture."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import profile, validate
from lodestone.plans import pipeline
from lodestone.plans.config import Config, set_paths
from lodestone.sources import tsv
from lodestone.sources.archive import archive
from lodestone.sources.fixture import write_fixture


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--data-dir", default="dataset")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--model-dir", default="model")
    sub = p.add_subparsers(dest="verb", required=True)
    run = sub.add_parser("run")
    run.add_argument("--mode", choices=["validate", "loco", "test"], default="validate")
    run.add_argument("--sample-s1", type=int)
    run.add_argument("--no-cache", action="store_true")
    run.add_argument("--embeddings", help="Parquet of (entity_id, vector) for a third blocker")
    run.add_argument("--strict-split", action="store_true", help="validate: held-out labels reach no pruner")
    run.add_argument("--trees", type=int, help="trees of pruner and matcher at most")
    for verb in ("profile", "empty", "check"):
        own = sub.add_parser(verb)
        own.add_argument("--split", default="test" if verb != "profile" else "train")
    sub.add_parser("archive").add_argument("tag")
    sub.add_parser("fixture")
    return p


def _sources(spark: SparkSession, paths, split: str):
    return [tsv.read_source_tsv(spark, paths.source(split, n)) for n in (1, 2, 3)]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    paths = set_paths(a.data_dir, a.output_dir, a.model_dir)
    if a.verb == "archive":
        return archive(paths, a.tag)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.verb == "fixture":
        write_fixture(spark, paths)
        return 0
    if a.verb == "profile":
        for df in _sources(spark, paths, a.split):
            for report in (profile.source_profile, profile.length_profile, profile.prefix_counts, profile.postal_examples, profile.sample_rows):
                report(df).show(50, False)
        profile.truth_profile(tsv.read_ground_truth(spark, paths.truth)).show()
        profile.match_distribution(tsv.read_ground_truth(spark, paths.truth)).orderBy("n_matches").show()
        return 0
    os.makedirs(paths.output, exist_ok=True)
    if a.verb == "empty":
        tsv.write_empty_submission(_sources(spark, paths, a.split)[0], paths.matching, paths.candidates)
        return 0
    if a.verb == "check":
        s1, s2, s3 = _sources(spark, paths, a.split)
        files = (paths.matching, "matched_entity_ids"), (paths.candidates, "candidate_entity_ids")
        try:
            lists = [validate.read_lists(tsv.read_tsv(spark, p), c) for p, c in files]
        except ValueError as e:
            print(f"FAIL: {e}")
            return 1
        problems = validate.validate_outputs(*lists, s1, s2.unionByName(s3)).cache()
        problems.groupBy("check", "table").agg(F.count("*").alias("n")).show(50, False)
        ok = validate.passes(problems)
        print("PASS" if ok else "FAIL")
        return int(not ok)
    config = Config(embeddings=a.embeddings, strict_split=a.strict_split)
    if a.trees:
        config = config.but(pruner=config.pruner | {"maxIter": a.trees}, matcher=config.matcher | {"maxIter": a.trees})
    train = pipeline.load_split(spark, paths, "train", config, a.sample_s1 if a.mode != "test" else None, not a.no_cache)
    if a.mode == "validate":
        info = pipeline.run_validate(train, config, f"{paths.output}/holdout_errors.tsv")
    elif a.mode == "loco":
        info = pipeline.run_loco(train, config)
    else:
        info = pipeline.run_test(train, pipeline.load_split(spark, paths, "test", config, None, not a.no_cache), config, paths)
    print(pipeline.save_run_info(spark, paths.output, a.mode, info, config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
