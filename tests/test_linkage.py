import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocking, decide, features, links, metrics, model, profile, tfidf, validate
from lodestone.operators.normalize import normalize_records
from lodestone.plans import pipeline
from lodestone.plans.config import Config, set_paths
from lodestone.sources import fixture, records, tsv
from lodestone.sources.archive import archive
from lodestone.sources.cache import load_source
from lodestone.streaming.incremental import candidates_of_batches, normalized_stream

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def frames(spark, split="train"):
    rows = fixture.rows(split)
    s = [normalize_records(spark.createDataFrame(rows[f"source{n}"], SCHEMA)) for n in (1, 2, 3)]
    truth = spark.createDataFrame(rows["ground_truth"], "source1_entity_id string, matched_entity_ids string")
    return s, truth


@pytest.fixture(scope="module")
def split(spark):
    s, truth = frames(spark)
    return pipeline.split_of(*s, truth)


def test_country_blocks_equal_the_plain_condition(spark, split):
    left, right = blocking.country_blocks(split.s1, split.targets)
    got = {(r["s1_id"], r["tgt_id"]) for r in left.join(right, ["source", "block"]).collect()}
    assert left.join(right, ["source", "block"]).count() == len(got)
    a = [(r["entity_id"], r["country_norm"]) for r in split.s1.collect()]
    b = [(r["entity_id"], r["source"], r["country_norm"]) for r in split.targets.collect()]
    want = {(i, j) for i, c in a for j, s, d in b if c == d or not c or not d or c not in {y for _, z, y in b if z == s}}
    assert got == want
    assert left.groupBy("s1_id", "source").count().where("count <> 2").isEmpty()
    assert any(c and not any(c == d for _, _, d in b) for _, c in a)  # a country that no target has
    off = blocking.country_blocks(split.s1, split.targets, False)
    assert off[0].join(off[1], ["source", "block"]).count() == len(a) * len(b)


def test_candidates(spark, split):
    pairs = blocking.generate_candidates(split.s1, split.targets, k=3).cache()
    assert pairs.columns == ["s1_id", "tgt_id", "source", "blockers", "score_name", "score_combined", "rank_name", "rank_combined", "is_s2"]
    assert pairs.groupBy("s1_id", "tgt_id").count().where("count > 1").isEmpty()
    assert pairs.agg(F.max("rank_name")).first()[0] <= 4
    recall = metrics.candidate_recall(pairs, split.truth).where("blocker = 'all'").first()
    assert recall["recall"] > 0.9
    stats = metrics.candidate_stats(split.s1, split.targets, pairs).first()
    assert stats["n_s1"] == 17 and stats["n_pairs"] == pairs.count() and stats["s1_without"] >= 0
    none = blocking.generate_candidates(split.s1, split.targets.limit(0))
    assert none.count() == 0 and none.columns == pairs.columns
    with pytest.raises(ValueError):
        tfidf.blocker_text("other")


def test_embedding_blocker(spark, split):
    vec = lambda df: df.select("entity_id", F.array(F.length("name_norm").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    pairs = blocking.generate_candidates(split.s1, split.targets, 2, embeddings=(vec(split.s1), vec(split.targets)))
    assert {"score_embedding", "rank_embedding"} <= set(pairs.columns)
    assert pairs.where(F.col("blockers").bitwiseAND(4) > 0).groupBy("s1_id", "source").count().where("count > 2").isEmpty()
    both = lambda df: vec(df).select("entity_id", F.col("vector").alias("name"), F.col("vector").alias("full"))
    _, names = features.build_features(pairs.withColumn("pruner_prob", F.col("score_name")), split.s1, split.targets, embeddings=(both(split.s1), both(split.targets)))
    assert len(names) == 74


def test_dense_top_k_in_blocks(spark):
    rng = random.Random(8)
    rows = lambda p, n: spark.createDataFrame([(f"{p}{i}", "S2", rng.choice("xy"), [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(n)], f"{'s1' if p == 'q' else 'tgt'}_id string, source string, block string, vector array<double>")
    q, t = rows("q", 12), rows("t", 40).repartition(5)
    want = {}
    for a in q.collect():
        scores = sorted((-sum(x * y for x, y in zip(a["vector"], b["vector"])), b["tgt_id"]) for b in t.collect() if b["block"] == a["block"])
        want |= {(a["s1_id"], i): (-s, r + 1) for r, (s, i) in enumerate(scores[:4])}
    for blocks in ((100, 100), (3, 7)):
        assert {(r["s1_id"], r["tgt_id"]): (r["score"], r["rank"]) for r in blocking.dense_top_k(q, t, 4, *blocks).collect()} == want
    odd = spark.createDataFrame([("n", "S2", "x", None), ("o", "S2", "x", [None, 1.0, 1.0]), ("p", "S2", "x", [float("nan"), 1.0, 1.0]), ("r", "S3", "x", [1.0, 1.0, 1.0])], t.schema)
    assert blocking.dense_top_k(q, odd, 4).isEmpty() and blocking.dense_top_k(q.limit(0), t, 4).isEmpty()
    assert {(r["s1_id"], r["tgt_id"]): (r["score"], r["rank"]) for r in blocking.dense_top_k(q, t.union(odd), 4, 3, 7).collect()} == want


def test_dense_top_k_of_equal_targets(spark):
    """More ties than a strip holds: the least ids win."""
    t = spark.range(3000).selectExpr("id AS tgt_id", "'S2' AS source", "'*' AS block", "array(1f, if(id = 2999, 1f, 0f)) AS vector").repartition(3)
    q = spark.createDataFrame([("a", "S2", "*", [1.0, 0.0]), ("b", "S2", "*", [0.0, 1.0])], "s1_id string, source string, block string, vector array<float>")
    found = {(r["s1_id"], r["rank"]): r["tgt_id"] for r in blocking.dense_top_k(q, t, 3).collect()}
    assert found == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 2999, ("b", 2): 0, ("b", 3): 1}


def test_link_counts_are_those_of_the_pairs(spark):
    rows = lambda p, texts: spark.createDataFrame([(f"{p}{i}", x, y) for i, (x, y) in enumerate(texts)], "entity_id string, business_name string, business_address string")
    s1, tg = rows("S1-", [("A", "x"), ("a", "X"), ("b", None), ("c", "")]), rows("S2-", [("a", "x"), ("A", "x"), ("B", None), ("d", "")])
    pairs = {r["s1_id"]: r["count"] for r in records.links(s1, tg).groupBy("s1_id").count().collect()}
    assert {r["s1_id"]: r["n_true"] for r in records.link_counts(s1, tg).collect()} == {"S1-0": 2, "S1-1": 2, "S1-2": 1, "S1-3": 0} == {f"S1-{i}": 0 for i in range(4)} | pairs


def test_links(spark, split):
    own = {(r["s1_id"], r["cand_id"]): r["known"] for r in split.links.collect()}
    assert own["S1-5", "S3-404"] is False and own["S1-0", "S2-0"] is True
    assert split.truth_counts.where("s1_id = 'S1-5'").first()["n_true"] == 2
    assert split.truth.where("tgt_id = 'S3-404'").isEmpty()
    a, b = links.holdout_split(split.s1, 0.3)
    assert a.union(b).distinct().count() == 17
    assert links.sample_records(split.s1, 5).count() == 5
    lists = links.id_lists(split.s1, split.truth)
    assert lists.count() == 17 and lists.where("ids = ''").count() == 2


def test_features(spark, split):
    pairs = blocking.generate_candidates(split.s1, split.targets, 3).withColumn("pruner_prob", F.col("score_name"))
    rows, names = features.build_features(pairs, split.s1, split.targets)
    assert len(names) == 70 and len(set(names)) == 70
    assert rows.count() == pairs.count() and not [c for c, t in rows.dtypes if c in names and t == "string"]
    own = rows.select(*names).toPandas()
    assert not own.isna().any().any() and (own.mutual_best_name.sum() > 0)
    few, some = features.build_features(pairs, split.s1, split.targets, ["numbers"])
    assert some == ["addr_num_jaccard", "addr_num_overlap", "addr_num_both_present", "addr_num_conflict"]
    pruned, pnames = features.pruner_features(pairs.drop("pruner_prob"), split.s1, split.targets)
    assert len(pnames) == 11


def brute(pairs, truth, threshold, conflicts=True, cap=None):
    own = [p for p in pairs if p[2] >= threshold]
    if conflicts:
        best = {}
        for p in sorted(own, key=lambda p: (-p[2], p[0])):
            best.setdefault(p[1], p)
        own = list(best.values())
    if cap:
        own = [p for s in truth for p in sorted((q for q in own if q[0] == s), key=lambda q: (-q[2], q[1]))[:cap]]
    total = 0
    for s, n in truth.items():
        mine = [p for p in own if p[0] == s]
        tp = sum(p[3] for p in mine)
        if not n and not mine:
            total += 1
        elif n and mine and tp:
            p, r = tp / len(mine), tp / n
            total += 1.25 * p * r / (0.25 * p + r)
    return total / len(truth)


@pytest.mark.parametrize("seed", range(4))
def test_threshold_sweep_against_brute_force(spark, seed):
    rng = random.Random(seed)
    truth = {f"a{i}": rng.randrange(3) for i in range(12)}
    pairs = [(s, t, round(rng.random(), 2), int(rng.random() < 0.4)) for s, t in {(f"a{rng.randrange(14)}", f"b{rng.randrange(20)}") for _ in range(60)}]
    df = spark.createDataFrame(pairs, "s1_id string, tgt_id string, score double, label int").withColumn("source", F.lit("S2"))
    counts = spark.createDataFrame(list(truth.items()), "s1_id string, n_true long")
    conflicts, cap = seed % 2 == 0, None if seed < 2 else 2
    got = {r["threshold"]: r["macro_f05"] for r in decide.threshold_sweep(df, counts, resolve_conflicts=conflicts, max_per_s1=cap).collect()}
    want = {t: brute(pairs, truth, t, conflicts, cap) for t in decide.GRID}
    assert got == pytest.approx(want)
    best, value = decide.tune_threshold(df, counts, resolve_conflicts=conflicts, max_per_s1=cap)
    assert value == pytest.approx(max(want.values())) and best == min(t for t, v in want.items() if v > value - 1e-9)
    kept = decide.decide(df, best, resolve_conflicts=conflicts, max_per_s1=cap)
    assert metrics.evaluate_decision(kept, counts).first()["macro_f05"] == pytest.approx(value)
    per, per_value = decide.tune_threshold(df, counts, per_source=True, grid=[0.3, 0.6], resolve_conflicts=conflicts, max_per_s1=cap)
    assert per_value >= max(want[0.3], want[0.6]) - 1e-9


def test_decide_ties_and_sources(spark):
    df = spark.createDataFrame([("b", "t", "S2", 0.5, 0), ("a", "t", "S2", 0.5, 1), ("a", "u", "S3", 0.6, 0)], "s1_id string, tgt_id string, source string, score double, label int")
    assert {(r["s1_id"], r["tgt_id"]) for r in decide.decide(df, 0.5).collect()} == {("a", "t"), ("a", "u")}
    assert decide.decide(df, {"S2": 0.5, "S3": 0.7}, resolve_conflicts=False).count() == 2
    assert decide.decide(df, 0.5, max_per_s1=1).count() == 1
    assert decide.format_threshold({"S2": 0.5, "S3": 0.7}) == "S2 0.50, S3 0.70"


def test_set_score_equals_count_score(spark):
    rows = [("x", ["a"], ["a", "b"]), ("y", [], []), ("z", ["a"], []), ("w", [], ["c"]), ("v", ["a", "b"], ["b"])]
    t = spark.createDataFrame([(i, a) for i, a, _ in rows], "entity_id string, ids array<string>")
    p = spark.createDataFrame([(i, b) for i, _, b in rows] + [("unknown", ["q"])], "entity_id string, ids array<string>")
    value = metrics.macro_f05(t, p).first()[0]
    counts = spark.createDataFrame([(i, len(a), len(b), len(set(a) & set(b))) for i, a, b in rows], "s1_id string, n_true long, n_pred long, n_tp long")
    row = metrics.macro_from_counts(counts).first()
    assert value == pytest.approx(row["macro_f05"])
    assert row["macro_recall"] == pytest.approx((1 + 1 + 0 + 1 + 0.5) / 5)
    assert metrics.macro_from_counts(counts.limit(0)).first()["macro_f05"] == 0


def test_validation(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    tg = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    lists = lambda *rows: spark.createDataFrame(rows, "entity_id string, ids string")
    good = lists(("S1-1", "S2-1"), ("S1-2", ""))
    assert validate.passes(validate.validate_outputs(good, good, s1, tg))
    bad = lists(("S1-1", "S2-1,S2-1,S9-1,S3-7"), ("S1-1", ""), ("S1-9", ""))
    found = {r["check"] for r in validate.validate_outputs(bad, good, s1, tg).collect()}
    assert found == {"duplicate_s1", "duplicate_id", "missing_s1", "extra_s1", "bad_prefix", "unknown_id", "not_candidate"}
    assert validate.passes(validate.validate_outputs(good, good.limit(1), s1, tg))


def test_error_dump_of_unknown_target(spark, split):
    scored = spark.createDataFrame([("S1-0", "S2-0", "S2", 0.2, 1), ("S1-0", "S2-1", "S2", 0.9, 0)], "s1_id string, tgt_id string, source string, score double, label int")
    wanted = spark.createDataFrame([("S1-5", "S3-404"), ("S1-0", "S2-0")], "s1_id string, tgt_id string")
    rows = {r["error"]: r for r in metrics.error_dump(scored, decide.decide(scored, 0.5), wanted, split.s1, split.targets).collect()}
    assert set(rows) == {"FP", "FN_scored", "FN_not_candidate"}
    assert rows["FN_not_candidate"]["cand_name"] is None and rows["FP"]["cand_name"]


def test_profiles(spark):
    s, truth = frames(spark)
    assert profile.source_profile(s[1]).where("country = 'US'").first()["empty_addresses"] == 1
    assert profile.prefix_counts(s[0]).first()["prefix"] == "S1"
    p = profile.truth_profile(truth).first()
    assert p["n_s1"] == 17 and p["singletons"] == 2
    assert profile.match_distribution(truth).agg(F.sum("n_s1")).first()[0] == 17
    assert profile.postal_examples(s[0]).where("country = 'India'").first()["examples"]


def test_files_and_modes(spark, tmp_path):
    paths = set_paths(str(tmp_path / "data"), str(tmp_path / "out"), str(tmp_path / "model"))
    fixture.write_fixture(spark, paths)
    with pytest.raises(FileExistsError):
        fixture.write_fixture(spark, paths)
    (tmp_path / "out").mkdir()
    df = tsv.read_source_tsv(spark, paths.source("train", 1))
    assert df.where("entity_id = 'S1-9'").first()["business_name"] == 'The "Quoted" Co'
    with pytest.raises(FileNotFoundError):
        tsv.read_tsv(spark, str(tmp_path / "none.tsv"))
    with pytest.raises(ValueError):
        tsv.read_source_tsv(spark, paths.truth)
    assert load_source(spark, paths.source("train", 2), f"{paths.model}/cache").count() == load_source(spark, paths.source("train", 2), f"{paths.model}/cache").count()
    tsv.write_empty_submission(df, paths.matching, paths.candidates)
    lines = open(paths.matching, encoding="utf-8").read().split("\n")
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[1] == "S1-0\t" and len(lines) == 19
    config = Config().but(pruner={"maxIter": 2, "maxDepth": 2, "seed": 1}, matcher={"maxIter": 2, "maxDepth": 2, "seed": 1}, prune_min_prob=0.0, groups=["tokens", "tfidf", "structure", "rank"], match_folds=2)
    train, test = (pipeline.load_split(spark, paths, s, config, use_cache=False) for s in ("train", "test"))
    info = pipeline.run_test(train, test, config, paths)
    assert info["candidates"]["n_s1"] == 17 and len(open(paths.candidates, encoding="utf-8").readlines()) == 18
    assert model.load_model(f"{paths.model}/matcher").getNumTrees >= 1
    assert pipeline.save_run_info(spark, paths.output, "test", info, config)["mode"] == "test"
    assert archive(paths, "a", str(tmp_path / "sub")) == 0 and archive(paths, "a", str(tmp_path / "sub")) == 1
    assert '"top_k": 10' in open(f"{paths.output}/run_info_test.json", encoding="utf-8").read()
    with pytest.raises(ValueError):
        validate.read_lists(tsv.read_tsv(spark, paths.candidates), "matched_entity_ids")
    assert validate.read_lists(tsv.read_tsv(spark, paths.matching), "matched_entity_ids").columns == ["entity_id", "ids"]
    ids = train.s1.select("entity_id").union(train.targets.select("entity_id"))
    ids.withColumn("vector", F.array(F.lit(0.6), F.lit(0.8))).write.parquet(str(tmp_path / "vectors"))
    strict = pipeline.run_validate(train, config.but(strict_split=True, embeddings=str(tmp_path / "vectors")))
    assert strict["holdout"]["n_s1"] > 0
    got = pipeline.run_validate(train, config, str(tmp_path / "errors.tsv"))
    assert got["holdout"]["n_s1"] > 0 and open(tmp_path / "errors.tsv", encoding="utf-8").readline().startswith("error\ts1_id\tcand_id")
    assert pipeline.run_loco(train, config.but(loco_min_s1=5))["countries"]


def test_stream(spark, tmp_path):
    s, _ = frames(spark)
    s[1].select("entity_id", "business_name", "business_address", "country").write.parquet(str(tmp_path / "in"))
    stream = normalized_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).withColumn("source", F.lit("S2"))
    candidates_of_batches(stream, s[0], lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "c"), 3).awaitTermination()
    want = blocking.generate_candidates(s[0], s[1].withColumn("source", F.lit("S2")), 3)
    assert spark.read.parquet(str(tmp_path / "out/0")).count() == want.count()


def test_scores_do_not_depend_on_batches(spark, tmp_path):
    s, _ = frames(spark)
    targets = s[1].withColumn("source", F.lit("S2"))
    raw = s[1].select("entity_id", "business_name", "business_address", "country").orderBy("entity_id").collect()
    for i in range(2):
        spark.createDataFrame(raw[i::2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = normalized_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).withColumn("source", F.lit("S2"))
    candidates_of_batches(stream, s[0], lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "c"), 50, reference=targets).awaitTermination()
    scores = lambda df: {(r["s1_id"], r["tgt_id"]): (r["score_name"], r["score_combined"]) for r in df.collect()}
    want = scores(blocking.generate_candidates(s[0], targets, 50, by_country=False))
    got = scores(spark.read.parquet(str(tmp_path / "out/0"), str(tmp_path / "out/1")))
    assert got and all(want[k] == v for k, v in got.items())


def test_per_source_sweeps_find_what_single_decisions_find(spark):
    rng = random.Random(8)
    rows = [(f"S1-{rng.randrange(12)}", f"{src}-{i % 25}", src, round(rng.random(), 3)) for i in range(120) for src in ("S2", "S3")]
    rows = [(*r, int(rng.random() < r[3] - (0.2 if r[2] == "S3" else 0))) for r in {x[:2]: x for x in rows}.values()]
    df = spark.createDataFrame(rows, "s1_id string, tgt_id string, source string, score double, label int")
    counts = spark.createDataFrame([(f"S1-{i}", sum(r[4] for r in rows if r[0] == f"S1-{i}")) for i in range(14)], "s1_id string, n_true long")
    grid = [0.3, 0.45, 0.6, 0.75]
    fast = decide.tune_threshold(df, counts, per_source=True, grid=grid)
    slow = decide.tune_threshold(df, counts, per_source=True, grid=grid, max_per_s1=10**6)
    assert fast[0] == slow[0] and fast[1] == pytest.approx(slow[1])


def test_labels_by_keys_are_those_of_all_links(spark):
    """Without a row for each link: copies of one text on both sides make as many rows as there are pairs."""
    text = lambda i: ("Acme", "same") if i < 40 else (f"N{i % 7}", "other" if i % 2 else "x")
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", *text(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string")
    s1, tg = df.where("source = 'S1'"), df.where("source <> 'S1'")
    pairs = s1.select(F.col("entity_id").alias("s1_id")).crossJoin(tg.select(F.col("entity_id").alias("tgt_id"), "source")).where("hash(s1_id, tgt_id) % 3 = 0")
    truth = records.links(s1, tg)
    want = links.labelled(pairs, truth)
    keyed = [x.withColumn("text_key", records._text_key()).drop("business_name", "business_address") for x in (s1, tg)]
    for a, b in ((s1, tg), keyed):
        got = records.labelled(pairs, a, b)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.where("label = 1").count() > 10
        lists = {r["s1_id"]: sorted(r["ids"]) for r in records.true_lists(a.select("entity_id", *(c for c in a.columns if c in ("business_name", "business_address", "text_key"))), b).collect()}
        assert sum(map(len, lists.values())) == truth.count() and len(lists) == s1.count()
        assert sorted((k, x) for k, v in lists.items() for x in v) == sorted(map(tuple, truth.collect()))


def test_queries_make_no_row_for_each_link(monkeypatch):
    """Only what returns the links themselves makes them."""
    from lodestone.plans import queries

    class Reached(Exception):
        pass

    def made(*_):
        raise AssertionError("links are made")

    def labelled(*_):
        raise Reached

    monkeypatch.setattr(queries.R, "links", made)
    monkeypatch.setattr(queries.R, "labelled", labelled)
    monkeypatch.setattr(queries.R, "records", lambda *_: (None, None))
    monkeypatch.setattr(queries, "_pairs", lambda *_: None)
    for name in ("entity_f05_lists", "macro_f05_lists", "matching_lists", "decide_one_to_one", "macro_f05", "match_rate", "per_s1_details", "candidate_recall", "decide_per_source_capped", "macro_f05_by_country"):
        with pytest.raises(Reached):
            queries.QUERIES[name](None, "")


def test_features_are_made_in_rounds(spark, monkeypatch):
    """With few bytes a round, too: no shuffle has the texts of all pairs, and features and their order are the same."""
    (a, b, c), _ = frames(spark)
    targets = b.withColumn("source", F.lit("S2")).unionByName(c.withColumn("source", F.lit("S3")))
    pairs = blocking.generate_candidates(a, targets, 3)
    groups, sizes, plain = ["tokens", "tfidf", "numbers", "structure", "blockers", "rank"], [], features.compared
    whole, names = features.build_features(pairs, a, targets, groups)
    assert whole.columns == [*pairs.columns, *(n for n in names if n not in pairs.columns)]

    def compared(pairs, s1, targets, columns, make):
        def counted(both):
            sizes.append(both.count())
            return make(both)

        return plain(pairs, s1, targets, columns, counted, size=2000)

    monkeypatch.setattr(features, "compared", compared)
    some, own = features.build_features(pairs, a, targets, groups)
    assert own == names and some.columns == whole.columns and sorted(some.collect(), key=str) == sorted(whole.collect(), key=str)
    assert len(sizes) > 1 and sum(sizes) == pairs.count() and max(sizes) < sum(sizes)
