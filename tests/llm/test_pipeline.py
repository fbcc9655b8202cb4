import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.7 * len(before), name
        docs, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == before


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_empty_tables_and_clashing_names(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    words = " ".join(f"word{i}" for i in range(60))
    odd = [(900_001, None), (900_002, ""), (900_003, words), (900_003, words), (None, "one of a kind " + words[:80]), (900_005, " \n")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars int")
    docs = own.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")).union(more)
    for clash in ("node", "bucket", "_text", "spans", "score", "length", "_block"):
        docs = docs.withColumn(clash, F.lit(7))
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r["doc_id"] == 900_003 and r["piece"] == 0 for r in rows) == 2 and {900_001, 900_002, 900_005} <= {r["doc_id"] for r in rows}
        return
    assert got.columns == docs.columns and all(r["node"] == 7 and r["score"] == 7 for r in rows)
    if name != "quality_classifier":
        by = [r["doc_id"] for r in rows]
        assert {900_001, 900_002, 900_003, 900_005, None} <= set(by)
        assert by.count(900_003) == (1 if name == "minhash_dedup" else 2)
        assert [r["text"] for r in rows if r["doc_id"] == 900_001] == [None]
    if name == "suffix_dedup":
        assert all(r["text"] == "" and r["n_chars"] == 0 for r in rows if r["doc_id"] == 900_003)
