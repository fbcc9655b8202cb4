import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import packing, sharding

TEXTS = ["hello world", "", None, "a" * 50, "word " * 900, "<|endoftext|> is text", "Ünï çødé 12,345", "hello world"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, length int, shard int")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1), st.just(60))
def test_plan_places_every_piece_once(counts, capacity):
    used, seen = defaultdict(list), defaultdict(int)
    for length, first, n, sequence, offset in packing.plan(counts, capacity):
        assert first == seen[length] and n > 0
        seen[length] += n
        for k in range(n):
            used[sequence + k].append((offset, length))
    assert dict(seen) == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    total = sum(k * v for k, v in counts.items())
    assert len(used) <= 1.7 * total / capacity + 2 and sorted(used) == list(range(len(used)))


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(frame(spark).repartition(3), capacity=64).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == 64 for r in own[1:]) and all(r["length"] == len(r["ids"]) for r in own)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
    assert packing.pack(frame(spark, []), with_ids=False).count() == 0


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    ids, text = packing.byte_bpe(), " ".join(random.Random(1).choice(["word", "x,", "12", "  ", "\n", "été"]) for _ in range(400))
    whole = ids(text).tolist()
    monkeypatch.setattr(packing, "PART", 100)
    assert packing.byte_bpe()(text).tolist() == whole


def test_shards(spark):
    n = 4000
    df = spark.createDataFrame([(i, None if i % 9 == 0 else "é" * (i % 5), 3) for i in range(n)], "doc_id long, text string, slot int").repartition(5)
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == 1 + (0 if r["doc_id"] % 9 == 0 else 2 * (r["doc_id"] % 5))
        assert r["text_crc32"] == zlib.crc32(b"" if r["doc_id"] % 9 == 0 else ("é" * (r["doc_id"] % 5)).encode())
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots))) and abs(len(slots) - n / 8) < 5 * (n / 8) ** 0.5
    assert abs(sum(r["grown_shard"] == 8 for r in rows) - n / 9) < 5 * (n / 9) ** 0.5
    assert sharding.shard_documents(df.limit(0)).count() == 0


def plain_place(key, tree):
    def drawn(children):
        def ring(name, weight):
            u = (xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(name.encode(), 42)) >> 11) + 0.5
            return -math.log(u * 2**-53) / weight if weight else math.inf

        return min(children, key=lambda x: ring(*x))[0]

    region = drawn([(a, sum(sum(x.values()) for x in b.values())) for a, b in tree.items()])
    rack = drawn([(f"{region}/{a}", sum(b.values())) for a, b in tree[region].items()]).split("/")[1]
    return int(drawn([(f"shard {n}", w) for n, w in tree[region][rack].items()]).split()[1])


def uneven(w):
    return {"east": {"a": {0: 1.0, 1: w}, "b": {2: 1.0}}, "west": {"a": {3: 2.0}, "b": {4: 0.0, 5: 1.0}}}


def test_places_against_the_plain_descent(spark):
    for tree in (uneven(1.0), uneven(3.0), sharding.even_tree(7), sharding.with_shard(sharding.even_tree(8), 8, 0.5)):
        rows = sharding.place(spark.range(700).withColumnRenamed("id", "k"), "k", tree).collect()
        assert [r["shard"] for r in rows] == [plain_place(str(r["k"]), tree) for r in rows]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in range(1, 12):
        tree = sharding.even_tree(n)
        df = sharding.place(sharding.place(spark.range(300).withColumnRenamed("id", "k"), "k", tree, "a"), "k", sharding.with_shard(tree, n), "b")
        assert df.where("a <> b").where(F.col("b") != n).isEmpty() and not df.where(F.col("b") == n).isEmpty()


def test_weights_move_rows_only_at_subtrees_that_changed(spark):
    df = sharding.place(sharding.place(spark.range(6000).withColumnRenamed("id", "k"), "k", uneven(1.0), "a"), "k", uneven(3.0), "b")
    counts = {r["a"]: r["n"] for r in df.groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert 4 not in counts and counts[3] == pytest.approx(2000, rel=0.1) and counts[0] == pytest.approx(1000, rel=0.15)
    moves = {(r["a"], r["b"]) for r in df.where("a <> b").select("a", "b").distinct().collect()}
    assert moves and not any(a in (3, 5) and b in (3, 5) for a, b in moves)  # inside the region that kept its weights
    assert not any(a in (0, 1, 2) and b in (3, 5) for a, b in moves)  # none leaves the subtree that gained
    assert not any(a in (0, 1) and b == 2 for a, b in moves)


def test_equal_rows_and_null_keys_get_slots(spark):
    df = spark.createDataFrame([(1, "x")] * 300 + [(None, "y")] * 3, "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    assert sorted(r["slot"] for r in rows if r["doc_id"] == 1)[-1] >= 299 and len(rows) == 303
