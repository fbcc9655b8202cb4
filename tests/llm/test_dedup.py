import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, minhash, suffixes


def frame(spark, texts):
    rows = [(i, t, "n", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _key string, node int")  # clashing names


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def plain_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if common_ and 100 * common_ >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([12, 60, 140]))] for _ in range(4)]
    texts = [t for b in base for t in family(rng, b, 45, 8)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one  two", "one two three", "two one"] + [" ".join(base[0])] * 30
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), k, percent).collect()}
    assert got == plain_components(texts, k, percent)


def test_second_round_finds_what_leads_miss(spark):
    """A chain a-b-c whose ends aren't alike, in one bucket led by an end that is like none."""
    members = spark.createDataFrame([(1, i, 100) for i in range(4)], "bucket long, node long, n long")
    s = [list(range(0, 100)), list(range(50, 150)), list(range(54, 154)), list(range(60, 160))]
    sets = spark.createDataFrame([(i, [x * 2**44 for x in v]) for i, v in enumerate(s)], "node long, set array<long>")
    got = {r["node"]: r["root"] for r in minhash._links(members, sets, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 900):
        a = common.mix(rng.integers(0, 2**62, n, dtype=np.uint64))
        assert (minhash.sketch(a, 64) == minhash.sketch(a[::-1].copy(), 64)).all()
        assert minhash.sketch(a, 64).max() < 2**64 - 1
    a = common.mix(np.arange(1000, dtype=np.uint64))
    for shift in (100, 300):
        agree = np.mean(minhash.sketch(a, 2048) == minhash.sketch(common.mix(np.arange(shift, 1000 + shift, dtype=np.uint64)), 2048))
        assert agree == pytest.approx((1000 - shift) / (1000 + shift), abs=0.05)
    b, r = minhash.banding(0.85)
    assert (1 - 0.85**r) ** b <= 1e-6


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = minhash.near_duplicates(df, 3, 85).collect()
    assert len(rows) == 5 and all(r["kept"] for r in rows if r["doc_id"] is None)
    left = minhash.one_of_each(df, 3, 85).collect()
    assert sorted(str(r["text"]) for r in left) == ["None", "a b c d e f", "other words are here now"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_both_ways(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)], "a long, b long")
    one, other = ({r["node"]: r["root"] for r in common.components(edges, few).collect()} for few in (10**6, 0))
    assert one == other and one[130] == 100


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 9])) for _ in range(rng.randrange(40))]
        order = suffixes.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        want = [max([0, *(next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), len(s)) for j in range(len(s)) if j != i)]) for i in range(len(s))]
        assert suffixes.longest_matches(s, order) == want


def plain_repeats(texts, length):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for x in data:
        seen.update(x[i : i + length] for i in range(len(x) - length + 1))
    out = {}
    for i, x in enumerate(data):
        hit = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if seen[x[s : s + length]] > 1:
                hit[s : s + length] = b"\x01" * length
        runs = sum(1 for j in range(len(x)) if hit[j] and not (j and hit[j - 1]))
        rest = bytes(b for b, h in zip(x, hit) if not h)
        out[i] = (len(x), sum(hit), runs, hashlib.sha256(rest).hexdigest())
    return out


def repeat_texts(rng):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    passage = [" ".join(word() for _ in range(n)) for n in (12, 30, 60, 120)]
    texts = [" ".join([word() for _ in range(rng.randrange(30))] + [rng.choice(passage)] * rng.randrange(2) + [word() for _ in range(rng.randrange(30))]) for _ in range(60)]
    return texts + ["", None, "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "from " * 80, "x from " * 70, passage[3], passage[3], "short"]


@pytest.mark.parametrize("length, hot", [(200, suffixes.HOT), (64, suffixes.HOT), (64, 1)])
def test_repeats_against_every_window(spark, length, hot, monkeypatch):
    texts = repeat_texts(random.Random(length))
    monkeypatch.setattr(suffixes, "SEGMENT", 150)
    if hot == 1:  # every anchor takes the way of hot ones
        spans = suffixes.repeated_spans(frame(spark, texts), length, hot)
        got = defaultdict(list)
        for r in spans.collect():
            got[r["_id"]] = suffixes._merged([tuple(s) for s in r["spans"]])
        want = plain_repeats(texts, length)
        assert {i: sum(b - a for a, b in v) for i, v in got.items()} == {i: v[1] for i, v in want.items() if v[1]}
        return
    rows = suffixes.remove_repeats(frame(spark, texts), length).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == plain_repeats(texts, length)


def test_rows_without_repeats(spark):
    long = "é" * 30 + "".join(random.Random(1).choice("abcdefgh ") for _ in range(300))
    df = frame(spark, ["x" + long, "yé" + long[1:], "alone", None, ""]).withColumn("n_chars", F.length("text").cast("long"))
    rows = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    assert len(rows) == 5 and rows[0]["text"] == "x" and rows[1]["text"] == "y" and rows[2]["text"] == "alone" and rows[3]["text"] is None
    assert rows[0]["n_chars"] == 1 and rows[0]["_key"] == "n"
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_spans(df, 20)


def test_equal_rows_are_copies(spark):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(250))
    df = spark.createDataFrame([(7, text), (7, text), (None, text[:100])], "doc_id long, text string")
    rows = suffixes.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(100, 0), (250, 250), (250, 250)]


def test_a_line_repeated_on_and_on_is_a_row_for_each_context(spark):
    """Rows grow with a document's distinct contexts, not with how often it has them."""
    line = "".join(random.Random(5).choices("abcdefghij ", k=70)) + "\n"
    texts = [f"{i} start{i * 7919}\n" + line * (5 + i % 40) + f"end{i * 104729}" for i in range(30)] + [line * 50, line * 3, "short", None]
    docs = suffixes._keyed(frame(spark, texts))
    schema = common.schema_of(docs, "_text long, at long, more array<long>, before int, behind int, gram long, own long")
    found = docs.mapInArrow(suffixes._anchored(100), schema).cache()
    places = sum(len(suffixes.anchors(np.frombuffer((t or "").encode(), np.uint8), 100)[0]) for t in texts)
    assert found.agg(F.sum(F.coalesce(F.array_size("more") + 1, F.lit(1)))).first()[0] == places > 2 * found.count()
    assert found.groupBy("doc_id", "gram", "own").count().where("count > 1").isEmpty()
    want = plain_repeats(texts, 100)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(frame(spark, texts), 100).collect()} == want
