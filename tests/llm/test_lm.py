import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm

TEXTS = ["the cat sat on the mat", "The dog SAT", "", None, "a", "zzz the theta\tthe\nmat", "ein langes wort donaudampfschifffahrt", "the the the the", "bébé bé"] * 3


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, score int")


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def held_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def test_base_and_counts_against_plain(spark):
    rows = {r["doc_id"]: r for r in lm.score_texts(frame(spark), held_column()).collect()}
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(TEXTS)
    for i, ws in words.items():
        assert rows[i]["held_out"] == held(i) and rows[i]["n_tokens"] == len(ws) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(c[w] > 0 for w in ws)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert rows[i]["score"] < 0


def plain_tree(streams, state_cost, symbol_cost):
    """The same tree from its definition: counts of symbols by context, states by divergence, probabilities by recursion."""
    seen = {}
    for s in streams:
        for i in range(1, len(s)):
            for k in range(min(i, lm.DEPTH) + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1
    states = {c for c in seen if len(c) <= 1}
    for c, own in seen.items():
        if len(c) > 1:
            total, above = sum(own.values()), seen[c[1:]]
            gain = sum(n * math.log(n / total / (above[x] / sum(above.values()))) for x, n in own.items())
            if gain >= state_cost + symbol_cost * len(own):
                states |= {c[k:] for k in range(len(c) + 1)}

    def p(context, x):
        if context in states:
            own = seen[context]
            total, distinct = sum(own.values()), len(own)
            return (own[x] + distinct * (p(context[1:], x) if context else 1 / lm.SYMBOLS)) / (total + distinct)
        return p(context[1:], x) if context else 1 / lm.SYMBOLS

    return p


def plain_stream(text):
    w = (text or "").encode().lower().split()
    return b" " + b"".join(x + b" " for x in w) + b"\n"


@pytest.mark.parametrize("most", [lm.BROADCAST_ROWS, 0])
def test_tree_against_its_definition(spark, most, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 7)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(12))) for _ in range(60)] + TEXTS
    p = plain_tree([plain_stream(t) for i, t in enumerate(texts) if not held(i)], lm.STATE_COST, lm.SYMBOL_COST)
    rows = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark, texts).repartition(3), held_column(), most, block=200).collect()}
    for i, t in enumerate(texts):
        s = plain_stream(t)
        assert rows[i] == pytest.approx(sum(math.log10(p(s[max(0, k - lm.DEPTH) : k], s[k])) for k in range(1, len(s))))
    for context in (b"", b" ", b"a", b"e the", b"zq"):
        assert sum(p(context, x) for x in range(256)) == pytest.approx(1)


def test_score_depends_on_the_order_of_words(spark):
    texts = ["aa bb"] * 40 + ["aa bb", "bb aa", "aa aa"]
    rows = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark, texts), F.col("doc_id") >= 40).collect()}
    assert rows[40] > rows[41] + 1 and rows[40] > rows[42] + 1


def test_small_blocks_give_the_same(spark):
    a = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark), held_column()).collect()}
    b = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark).repartition(5), held_column(), block=20).collect()}
    assert a == pytest.approx(b)


def test_codec():
    ids, counts = np.array([0, 3, 70000, 70001, 300000], np.uint32), np.array([1, 255, 254, 99999, 2], np.uint32)
    got = lm._decoded(lm._encoded(ids, counts))
    assert (got[0] == ids).all() and (got[1] == counts).all()


def test_nothing_to_learn_from(spark):
    assert lm.score_texts(frame(spark, []), held_column()).count() == 0
    rows = lm.score_texts(frame(spark, ["a b"]), F.lit(True)).collect()
    assert rows[0]["train_tokens"] == 0 and rows[0]["n_known"] == 0 and math.isfinite(rows[0]["score"])
