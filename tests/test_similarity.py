import random
import time

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import similarity as S

words = st.text(alphabet="ab c", max_size=14)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@given(words, words)
def test_ratio(a, b):
    assert S.ratio(a, b) == pytest.approx(2 * subsequence(a, b) / (len(a) + len(b)) if a + b else 1)


@given(words, words)
def test_partial_ratio_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    if short:
        parts = [long[max(s, 0) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert S.partial_ratio(a, b) == pytest.approx(max(S.ratio(short, p) for p in parts))
    else:
        assert S.partial_ratio(a, b) == float(not long)


@pytest.mark.parametrize("a, b, want", [("b a", "a b", 1.0), ("a b", "a b c", 1.0), ("", "a", 0.0), ("a x", "a y", 2 * 2 / 6)])
def test_token_set(a, b, want):
    assert S.token_set_ratio(a, b) == pytest.approx(want)


def test_token_sort():
    assert S.token_sort_ratio("x y z", "z y x") == 1.0


def test_jaro_winkler_as_elsewhere():
    rng = random.Random(1)
    pairs = [("martha", "marhta"), ("", "a"), ("a", "a")] + [tuple("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 80))) for _ in range(2)) for _ in range(200)]
    db = duckdb.connect()
    for a, b in pairs:
        assert S.jaro_winkler(a, b) == pytest.approx(db.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-9)


def test_udf_guard(spark):
    df = spark.createDataFrame([("", ""), ("ab", "ab"), (None, "x")], "a string, b string")
    get = lambda guard: [r[0]["ratio"] for r in df.select(S.string_similarity(F.col("a"), F.col("b"), ["ratio", "jaro_winkler"], guard)).collect()]
    assert get(True) == [0.0, 1.0, 0.0]
    assert get(False) == [1.0, 1.0, 0.0]


def test_overlaps(spark):
    df = spark.createDataFrame([("a b b", "b c"), ("", ""), ("1 2", "3")], "a string, b string")
    rows = df.select(*S.token_overlap(F.col("a"), F.col("b"), "t"), *S.number_overlap(F.col("a"), F.col("b"))).collect()
    assert [round(x, 6) for x in rows[0]] == [round(1 / 3, 6), 1, 0.5, 0.5, round(1 / 3, 6), 1, 1, 0]
    assert list(rows[1]) == [0] * 8
    assert rows[2]["addr_num_conflict"] == 1


def test_partial_ratio_of_long_strings_tries_every_window():
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcde ") for _ in range(rng.randrange(65, 100))) for _ in range(2)) for _ in range(30)]
    text = "".join(rng.choice("abcdefgh") for _ in range(80))
    pairs += [(text, "xyz" * 9 + text[:40] + "-" + text[41:] + "zyx" * 9), (text, text[30:] + "w" * 60)]
    for a, b in map(tuple, pairs):
        short, long = sorted((a, b), key=len)
        parts = [long[max(s, 0) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert S.partial_ratio(a, b) == max(S.ratio(short, p) for p in parts)


def test_common_of_long_texts():
    """Equal to the table of a loop, over several times the characters between two cuts; characters that one text lacks cost little."""
    rng = random.Random(6)

    for n, m in ((300, 200), (63, 65), (64, 128), (0, 130), (130, 0), (5, 400)):
        for alphabet in ("a", "ab", "abcdé "):
            a, b = ("".join(rng.choice(alphabet + extra) for _ in range(k)) for k, extra in ((n, ""), (m, "xyz")))
            assert S._common(len(a), S._masks(a), b) == subsequence(a, b)

    masks = S._masks("ab" * 4000)

    def least(b):
        took = []
        for _ in range(5):
            began = time.process_time()
            S._common(8000, masks, b)
            took.append(time.process_time() - began)
        return min(took)

    assert 3 * least("xy" * 2000) < least("ab" * 2000)
