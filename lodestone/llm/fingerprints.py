"""Context-triggered piecewise fingerprints, and their likeness by edit distance.

A rolling hash of the last seven bytes ends a chunk wherever it has a given remainder modulo the block size; each chunk
gives one of 64 characters. A fingerprint has the characters at its block size and at twice that, so that fingerprints
whose block sizes are equal or differ by a factor of two can be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import lean, mix, schema_of

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
WINDOW, SMALLEST, LONGEST = 7, 3, 64
#: Bytes hashed at a time.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, n of them at least."""
    x = _powers.get(base, np.ones(1, np.uint64))
    while len(x) < n:
        x = np.concatenate((x, x * np.uint64(pow(base, len(x), 1 << 64))))
        _powers[base] = x
    return x


def rolling(text: np.ndarray) -> np.ndarray:
    """At each byte, the rolling hash of it and the six before it."""
    n = len(text)
    x = np.concatenate((np.zeros(WINDOW - 1, np.uint32), text.astype(np.uint32)))
    total, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(WINDOW):
        part = x[WINDOW - 1 - j : WINDOW - 1 - j + n]
        total += part
        weighted += part * np.uint32(WINDOW - j)
        shifted ^= part << np.uint32(5 * j)
    return total + weighted + shifted


def _prefixes(text: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any chunk follows, whatever its place."""
    n = len(text)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, n)[:n], dtype=np.uint64)))


def _ends(text: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of chunk ends at `block` and the rolling hashes there."""
    at, values = [], []
    for a in range(0, len(text), SEGMENT):
        own = rolling(text[max(a - WINDOW + 1, 0) : a + SEGMENT])[min(a, WINDOW - 1) :]
        p = np.flatnonzero(own % np.uint32(block) == block - 1)
        at.append(p + a)
        values.append(own[p])
    return (np.concatenate(at), np.concatenate(values)) if at else (np.empty(0, np.int64), np.empty(0, np.uint32))


def _signature(text: np.ndarray, ends: np.ndarray, most: int, sums: np.ndarray | None) -> str:
    cuts = ends[: most - 1] + 1
    if not len(cuts) or cuts[-1] < len(text):
        cuts = np.append(cuts, len(text))  # the last chunk has all that is left
    starts = np.concatenate(([0], cuts[:-1]))
    if sums is not None:
        h = (sums[cuts] - sums[starts]) * _power(_BASE, len(text) + 1)[cuts]
    else:  # a very long text: chunk by chunk, part by part
        h = np.empty(len(cuts), np.uint64)
        for k, (a, b) in enumerate(zip(starts.tolist(), cuts.tolist())):
            value = 0
            for s in range(a, b, SEGMENT):
                part = text[s : min(b, s + SEGMENT)]
                own = int(_prefixes(part)[-1]) * int(_power(_BASE, len(part) + 1)[len(part)])
                value = (value * pow(_BASE, len(part), 1 << 64) + own) % (1 << 64)
            h[k] = value
    return _LETTERS[(mix(h) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """`block:signature:signature at twice the block`."""
    text = np.frombuffer(data, np.uint8)
    if not len(text):
        return f"{SMALLEST}::"
    block = SMALLEST
    while block * LONGEST < len(text):
        block *= 2
    ends, values = _ends(text, block)
    while block > SMALLEST and len(ends) < LONGEST // 2 - 1:
        block //= 2
        ends, values = _ends(text, block)
    sums = _prefixes(text) if len(text) <= 4 * SEGMENT else None
    twice = ends[values % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(text, ends, LONGEST, sums)}:{_signature(text, twice, LONGEST // 2, sums)}"


def _shortened(s: str) -> str:
    """Runs of one character cut to three."""
    return "".join(c for i, c in enumerate(s) if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3])


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b, with the bits of one number for the columns of the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _alike(a: str, b: str) -> float:
    a, b = _shortened(a), _shortened(b)
    short = min(len(a), len(b))
    run = min(WINDOW, max(3, short // 2))
    if short < run:
        return 0.0
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where block sizes are not compatible or no run of characters is shared."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if n == 2 * m else _alike(a2, b1) if m == 2 * n else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text, where it is read. Null texts count as empty; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint((x.as_py() or "").encode()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return lean(docs).select("doc_id", "text").mapInArrow(run, schema_of(docs, "fingerprint string"))


_LOWEST = -(1 << 63)
#: Bytes of text in a part, about.
PART = 128 << 20


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, lead, doc_id, text) so dealt and sorted that each document is followed by the next one by doc_id, an integer.

    Documents are dealt by ranges of doc_id, to `parts` parts, or else to as many as the session shuffles to, and more
    where these would have over PART bytes of text. The first of a part is also dealt, marked as lead, to the part before
    it, where it comes last; the first of all to the last part. Only the bounds of the parts are gathered.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    ids = docs.select(key.alias("k"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    accuracy = max(10 * parts, min(100 * parts, 100_000))  # parts differ by a tenth at most
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], accuracy)).first()[0] if parts > 1 else []
    splits = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits.value, k.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r["p"], r["k"]) for r in ids.groupBy(part_of("k").alias("p")).agg(F.min("k").alias("k")).collect())  # a row for each part
    leads = spark.sparkContext.broadcast({k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)})

    @F.pandas_udf("array<int>")
    def dealt(k: pd.Series) -> pd.Series:
        own = np.searchsorted(splits.value, k.to_numpy(), "right").tolist()
        return pd.Series([[2 * p, 2 * leads.value[x] + 1] if x in leads.value else [2 * p] for p, x in zip(own, k.tolist())])

    rows = docs.select("doc_id", "text", F.explode(dealt(key)).alias("code"))
    rows = rows.select(F.shiftright("code", 1).alias("part"), (F.col("code") % 2).alias("lead"), "doc_id", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "lead", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many, or all, of another text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is by ascending doc_id, a null doc_id first, rows of one doc_id by text; after the last comes the
    first, so that a single document is its own next. A null text counts as empty. An empty table gives no rows; other
    columns of docs are not read. doc_id is an integer; another type raises TypeError. Texts are moved once, in ranges of
    doc_id whose number grows with their bytes.
    """
    docs = lean(docs).select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from ((p, lead, d, t.as_py() or "") for p, lead, d, t in zip(batch.column("part").to_pylist(), batch.column("lead").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")))

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        out: list[tuple] = []
        for part, lead, doc_id, text in rows(batches):
            if lead and (last is None or last[0] != part):
                continue  # of several leads only the first counts
            own = fingerprint(text.encode())
            if last is not None and last[0] == part:
                _, prior, before, at = last
                changed = edited(before, text).encode()
                other = fingerprint(changed)
                out.append((prior, len(before), hashlib.sha256(changed).hexdigest(), at, other, likeness(at, other), likeness(at, own)))
            last = None if lead else (part, doc_id, text, own)
            if len(out) >= 4096:
                yield batch_of(out, kind)
                out = []
        yield batch_of(out, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return with_next(docs, parts).mapInArrow(run, schema_of(docs, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
