"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenized where they are read. The driver sees only how many pieces there are of each length (at most
`capacity` numbers, at any input size) and plans runs: so many pieces of a length, from such a rank on, go to consecutive
sequences at one offset. The runs depend on the lengths, so their number is bounded too, and they are broadcast.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import eased, kept, lean, schema_of

#: Longer texts are tokenized part by part, cut where the tokenizer's pattern always splits.
PART = 1 << 21
#: Pairs of block and length whose first ranks are broadcast, some 64 bytes each; more are joined.
FEW_STARTS = 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """The ids that `tokenizers` gives for the vocabulary public_tokenizers.path(name + ".json") without special tokens
    added. The ids of a text between the names of special tokens come from the same vocabulary as ranks, which is faster;
    a special token's name in a text is that token, as it is there."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    named = re.compile("|".join(f"({re.escape(x)})" for x in sorted(special, key=len, reverse=True)) or "(?!)")

    def plain(text: str) -> Iterator[np.ndarray]:
        while len(text) > PART and (cut := _CUT.search(text, PART)):
            yield own.encode_to_numpy(text[: cut.start()], disallowed_special=())
            text = text[cut.start() :]
        yield own.encode_to_numpy(text, disallowed_special=())

    def ids(text: str) -> np.ndarray:
        parts, at = [], 0
        for m in named.finditer(text):
            parts += [*plain(text[at : m.start()]), np.array([special[m.group()]], np.uint32)]
            at = m.end()
        parts += plain(text[at:])
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    return ids


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, after a shorter first piece where there is a rest."""
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


Run = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece.

    Pieces over a third of the capacity are matched first, each with the largest that still fits; at most two of them
    share a sequence. Smaller ones, longest first, fill the tightest gaps that take them, then new sequences.
    """
    left, used, runs, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((x for x in reversed(large[: bisect.bisect_right(large, capacity - a)]) if left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, sequences, 0)
            if b is not None:
                put(b, n, sequences, a)
            leave(capacity - a - (b or 0), sequences, n)
            sequences += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, first, n = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += n
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            for k in range(each):
                put(s, full, first, capacity - gap + k * s)
            leave(gap - each * s, first, full)
            leave(gap, first + full, n - full)
    return runs


def _tokenized(capacity: int, end_id: int, vocabulary: str, with_ids: bool) -> Callable:
    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, block, seen = byte_bpe(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(ids_of(text.as_py() or ""), end_id).astype("<u4")
                for k, (start, length) in enumerate(pieces(len(ids), capacity)):
                    part = ids[start : start + length]
                    seen[length] = rank = seen.get(length, -1) + 1
                    rows.append((doc_id, k, start, length, zlib.crc32(part.tobytes()), block, rank))
                    if with_ids:
                        held.append(part.astype(np.int32))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_block", "_rank"]
            if with_ids:
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held) if held else np.empty(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str = "byte_bpe_50k", with_ids: bool = True) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its ids and one end id; only those over the capacity are cut. A null text counts as empty and is one
    end id; equal rows are packed one by one; an empty table gives no rows; other columns of docs are not read. Pieces of
    a length are ranked block by block, so that none of them meet in one task.
    """
    spark = lean(docs).sparkSession
    schema = schema_of(docs, "piece int, start long, length long, ids_crc32 long, _block int, _rank long" + ", ids array<int>" * with_ids)
    parts = kept(docs.select("doc_id", "text").mapInArrow(_tokenized(capacity, end_id, vocabulary, with_ids), schema))
    sums = parts.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs: dict[int, list[Run]] = {}
    for run in plan(counts, capacity):
        runs.setdefault(run[0], []).append(run)
    arrays = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if sums.count() <= FEW_STARTS:  # else ids are shuffled with the rows
        starts = F.broadcast(starts)
    ranked = parts.join(starts, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_start"))

    @eased
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own, at = arrays.value[int(n)], np.flatnonzero(lengths == n)
                run = own[np.searchsorted(own[:, 1], ranks[at], "right") - 1]
                sequence[at], offset[at] = run[:, 3] + ranks[at] - run[:, 1], run[:, 4]
            out = batch.select([x for x in batch.schema.names if x[0] != "_"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], [*out.schema.names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    done = T.StructType([*(schema[n] for n in names), *T.StructType.fromDDL("sequence_id long, offset long").fields])
    return ranked.select(*names, "_rank").mapInArrow(placed, done)
