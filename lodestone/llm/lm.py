"""Scoring texts with a probabilistic suffix tree over their symbols.

A text's stream is its words, lower-cased, with one space before, between and after them, and an end symbol. Every symbol
but the first space is predicted from the symbols before it, at most DEPTH of them and over the bounds of words, so that a
text's score depends on the order of its words. A context becomes a state of the tree if its next-symbol distribution
diverges enough from that of the context without its oldest symbol: the log-likelihood gained on the training texts must
pay for the state and its symbols. The tree is closed under suffixes; states are smoothed by mixing in their parent's
distribution, with the number of distinct next symbols as its weight, down to a uniform distribution over all symbols. A
symbol is scored in the longest suffix of its context that is a state; a text's score is the sum over its symbols.

Contexts are counted over all training texts, combined before they are shuffled. For the base score each block of texts
becomes a dictionary of its words and, for each text, how often which word of the dictionary occurs. Words are counted over
all blocks; counts go back to the blocks that asked, and a block's texts are added up beside its dictionary. No dictionary
outgrows its block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import kept, lean, raw, schema_of, space_words
from lodestone.sources.shared import settled

DEPTH = 5
SYMBOLS = 256  # bytes; the line feed, which no word has, is the end
#: Symbols that are packed at a time.
CHUNK = 2 << 20
#: Bytes of text in a block.
BLOCK = 12 << 20
#: Rows of a tree that may be broadcast, 16 bytes each; a larger one is joined with the symbols that blocks ask for.
BROADCAST_ROWS = 4_000_000
#: A state must gain this many nats for itself and for each of its symbols.
STATE_COST, SYMBOL_COST = 3.0, 1.0
END = b"\n"


# Symbols of a context and the symbol after it are packed into a long, the oldest first, under a leading byte 1.


def stream(words: list[bytes]) -> bytes:
    return b" ".join((b"", *words, END)) if words else b" " + END


def packed(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed symbols of all streams with their longest contexts, and the place of the stream of each, in chunks."""
    x = np.frombuffer(b"".join(streams), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    ends = np.cumsum(sizes)
    for a in range(0, len(x), CHUNK):
        b, head = min(a + CHUNK, len(x)), max(a - DEPTH, 0)
        first, last = np.searchsorted(ends, (a, b - 1), "right")
        bounds = np.clip(np.concatenate((ends[first : last + 1] - sizes[first : last + 1], ends[last : last + 1])), a, b) - a
        of = np.repeat(np.arange(first, last + 1), np.diff(bounds))
        y = np.concatenate((np.zeros(DEPTH - (a - head), np.int64), x[head:b].astype(np.int64)))
        out = y[DEPTH:] | np.int64(1) << (8 * (DEPTH + 1))
        for j in range(1, DEPTH + 1):
            out |= y[DEPTH - j : len(y) - j] << (8 * j)
        keep = np.ones(b - a, bool)
        for place in range(DEPTH):  # the first symbols of a stream have shorter contexts
            at = (ends - sizes)[first : last + 1] + place - a
            at = at[(at >= 0) & (at < b - a) & (sizes[first : last + 1] > place)]
            out[at] = out[at] & ((1 << (8 * (place + 1))) - 1) | 1 << (8 * (place + 1))
            if not place:
                keep[at] = False
        yield out[keep], of[keep]


def levels(keys: np.ndarray) -> np.ndarray:
    """Symbols in the context of each packed key."""
    out = np.zeros(len(keys), np.int64)
    for n in range(1, DEPTH + 1):
        out += keys >= 1 << (8 * (n + 1))
    return out


def shortened(keys: np.ndarray, level: int) -> np.ndarray:
    """The keys with the latest `level` symbols of their contexts."""
    return keys & ((1 << (8 * (level + 1))) - 1) | 1 << (8 * (level + 1))


def _blocks(size: int, given):
    """Rows of texts: (block, row, doc_id, held_out, n_tokens, words: ids and counts, score); rows of words: (block, id, word,
    trained). given: a broadcast tree, or None; then there is the text's stream in place of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 24, 0
        ids: dict[bytes, int] = {}
        trained: Counter[int] = Counter()
        names = ["block", "row", "doc_id", "held_out", "n_tokens", "words", "word", "trained", "score", "stream"]
        done = 0  # rows of the block so far

        def texts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            n = len(rows)
            d, h, t, w, own = zip(*rows) if rows else ([], [], [], [], [])
            score = pa.array(summed(list(own), *given.value)) if given else pa.nulls(n, pa.float64())
            streams = pa.nulls(n, pa.binary()) if given else pa.array(own, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), pa.array(d, kind), pa.array(h, pa.bool_()), pa.array(t, pa.int64()), pa.array(w, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), score, streams], names)

        def dictionary(kind: pa.DataType) -> pa.RecordBatch:
            n = len(ids)
            counts = [trained.get(i, 0) for i in range(n)]
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.binary()), pa.array(list(ids), pa.binary()), pa.array(counts, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary())], names)

        kind = pa.int64()
        for batch in batches:
            kind, rows = batch.schema.field("doc_id").type, []
            for doc_id, held_out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), raw(batch.column("text"))):
                words = space_words(text or b"")
                counts = Counter(words)
                counts[END] = 1
                own = np.fromiter((ids.setdefault(w, len(ids)) for w in counts), "<u4", len(counts))
                times = np.fromiter(counts.values(), "<u4", len(counts))
                if not held_out:
                    for i, n in zip(own.tolist(), times.tolist()):
                        trained[i] += n
                # three bytes for most words: the gap to the one before, and the count; long gaps and counts take eight
                order = np.argsort(own)
                rows.append((doc_id, held_out, len(words) + 1, _encoded(own[order], times[order]), stream(words)))
                filled += len(text or b"")
                if filled > size:
                    yield texts(rows, kind)
                    yield dictionary(kind)
                    rows, filled, block, done = [], 0, block + 1, 0
                    ids.clear()
                    trained.clear()
            yield texts(rows, kind)
            done += len(rows)
        yield dictionary(kind)

    return run


def _encoded(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids and their counts: how many, the gaps as two bytes, the counts as one, and the numbers too large for that."""
    gaps = np.diff(ids, prepend=0)
    big, many = gaps >= 0xFFFF, counts >= 0xFF
    return b"".join((np.array([len(ids)], "<u4").tobytes(), np.where(big, 0xFFFF, gaps).astype("<u2").tobytes(), np.where(many, 0xFF, counts).astype("u1").tobytes(), gaps[big].astype("<u4").tobytes(), counts[many].astype("<u4").tobytes()))


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    gaps, counts = np.frombuffer(data, "<u2", n, 4).astype(np.int64), np.frombuffer(data, "u1", n, 4 + 2 * n).astype(np.int64)
    rest = np.frombuffer(data, "<u4", -1, 4 + 3 * n)
    big, many = gaps == 0xFFFF, counts == 0xFF
    gaps[big], counts[many] = rest[: big.sum()], rest[big.sum() :]
    return np.cumsum(gaps), counts


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


#: Distinct packed symbols that a task holds before it passes their counts on.
HELD = 2_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) for the symbols of texts with their longest contexts."""
    held, n_held = (np.empty(0, np.int64), np.empty(0, np.int64)), 0
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for keys, _ in packed([stream(space_words(text or b"")) for text in raw(batch.column("text"))]):
            fresh.append(_sorted_counts(keys))
            n_held += len(fresh[-1][0])
            if n_held >= HELD:
                held = _summed(*(np.concatenate(x) for x in zip(held, *fresh)))
                n_held, fresh = 0, []
                if len(held[0]) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "n"])
                    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*(np.concatenate(x) for x in zip(held, *fresh)))], ["key", "n"])


def grow(grams: DataFrame, state_cost: float = STATE_COST, symbol_cost: float = SYMBOL_COST) -> tuple[DataFrame, DataFrame]:
    """The tree of (key, n), symbols with their longest contexts: its rows (key, logp), a state and a symbol seen after it,
    and its states (context, backoff), the log10 weight that an unseen symbol's probability in the parent state gets."""
    low, tag = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level)
    level = sum(((F.col("key") >= F.lit(1 << (8 * (k + 1)))).cast("int") for k in range(1, DEPTH + 1)), F.lit(0))
    longest = kept(grams.groupBy("key").agg(F.sum("n").alias("n"))).withColumn("k", F.explode(F.sequence(F.lit(0), level)))
    bits = (F.col("k") * 8 + 8).cast("int")
    seen = longest.groupBy(F.col("key").bitwiseAND(low(bits)).bitwiseOR(tag(bits)).alias("key")).agg(F.sum("n").alias("n"))
    seen = kept(seen.withColumn("level", level).withColumn("context", F.shiftright("key", 8)))
    sums = kept(seen.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")))
    bits = (F.col("level") * 8).cast("int")
    full = seen.join(sums, "context").withColumn("parent", F.col("key").bitwiseAND(low(bits)).bitwiseOR(tag(bits)))
    full = kept(full)
    above = full.select(F.col("key").alias("parent"), (F.col("n") / F.col("total")).alias("p"))
    gain = full.where("level > 1").join(above, "parent").groupBy("context").agg(F.sum(F.col("n") * F.ln(F.col("n") / F.col("total") / F.col("p"))).alias("gain"), F.count("*").alias("distinct"))
    found = gain.where(F.col("gain") >= state_cost + symbol_cost * F.col("distinct")).select("context")
    states = seen.where("level <= 1").select("context").distinct().union(found)
    # with all their suffixes: the latest k symbols of a context
    size = sum(((F.col("context") >= F.lit(1 << (8 * k))).cast("int") for k in range(1, DEPTH + 1)), F.lit(0))
    states = states.withColumn("k", F.explode(F.sequence(F.lit(0), size)))
    states = kept(states.select(F.col("context").bitwiseAND(low((F.col("k") * 8).cast("int"))).bitwiseOR(tag((F.col("k") * 8).cast("int"))).alias("context")).distinct())
    rows = full.join(states, "context", "left_semi")
    mixed = lambda parent: (F.col("n") + F.col("distinct") * parent) / (F.col("total") + F.col("distinct"))
    last = kept(rows.where("level = 0").select("key", mixed(F.lit(1.0 / SYMBOLS)).alias("p")))
    tree = last
    for k in range(1, DEPTH + 1):
        last = kept(rows.where(F.col("level") == k).join(last.select(F.col("key").alias("parent"), F.col("p").alias("q")), "parent").select("key", mixed(F.col("q")).alias("p")))
        tree = tree.union(last)
    return tree.select("key", F.log10("p").alias("logp")), sums.join(states, "context", "left_semi").select("context", F.log10(F.col("distinct") / (F.col("total") + F.col("distinct"))).alias("backoff"))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return hit, values[at] if len(keys) else np.zeros(len(wanted))


def log_probabilities(keys: np.ndarray, tree: tuple[np.ndarray, np.ndarray], states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each packed symbol in the longest suffix of its context that is a state."""
    out, level = np.zeros(len(keys)), levels(keys)
    open_at = np.arange(len(keys))
    for k in range(DEPTH, -1, -1):
        own = open_at[level[open_at] >= k]
        short = shortened(keys[own], k)
        hit, logp = _looked_up(*tree, short)
        out[own[hit]] += logp[hit]
        state, backoff = _looked_up(*states, short[~hit] >> 8)
        out[own[~hit]] += np.where(state, backoff, 0.0)
        done = np.zeros(len(keys), bool)
        done[own[hit]] = True
        open_at = open_at[~done[open_at]]
    out[open_at] -= np.log10(SYMBOLS)
    return out


def summed(streams: list[bytes], tree: tuple[np.ndarray, np.ndarray], states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each stream."""
    out = np.zeros(len(streams))
    for keys, of in packed(streams):
        at, distinct = pd.factorize(keys)
        out += np.bincount(of, log_probabilities(distinct, tree, states)[at], len(streams))
    return out


def broadcast_tree(tree: DataFrame, states: DataFrame, most: int):
    """The tree and its states as a broadcast of sorted arrays; None if they have more than `most` rows."""
    if tree.count() + states.count() > most:
        return None
    arrays = []
    for df, name, value in ((tree, "key", "logp"), (states, "context", "backoff")):
        got = df.toArrow()
        order = np.argsort(got.column(name).to_numpy())
        arrays.append((got.column(name).to_numpy()[order], got.column(value).to_numpy()[order]))
    return tree.sparkSession.sparkContext.broadcast(tuple(arrays))


def joined_scores(streams: DataFrame, tree: DataFrame, states: DataFrame) -> DataFrame:
    """(block, row, score) of streams (block, row, stream). Each block asks once for each of its symbols with contexts; these
    are joined with the tree, and the answers meet the block's streams."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_block = batch.column("block").to_numpy()
            for keys, of in packed(batch.column("stream").to_pylist()):
                block = of_block[of]
                for b in np.unique(block):
                    own = np.unique(keys[block == b])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array(own)], ["block", "gram"])

    every = kept(streams.mapInArrow(asked, "block long, gram long").distinct())
    size = sum(((F.col("gram") >= F.lit(1 << (8 * (k + 1)))).cast("int") for k in range(1, DEPTH + 1)), F.lit(0))
    bits = (F.col("k") * 8 + 8).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    grams = every.select("gram").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), size)))
    grams = grams.withColumn("key", F.col("gram").bitwiseAND(one - 1).bitwiseOR(one)).withColumn("context", F.shiftright("key", 8))
    grams = grams.join(tree, "key", "left").join(states, "context", "left")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "logp", "backoff")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("hit"))
    fold = lambda a, x: F.when(a["hit"], a).otherwise(F.struct((a["sum"] + F.coalesce(x["logp"], x["backoff"], F.lit(0.0))).alias("sum"), x["logp"].isNotNull().alias("hit")))
    done = lambda a: F.when(a["hit"], a["sum"]).otherwise(a["sum"] - F.lit(float(np.log10(SYMBOLS))))
    scored = grams.groupBy("gram").agg(F.aggregate(steps, start, fold, done).alias("logp"))
    told = every.join(scored, "gram").select("block", F.lit(0).alias("turn"), F.col("gram").alias("row"), "logp", F.lit(None).cast("binary").alias("stream"))
    both = told.union(streams.select("block", F.lit(1).alias("turn"), "row", F.lit(0.0).alias("logp"), "stream"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, given = None, [], None
        for batch in batches:
            block_of, turns = batch.column("block").to_numpy(), batch.column("turn").to_numpy()
            cuts = np.flatnonzero(np.diff(block_of) | np.diff(turns)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block_of)]):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if block_of[a] != at:
                    at, parts = block_of[a], []
                if turns[a] == 0:
                    parts.append((own.column("row").to_numpy(), own.column("logp").to_numpy()))
                    continue
                if parts:
                    keys, logp = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    given, parts = (keys[order], logp[order]), []
                held, score = own.column("stream").to_pylist(), np.zeros(b - a)
                for keys, of in packed(held):
                    score += np.bincount(of, given[1][np.searchsorted(given[0], keys)], len(held))
                yield pa.RecordBatch.from_arrays([own.column("block"), own.column("row"), pa.array(score)], ["block", "row", "score"])

    return both.repartition("block").sortWithinPartitions("block", "turn").mapInArrow(run, "block long, row long, score double")


@settled
def score_texts(docs: DataFrame, held_out: Column, most: int = BROADCAST_ROWS, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents for which held_out is false. score is the log10 probability of the text's stream in the suffix
    tree, which is broadcast while it has at most `most` rows; a larger one is joined, with equal scores. Null and empty
    texts have one token, the end. base_score adds
    log10((c + 1) / (N + V + 1)) over the tokens: c is the token's count, N that of all and V of distinct training tokens.
    Equal rows are scored alike; an empty table gives no rows; other columns of docs are not read.
    """
    rows = lean(docs).select("doc_id", held_out.alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tree, states = (kept(x) for x in grow(rows.where("not held_out").select("text").mapInArrow(_counted, "key long, n long")))
    given = broadcast_tree(tree, states, most)
    ddl = f"block long, row long, doc_id {kind}, held_out boolean, n_tokens long, words binary, word binary, trained long, score double, stream binary"
    blocks = kept(rows.mapInArrow(_blocks(block, given), ddl))
    asked = blocks.where("word is not null").select("block", F.col("n_tokens").alias("id"), "word", "trained")
    words = kept(asked.groupBy("word").agg(F.sum("trained").alias("n")))
    totals = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = int(totals["n"]), int(totals["v"])
    none = lambda kind: F.lit(None).cast(kind)
    told = asked.select("block", "id", "word").join(words, "word").select("block", F.lit(0).alias("turn"), none("long").alias("row"), F.col("id").alias("n_tokens"), F.col("n").alias("count"), none(kind).alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("words"), none("double").alias("score"))
    texts = blocks.where("words is not null").select("block", F.lit(1).alias("turn"), "row", "n_tokens", F.lit(0).cast("long").alias("count"), "doc_id", "held_out", "words", "score")
    both = told.union(texts).repartition("block").sortWithinPartitions("block", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, counts, base = None, [], None, None
        for batch in batches:
            block_of = batch.column("block").to_numpy()
            turns = batch.column("turn").to_numpy()
            cuts = np.flatnonzero(np.diff(block_of) | np.diff(turns)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block_of)]):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if block_of[a] != at:
                    at, parts = block_of[a], []
                if turns[a] == 0:
                    parts.append((own.column("n_tokens").to_numpy(), own.column("count").to_numpy()))
                    counts = None
                    continue
                if counts is None or parts:
                    ids, c = (np.concatenate(x) for x in zip(*parts))
                    counts = np.zeros(len(ids), np.int64)
                    counts[ids] = c
                    base, parts = np.log10((counts + 1) / (n_all + distinct + 1)), []
                known, first = [], []
                for data in own.column("words"):
                    ids, times = _decoded(data.as_py())
                    known.append(int(times[counts[ids] > 0].sum()))
                    first.append(float(base[ids] @ times))
                yield pa.RecordBatch.from_arrays([own.column("block"), own.column("row"), own.column("doc_id"), own.column("held_out"), own.column("n_tokens"), pa.array(known, pa.int64()), pa.array([n_all] * len(known), pa.int64()), pa.array(first, pa.float64()), own.column("score")], ["block", "row", *names])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = schema_of(docs, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = both.mapInArrow(run, T.StructType([*T.StructType.fromDDL("block long, row long").fields, *kinds.fields]))
    if given is None:
        streams = blocks.where("stream is not null").select("block", "row", "stream")
        out = out.drop("score").join(joined_scores(streams, tree, states), ["block", "row"])
    return out.select(*names)
