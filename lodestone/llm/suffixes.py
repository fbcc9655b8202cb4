"""Repeated byte strings across documents, found by suffix arrays over the places where copies can be.

1. Anchors. Of the 32-byte strings inside a window of `length` bytes the one with the smallest hash, the last on a tie, is
   its anchor. Equal windows have equal anchors at equal offsets, so every repeated window is seen among the occurrences
   of one anchor, each with its context: the bytes of the windows that have it as their anchor. An anchor that a document
   has several times with one context, as in a line that is repeated on and on, is one row with all its places.
2. Anchors seen once are dropped. Where all contexts of an anchor are equal, they are repeated as a whole.
3. The distinct contexts of each other anchor are cut to what they can share, their common core becomes one symbol, and a
   generalised suffix array of them gives the longest match of every suffix. It is built by Lyndon grouping: groups of
   suffixes with one Lyndon prefix are taken in descending order and split by previous-smaller pointers; the second pass
   writes out the order of each group from the pointers, with no recursion and no renaming.
4. A group of more than HOT distinct contexts is split, so that no task holds them all. A window has some bytes before the
   anchor and the rest behind it: where contexts share one, they share half of the possible bytes before it or half of those
   behind it. Each context goes to two groups, by either half, and larger groups are split again in the same way, down to
   groups whose contexts share one whole window.

A filter of fixed size (a bitmap of hashed keys) keeps rows that cannot match out of the shuffles; when it fills up it
lets rows pass, which costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import eased, filtered, kept, key_filter, lean, mix, raw, schema_of, signed
from lodestone.sources.shared import settled

GRAM = 32
#: Distinct contexts that one suffix array may hold; at 200 bytes a string they make 1.5 million symbols, some 300 MB, at worst.
HOT = 4096
#: Bytes of a document that are hashed at a time.
SEGMENT = 1 << 19


#: Names of columns added for a while to tables that keep all of theirs.
_HASH, _SPANS = "__lodestone_hash", "__lodestone_spans"


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; symbols are integers of any size."""
    n = len(symbols) + 1  # with an end symbol below all others
    ranks = {c: g + 1 for g, c in enumerate(sorted(set(symbols)))}
    group = [ranks[c] for c in symbols] + [0]
    members: list[list[int]] = [[] for _ in range(len(ranks) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    after, before = list(range(1, len(members))) + [-1], list(range(-1, len(members) - 1))
    smaller, done = list(range(-1, n - 1)), [False] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = True
        pointed: dict[int, int] = {}
        for i in own:
            j = smaller[i]
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for _, q in sorted(moved) if len(moved) > 1 else moved:
            part = moved[_, q]
            new = len(members)
            members.append(part)
            for j in part:
                group[j] = new
            after.append(after[q])
            before.append(q)
            if after[q] >= 0:
                before[after[q]] = new
            after[q] = new
        g = before[g]
    start, g, at = {}, 0, 0
    while g >= 0:
        start[g] = at
        at += sum(group[i] == g for i in members[g])
        g = after[g]
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            order[start[group[j]]] = j
            start[group[j]] += 1
            placed[j] = True
            j = smaller[j]
    return order[1:]


def longest_matches(symbols: list[int], order: list[int]) -> list[int]:
    """For each suffix, the symbols it has in common with the other suffix that shares most."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    best, h = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        best[i], best[j] = max(best[i], h), max(best[j], h)
        h = max(h - 1, 0)
    return best


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _most_shared(texts: list[bytes]) -> list[int]:
    """For each text, the longest prefix it has in common with any other."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for a, b in zip(order, order[1:]):
        n = _common(texts[a], texts[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def shared_spans(contexts: list[tuple[int, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes before the anchor, context): the spans of it covered by strings of `length` bytes that stand around
    the anchor of another context too, at the same offset from it."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    lefts, rights = [x[:at][::-1] for at, x in contexts], [x[at:] for at, x in contexts]
    reach = list(zip(_most_shared(lefts), _most_shared(rights)))
    live = [k for k, (a, b) in enumerate(reach) if a + b >= length]
    if not live:
        return out
    l0 = min(reach[k][0] for k in live) if len(live) < 2 else _common(min(lefts[k] for k in live), max(lefts[k] for k in live))
    r0 = min(reach[k][1] for k in live) if len(live) < 2 else _common(min(rights[k] for k in live), max(rights[k] for k in live))
    l0, r0 = min(l0, *(reach[k][0] for k in live)), min(r0, *(reach[k][1] for k in live))
    symbols: list[int] = []
    places: list[tuple[int, int, int]] = []  # context, offset from its anchor, bytes
    core = 256 * (1 << 20)
    for k in live:
        (a, b), at = reach[k], contexts[k][0]
        x = contexts[k][1]
        for d in range(-a, -l0):
            symbols.append((d + (1 << 19)) * 256 + x[at + d])
            places.append((k, d, 1))
        symbols.append(core)
        places.append((k, -l0, l0 + r0))
        for d in range(r0, b):
            symbols.append(core + (d + 1) * 256 + x[at + d])
            places.append((k, d, 1))
        symbols.append(-1 - k)  # ends a context; it has no equal
        places.append((k, b, 0))
    best = longest_matches(symbols, suffix_array(symbols))
    starts = np.concatenate(([0], np.cumsum([p[2] for p in places])))
    for i, (k, d, size) in enumerate(places):
        if size and (m := int(starts[i + best[i]] - starts[i])) >= length:
            out[k].append((contexts[k][0] + d, contexts[k][0] + d + m))
    return out


def anchors(text: np.ndarray, length: int) -> np.ndarray:
    """Rows of the anchors: position, hash of the gram there, first window that has it as its anchor, end of the last one."""
    w, found = length - GRAM + 1, []
    low = np.uint64((1 << 20) - 1)
    for a in range(0, max(len(text) - length + 1, 0), SEGMENT):
        x = text[a : a + SEGMENT + length - 1].astype(np.uint64)
        for step in (1, 2, 4, 8, 16):
            x = x[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + x[step:]
        h = mix(x)
        least = _sliding(h & ~low | low - np.arange(len(h), dtype=np.uint64), w, np.minimum)
        at = (low - (least & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        found.append(np.stack((at + a, h[at].view(np.int64), first + a, last + a + length)))
    return np.concatenate(found, 1) if found else np.empty((4, 0), np.int64)


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    step = 1
    while 2 * step <= w:
        x, step = f(x[:-step], x[step:]), 2 * step
    return f(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def _anchored(length: int):
    """Rows of the anchors of each document, one for each anchor and context: `at` is its first place, `more` has the others."""

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, more, gram, own, before, behind = [], [], [], [], [], [], []
            for i, text in enumerate(raw(batch.column("text"))):
                if not text or len(text) < length:
                    continue
                p, h, lo, hi = anchors(np.frombuffer(text, np.uint8), length)
                context = np.array([xxhash.xxh3_64_intdigest(text[a:b], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (p - lo).tolist())], np.uint64)
                order = np.lexsort((p, context, h))
                p, h, lo, hi, context = (x[order] for x in (p, h, lo, hi, context))
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (context[1:] != context[:-1]))))
                last = np.append(first[1:], len(p))
                rows.append(np.full(len(first), i))
                at.append(p[first])
                more += [p[a + 1 : b].tolist() if b - a > 1 else None for a, b in zip(first.tolist(), last.tolist())]
                gram.append(h[first])
                before.append((p - lo)[first])
                behind.append((hi - p)[first])
                own.append(context[first])
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            at, before, behind, gram = (pa.array(np.concatenate(x).astype(t)) for x, t in ((at, np.int64), (before, np.int32), (behind, np.int32), (gram, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_text").take(take), at, pa.array(more, pa.list_(pa.int64())), before, behind, gram, pa.array(signed(np.concatenate(own)))],
                ["doc_id", "_text", "at", "more", "before", "behind", "gram", "own"],
            )

    return run


def _contexts(length: int):
    """(gram, own, before, context) of each place wanted of a document."""

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(raw(batch.column("text")), batch.column("wanted")):
                for w in wanted.as_py():
                    out.append((w["gram"], w["own"], w["before"], text[w["at"] - w["before"] : w["at"] + w["behind"]]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["gram", "own", "before", "context"])

    return run


def _spanned(length: int):
    """(gram, own, lo, hi) of the spans of each context. Rows come ordered by block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("block", "gram", "own", "before", "context")))

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(rows(batches), lambda x: x[0]):
            own = {x[1:3]: x[3:] for x in group}
            for key, spans in zip(own, shared_spans(list(own.values()), length)):
                out += [(*key, a, b) for a, b in _merged(spans)]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "own", "lo", "hi"])

    return run


def _halves(length: int):
    """Contexts dealt to two blocks each. A block is of windows with `least` to `most` bytes before the anchor, and its
    contexts share all bytes that these have in common; one of the two has the lower half of that range, one the upper."""
    rest = length - GRAM

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks, least, most = [], [], [], []
            for i, (block, lo, hi, at, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "least", "most", "before", "context")))):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if at >= a and len(x) - at >= length - b:
                        rows.append(i)
                        blocks.append(xxhash.xxh3_64_intdigest(block.to_bytes(8, "big", signed=True) + a.to_bytes(4, "big") + x[at - a : at + length - b]))
                        least.append(a)
                        most.append(b)
            out = batch.take(pa.array(rows, pa.int64()))
            for name, values, kind in (("block", signed(np.array(blocks, np.uint64)), pa.int64()), ("least", least, pa.int32()), ("most", most, pa.int32())):
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, kind))
            yield out

    return run


def _settled_spans(contexts: DataFrame, many: DataFrame, length: int, hot: int) -> DataFrame:
    """(gram, own, lo, hi) of the spans of all contexts; many: the grams that have over `hot` of them."""
    blocks = contexts.withColumns({"block": F.col("gram"), "least": F.lit(0), "most": F.lit(length - GRAM)})
    few, large = blocks.join(many, "gram", "left_anti"), kept(blocks.join(many, "gram", "left_semi"))
    whole = None
    while not large.isEmpty():
        halves = kept(large.mapInArrow(_halves(length), large.schema))
        sizes = kept(halves.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"))
        halves = kept(halves.join(sizes, "block"))
        again = F.col("size") > hot
        few = few.unionByName(halves.where(~again).drop("size"))
        one = halves.where(again & (F.col("least") == F.col("most"))).select("gram", "own", (F.col("before") - F.col("least")).alias("lo"), (F.col("before") - F.col("least") + length).cast("int").alias("hi"))
        whole = whole.union(one) if whole else one
        large = halves.where(again & (F.col("least") < F.col("most"))).drop("size")
    spans = few.repartition("block").sortWithinPartitions("block", "gram", "own").mapInArrow(_spanned(length), "gram long, own long, lo int, hi int")
    return spans.union(whole) if whole else spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))


def _joined(spans: Column) -> Column:
    """Spans that touch or overlap made one, so that there are a few for a context however many windows it has."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], x["hi"]).alias("hi"))))
    step = lambda acc, x: F.when(last(acc)["hi"] >= x["lo"], grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<lo:int,hi:int>>"), step)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_text"] == b["_key"])


@settled
def repeated_spans(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(_id, _key, spans): for documents, named by doc_id and the hash of the text, that have them, the spans (lo, hi) in
    bytes covered by strings of `length` bytes that also start anywhere else. Spans may overlap and are in no order. Anchors
    with over `hot` distinct contexts are split."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    docs = _keyed(lean(docs))
    schema = schema_of(docs, "_text long, at long, more array<long>, before int, behind int, gram long, own long")
    found = kept(docs.mapInArrow(_anchored(length), schema))
    times = F.sum(F.coalesce(F.array_size("more") + 1, F.lit(1))).alias("n")
    twice = found.groupBy("gram").agg(times).where("n > 1").select("gram")
    near = kept(filtered(found, "gram", key_filter(twice)))
    kinds = kept(near.groupBy("gram").agg(times, F.min("own").alias("a"), F.max("own").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))  # a table of its own, so that a join on it can split hot grams
    near = kept(near.join(kinds, "gram"))
    places = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<long>")))
    whole = F.transform(places, lambda p: F.struct((p - F.col("before")).alias("lo"), (p + F.col("behind")).alias("hi")))
    alike = near.where(~F.col("mixed")).select("doc_id", "_text", whole.alias("spans"))
    mixed = near.where("mixed").drop("mixed")
    first = F.min(F.struct("doc_id", "_text", "at", "before", "behind")).alias("f")
    owns = kept(mixed.groupBy("gram", "own").agg(times, first))
    wanted = owns.groupBy(F.col("f.doc_id").alias("_id"), F.col("f._text").alias("_key")).agg(F.collect_list(F.struct("gram", "own", "f.at", "f.before", "f.behind")).alias("wanted"))
    wanted = kept(wanted)
    texts = filtered(docs, "_text", key_filter(wanted.select("_key")))
    texts = texts.join(wanted, _same(texts, wanted)).select("text", "wanted")
    contexts = kept(texts.mapInArrow(_contexts(length), "gram long, own long, before int, context binary"))
    many = kept(owns.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram"))  # as kinds
    spans = _settled_spans(contexts, many, length, hot)
    copies = owns.where("n > 1").select("gram", "own", F.lit(0).alias("lo"), (F.col("f.before") + F.col("f.behind")).alias("hi"))
    spans = kept(spans.union(copies).groupBy("gram", "own").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumn("spans", _joined(F.col("spans"))))
    # spans stay in arrays, one for each anchor and context of a document, until they are the document's
    shifted = F.flatten(F.transform(places, lambda p: F.transform("spans", lambda x: F.struct((p - F.col("before") + x["lo"]).alias("lo"), (p - F.col("before") + x["hi"]).alias("hi")))))
    apart = mixed.join(spans, ["gram", "own"]).select("doc_id", "_text", shifted.alias("spans"))
    both = alike.union(apart).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"))
    return both.agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _cut(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    runs, kept_parts, last = _merged([(s["lo"], s["hi"]) for s in spans]), [], 0
    for a, b in runs:
        kept_parts.append(text[last:a])
        last = b
    return runs, b"".join([*kept_parts, text[last:]])


@settled
def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<lo,hi>>, judged on the
    UTF-8 bytes of the texts and never across documents.

    A null text counts as empty; texts shorter than `length` lose nothing; equal rows are copies of each other, and each
    loses its text from `length` bytes on. Documents that lose nothing are digested where they are read; only the others'
    texts are moved. Other columns of docs are not read.
    """
    spans = repeated_spans(docs, length)
    may_have = key_filter(spans.select("_key"))
    docs = _keyed(docs)
    utf8 = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sums = docs.select("doc_id", "_text", F.octet_length(utf8).cast("long").alias("n_bytes"), F.sha2(utf8, 256).alias("digest"))
    clean = sums.join(spans, _same(sums, spans), "left_anti")
    clean = clean.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("digest").alias("kept_sha256"), F.array().cast("array<struct<lo:long,hi:long>>").alias("spans"))
    hit = filtered(docs, "_text", may_have)
    hit = hit.join(spans, _same(hit, spans)).select("doc_id", "text", "spans")

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), batch.column("spans")):
                runs, rest = _cut(text, own.as_py())
                out.append((doc_id, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"lo": a, "hi": b} for a, b in runs]))
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return clean.union(hit.mapInArrow(run, schema_of(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the repeated bytes taken out of text, all other columns as they are; a removed run is narrowed to whole
    code points. n_chars, where there is such a column, becomes the new text's."""
    spans = repeated_spans(docs, length)
    may_have = key_filter(spans.select("_key"))
    own = docs.withColumn(_HASH, F.xxhash64("text"))
    clean = filtered(own, _HASH, lambda x: ~may_have(x)).drop(_HASH)
    hit = filtered(own, _HASH, may_have)
    same = hit["doc_id"].eqNullSafe(spans["_id"]) & (hit[_HASH] == spans["_key"])
    joined = hit.join(spans, same, "left").select(*(hit[c] for c in docs.columns), spans["spans"].alias(_SPANS))

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(raw(batch.column("text")), batch.column(_SPANS)):
                if found.is_valid:
                    for a, b in reversed(_merged([(s["lo"], s["hi"]) for s in found.as_py()])):
                        while a < b and text[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                            b -= 1
                        text = text[:a] + text[b:]
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)).drop_columns([_SPANS])

    out = clean.union(joined.mapInArrow(run, docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
