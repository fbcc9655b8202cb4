"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has t bins. In round i every shingle falls into a bin picked by a hash of that round, with the value (i, hash);
bins keep their smallest value and the rounds go on until no bin is empty. From round t on all shingles fall into bin
i - t, so every bin fills after 2 t rounds at the latest. Two sketches agree in a bin with the probability of the sets'
Jaccard similarity, with the concentration of t independent draws or better.

Documents of equal shingle sets are one class. Classes that agree in all bins of a band share a bucket. Links are
confirmed on full sets. A bucket's members are compared with its lead, so a bucket of very many copies costs as many
comparisons as it has members. What the leads leave unconnected goes on to an exact second round, on the rarest shingles
of the sets, so that no link between a bucket's members is missed. Both rounds drop a pair where they make it if the
parities of the two sets differ in more bits than the sets of a link can differ in shingles; sets are joined after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import components, dropped, eased, filtered, kept, key_filter, lean, mix, raw, schema_of, signed, space_words
from lodestone.sources.shared import settled

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    w = min(k, n)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out = mix(out + h[i : n - w + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The t bin values of a set of at least one 64-bit hash."""
    out = np.full(t, _FULL)
    for i in range(2 * t):
        x = mix(items + mix(np.array([i + 1], np.uint64))[0])
        value = (x >> np.uint64(12)) | np.uint64(i << 52)
        if i < t:
            np.minimum.at(out, ((x & np.uint64(0xFFF)) * np.uint64(t)) >> np.uint64(12), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if i >= t or out.max() != _FULL:
            if out.max() != _FULL:
                break
    return out


def banding(threshold: float, t: int = 180, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have while a pair at the threshold shares no band with probability `miss` at most."""
    rows = max(r for r in range(1, t + 1) if r == 1 or (1 - threshold**r) ** (t // r) <= miss)
    return t // rows, rows


def bands(values: np.ndarray, n: int, rows: int) -> np.ndarray:
    out = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out + values[i : n * rows : rows])
    return out


def _sketched(k: int, n_bands: int, rows: int):
    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, parts = [], [], []
            for text in raw(batch.column("text")):
                items = shingles(space_words(text or b""), k)
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                if len(items):
                    parts.append(bands(sketch(items, n_bands * rows), n_bands, rows))
            ends = np.concatenate(([0], np.cumsum(np.where(np.array(sizes, int) > 0, n_bands, 0)))).astype(np.int32)
            flat = pa.array(signed(np.concatenate(parts)) if parts else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_shingles", "_key", "_bands"])

    return run


def _sets(k: int, may_be_wanted):
    """(doc_id, _key, set) of the documents that may be wanted, by the hash _mark of doc_id."""

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_be_wanted(batch.column("_mark").to_numpy())))
            sets = [shingles(space_words(text or b""), k) for text in raw(batch.column("text"))]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.empty(0, np.int64)
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "_key", "set"])

    return run


#: Comparisons that meet in one task for a pivot; more are spread over copies of the pivot's set.
PER_SALT = 512


#: Longs of a set's parities, 64 bits each.
PARITY = 8


def _parities(sets: DataFrame) -> DataFrame:
    """(node, n, p): the set's size, and for each of 64 * PARITY slots of shingles whether it has an odd number of them."""

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.fromiter((len(x) for x in batch.column("set")), np.int64, batch.num_rows)
            slots = batch.column("set").flatten().to_numpy().view(np.uint64) % np.uint64(64 * PARITY)
            of = np.repeat(np.arange(batch.num_rows), sizes) * (64 * PARITY)
            odd = np.bincount(of + slots.astype(np.int64), minlength=batch.num_rows * 64 * PARITY) & 1
            words = np.packbits(odd.astype(bool)).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, PARITY, dtype=np.int32), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes), lists], ["node", "n", "p"])

    return sets.select("node", "set").mapInArrow(run, "node long, n long, p array<long>")


def _may_link(percent: int) -> Column:
    """Whether (n, p) and (pivot_n, pivot_p) can be of sets that link. Parities differ in at most as many bits as the sets
    have shingles apart, and of two sets that link at most (100 - percent) / (100 + percent) of both sizes are apart."""
    apart = reduce(add, (F.bit_count(F.col("p")[i].bitwiseXOR(F.col("pivot_p")[i])) for i in range(PARITY)))
    size = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    return size & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("pivot_n")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) whose full sets have at least `percent` of a hundred in common."""
    salts = kept(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts")))
    left = pairs.join(sets.select("node", F.col("set").alias("own")), "node").join(salts, "pivot")
    left = left.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).drop("salts")
    right = sets.select(F.col("node").alias("pivot"), F.col("set").alias("other")).join(salts, "pivot")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = left.join(right, ["pivot", "salt"]).withColumn("common", F.size(F.array_intersect("own", "other")))
    union = F.size("own") + F.size("other") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("pivot", "node")


def _open_parts(state: DataFrame) -> DataFrame:
    """(bucket, root, open, p, rank) of the connected parts of a bucket that still have nodes which were no pivots, the one
    with most of them first; p is the first of them. Only where a bucket has two such parts can it hide a link."""
    own = F.struct("node", *(c for c in ("n", "most", "p") if c in state.columns))
    parts = state.groupBy("bucket", "root").agg(F.count_if(~F.col("used")).alias("open"), F.min(F.when(~F.col("used"), own)).alias("p"))
    by = Window.partitionBy("bucket").orderBy(F.desc("open"), "root")
    return parts.where("open > 0").withColumn("rank", F.row_number().over(by))


def _state(members: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
    state = members.join(roots, "node", "left").join(done.withColumn("used", F.lit(True)), ["bucket", "node"], "left")
    return state.select(*members.columns, F.coalesce("root", "node").alias("root"), F.coalesce("used", F.lit(False)).alias("used"))


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, n, most): for each set its first shingles in one order of all, as many as a set that is similar enough
    cannot miss all of. The order is by how often the sets have them, rarest first, as counted in 2**20 slots. A set whose
    first common shingle stands in this place can have `most` shingles at most, as those before it are not shared."""

    @eased
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 20, np.int64)
        for batch in batches:
            counts += np.bincount((batch.column("set").flatten().to_numpy().view(np.uint64) >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])

    found = sets.select("set").mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2**20 rows at most
    often = np.zeros(1 << 20, np.int64)
    often[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    given = sets.sparkSession.sparkContext.broadcast(often)

    @eased
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes, largest = [], [], [], []
            for node, items in zip(batch.column("node").to_pylist(), batch.column("set")):
                x = items.values.to_numpy()
                n = len(x)
                most = n - -(-percent * n // 100) + 1
                order = np.lexsort((x, given.value[(x.view(np.uint64) >> np.uint64(44)).astype(np.int64)]))[:most]
                keys.append(x[order])
                nodes.append(np.full(most, node))
                sizes.append(np.full(most, n))
                # n - i shingles are left at place i, and percent / (100 + percent) of both sizes must be common
                largest.append((n - np.arange(most)) * (100 + percent) // percent - n)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, nodes, sizes, largest)], ["bucket", "node", "n", "most"])

    return sets.mapInArrow(firsts, "bucket long, node long, n long, most long")


def _shared(cells: DataFrame) -> DataFrame:
    """The rows of cells (bucket, node, n, ...) whose bucket has another node."""
    return cells.join(kept(cells.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")), "bucket")


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the nodes that have links. members: bucket, node.

    First the lead of each bucket is compared with all others. Where members stay unconnected and were not compared, all
    nodes of the bucket go on to a second, exact round over cells: sets that are similar enough share one of their rare
    shingles. There pivots of all connected parts but the largest are compared with the other parts, until none is left.
    """
    fits = _may_link(percent)
    own = kept(_parities(sets))
    lead_own = own.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("p").alias("pivot_p"))
    lead = kept(members.groupBy("bucket").agg(F.min("node").alias("pivot")))
    met = members.select("bucket", "node").join(lead, "bucket").where("node <> pivot").select("pivot", "node").distinct()
    tried = kept(met.join(own, "node").join(lead_own, "pivot").where(fits).select("pivot", "node"))
    links = kept(_confirmed(tried, sets, percent))
    roots = kept(components(links.select(F.col("pivot").alias("a"), F.col("node").alias("b"))))
    state = _state(members, roots, lead.select("bucket", F.col("pivot").alias("node")))
    hiding = _open_parts(state).where("rank = 2").select("bucket")
    nodes = kept(members.join(hiding, "bucket", "left_semi").select("node").distinct())
    if nodes.isEmpty():
        return roots
    cells = kept(_rare(sets.join(nodes, "node", "left_semi"), percent))
    least = cells.groupBy("bucket").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1").select("bucket", "least")
    cells = kept(_shared(kept(cells.join(kept(least), "bucket").where("most >= least").drop("least"))).join(own.select("node", "p"), "node"))
    fits = fits & (F.col("n") <= F.col("pivot_most")) & (F.col("pivot_n") <= F.col("most"))
    done = kept(cells.select("bucket", "node").limit(0))
    step = 0
    while True:
        step += 1
        state = kept(_state(cells, roots, done))
        parts = _open_parts(state).where("rank > 1").withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy("open", "root"))).where(F.col("turn") <= 4 ** min(step, 15))
        pivots = kept(parts.select("bucket", F.col("root").alias("pivot_root"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.most").alias("pivot_most"), F.col("p.p").alias("pivot_p")))
        if pivots.isEmpty():
            return roots
        pairs = state.join(pivots, "bucket").where("root <> pivot_root").where(fits)
        pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        seen = tried.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        fresh = kept(pairs.join(seen, ["a", "b"], "left_anti").select(F.col("a").alias("pivot"), F.col("b").alias("node")))
        found = kept(_confirmed(fresh, sets, percent))
        tried, done = tried.union(fresh), done.union(pivots.select("bucket", F.col("pivot").alias("node")))
        dropped(roots.sparkSession, state)
        if not found.isEmpty():
            links = links.union(found)
            roots = kept(components(links.select(F.col("pivot").alias("a"), F.col("node").alias("b"))))


@settled
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bins: int = 180) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Linked are documents whose sets of word shingles have an intersection of at least `percent` hundredths of their
    union. Texts that are null or have no words have no shingles and link with nothing. Equal rows each get a row. A
    document without doc_id is linked with nothing: its component_id is null and it is kept. An empty table gives no
    rows; other columns of docs are not read.
    """
    n_bands, rows = banding(percent / 100, bins)
    docs = lean(docs).select("doc_id", "text")
    all_rows = kept(docs.mapInArrow(_sketched(words, n_bands, rows), schema_of(docs, "n_shingles long, _key binary, _bands array<long>")))
    linked = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("_bands").alias("_bands"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))
    cells = classes.select("node", F.explode("_bands").alias("bucket"))
    members = kept(_shared(cells))
    nodes = kept(classes.join(members.select("node").distinct(), "node", "left_semi").select("_key", "doc", "node"))
    wanted = key_filter(nodes.select(F.xxhash64("doc")))
    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_mark")).mapInArrow(_sets(words, wanted), schema_of(docs, "_key binary, set array<long>"))
    sets = found.withColumnRenamed("doc_id", "doc").join(nodes, ["doc", "_key"]).select("node", "set")
    roots = _links(members, kept(sets), percent)
    named = classes.select("_key", "doc", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "root").select("_key", "component_id")
    found = all_rows.select("doc_id", "n_shingles", "_key").join(named, "_key", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, bins: int = 180) -> DataFrame:
    """docs with one document of each group of near-duplicates: the smallest by doc_id and hash of the text, and one row of
    those that are equal in both. All columns stay. Only documents that may go are moved."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    near = near_duplicates(docs.select(key.alias("doc_id"), "text"), words, percent, bins).select("doc_id", "kept")
    lost = near.where(~F.col("kept")).select("doc_id").distinct()
    twice = near.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    may_go = key_filter(lost.union(twice).select("doc_id.text"))
    name = "__lodestone_hash"
    own = docs.withColumn(name, F.xxhash64("text"))
    clear = filtered(own, name, lambda x: ~may_go(x)).drop(name)
    lost = lost.select(F.col("doc_id.doc_id").alias("_lost_id"), F.col("doc_id.text").alias("_lost_text"))
    rest = filtered(own, name, may_go)
    rest = rest.join(lost, rest["doc_id"].eqNullSafe(lost["_lost_id"]) & (rest[name] == lost["_lost_text"]), "left_anti")
    return clear.union(rest.dropDuplicates(["doc_id", name]).drop(name))
