"""What the corpus operators share: words, hashes, tables kept in the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.shared import dropped, kept

#: Everything but a-z, 0-9 and bytes from 0x80 becomes a space, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bits of a key filter's bitmap, as a power of two.
_BITS = 26

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(docs: DataFrame, ddl: str) -> T.StructType:
    """doc_id as docs has it, then the named columns."""
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(ddl).fields])


#: Bytes of an Arrow batch between Spark and Python, on either side of it.
BATCH = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold few texts, as texts may be long. A size that the user set is left."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64MB", "64m"):  # Spark's default
        conf.set(name, str(BATCH))
    return df


def eased(run: Callable) -> Callable:
    """run, a function of batches, after which a Python worker gives back the memory it doesn't need, as workers are used
    again for other stages and would each hold the most that any stage took."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return own


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space; A-Z become a-z, other bytes stay."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of bytes from 0x80; A-Z become a-z."""
    return text.translate(_FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """The column's strings as UTF-8 bytes, one at a time."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() for x in column.cast(binary))


def _bit(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64)) >> np.uint64(64 - _BITS)


def key_filter(keys: DataFrame):
    """A function of int64 arrays that is true where a key may be among those of the one column of keys. 8 MB at any size."""

    @eased
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bit(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array(signed(np.uint64(1) << (bits & np.uint64(63))))], ["word", "bits"])

    spark = keys.sparkSession
    found = keys.mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**20 rows at most
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    def may_have(x: np.ndarray) -> np.ndarray:
        bits = _bit(np.ascontiguousarray(x))
        return (held.value[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) > 0

    return may_have


def filtered(df: DataFrame, column: str, may_have) -> DataFrame:
    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(batch.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)


#: Edges that one task connects by itself, 16 bytes each and a few times that for its table of nodes.
FEW_EDGES = 400_000


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (a, b) of longs, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs.

    Returns (node, root) for every node of an edge; root is the smallest node it reaches. Up to `few` edges are connected
    by one task. With more, each partition first replaces its edges by those of its own components' roots; then large-star
    and small-star rounds alternate until no edge changes. They take a minimum per node, which Spark combines before the
    shuffle, so a node with very many edges is no hot group, and joins on it may be split by adaptive execution.
    """
    edges = kept(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_connected, "node long, root long")
    spark = edges.sparkSession
    # the forest of each partition has as many edges as it has nodes at most
    forest = edges.mapInArrow(_connected, "a long, b long").where("a <> b").distinct()
    now = kept(forest)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        later = kept(small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        dropped(spark, now)
        now = later
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
