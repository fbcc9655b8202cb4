"""Weighted placement of rows on a tree of regions, racks and shards, by built-in functions only.

A key descends from level to level. At each level every child draws an exponential clock -ln(u)/weight, whose u is a hash
of the key and the child's name and whose weight is the sum of the shards' below it; the child that rings first is taken.
Draws of a level depend on the weights of that level's children alone, so a change of a shard's weight moves keys into or
out of its region, its rack and itself, and keys that stay in another subtree stay in their place there. A row costs as
many draws as the nodes on its way have children, however many shards there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import kept

#: Shards' weights by number, in racks by name, in regions by name. Names are part of the draws; a moved name moves its keys.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """Shards 0 to shards-1 of equal weight, filled in rack by rack and region by region."""
    tree: Tree = {}
    for n in range(shards):
        rack = n // per_rack
        tree.setdefault(f"region {rack // racks_per_region}", {}).setdefault(f"rack {rack}", {})[n] = 1.0
    return tree


def with_shard(tree: Tree, number: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: no other node's weight changes, so keys move into it only."""
    return tree | {f"region of {number}": {f"rack of {number}": {number: weight}}}


def _children(named: dict[str, float]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in named.items()))


def _drawn(children: Column, key: Column) -> Column:
    """The place, from 1, of the child that rings first; of the first of them if several do."""

    def clock(child: Column, at: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(child["name"], key), 11)
        ring = -F.ln((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / child["weight"]
        return F.struct(F.when(child["weight"] > 0, ring).otherwise(F.lit(float("inf"))).alias("ring"), (at + 1).alias("at"))

    return F.array_min(F.transform(children, clock))["at"]


def place(df: DataFrame, key: str, tree: Tree, to: str = "shard") -> DataFrame:
    """Adds the shard number of each row. Rows of equal keys go together; a null key is a key like any other. Shards of
    weight 0 get rows only where all beside them have weight 0 too."""
    own = F.col(key).cast("string")
    total = lambda rack: sum(rack.values())
    regions = _children({region: sum(map(total, racks.values())) for region, racks in tree.items()})
    racks = F.array(*(_children({f"{region}/{rack}": total(x) for rack, x in own_racks.items()}) for region, own_racks in tree.items()))
    shards = F.array(*(F.array(*(_children({f"shard {n}": w for n, w in rack.items()}) for rack in region.values())) for region in tree.values()))
    numbers = F.array(*(F.array(*(F.array(*map(F.lit, rack)) for rack in region.values())) for region in tree.values()))
    region, rack, leaf = (f"__{to}_{x}" for x in ("region", "rack", "leaf"))
    out = df.withColumn(region, _drawn(regions, own))
    out = out.withColumn(rack, _drawn(F.element_at(racks, F.col(region)), own))
    out = out.withColumn(leaf, _drawn(F.element_at(F.element_at(shards, F.col(region)), F.col(rack)), own))
    found = F.element_at(F.element_at(F.element_at(numbers, F.col(region)), F.col(rack)), F.col(leaf))
    return out.withColumn(to, found).drop(region, rack, leaf)


def numbered(df: DataFrame, group: str, to: str = "slot") -> DataFrame:
    """Adds a number from 0, without gaps, within each value of group, however large the group.

    The rows are kept once; each block of them is numbered on its own and starts where the blocks before it ended.
    """
    blocks = kept(df.withColumn("_block", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sums = blocks.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(group, "_block").orderBy("_at")) - 1
    ranked = blocks.withColumn(to, own)
    out = ranked.join(starts, ranked[group].eqNullSafe(starts["_g"]) & (ranked["_block"] == starts["_b"]))
    return out.withColumn(to, F.col(to) + F.col("_start")).drop("_g", "_b", "_block", "_at", "_start")


def shard_documents(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """Places documents by doc_id: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    grown_shard is the place in a tree with one more shard, which takes rows only into itself. A null text counts as empty, equal rows each get a slot, an empty table gives no rows, and other columns of docs are
    not read. Only sizes and checksums are shuffled; texts stay where they are read.
    """
    tree = tree or even_tree(8)
    grown = grown or with_shard(tree, 1 + max(n for region in tree.values() for rack in region.values() for n in rack))
    utf8 = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(utf8).cast("long") + 1).alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("key").alias("law"))
    return numbered(place(place(rows, "doc_id", tree), "doc_id", grown, "grown_shard"), "shard")
