"""Placement of documents by a hierarchical weighted hash tree.

A document descends the tree of regions, racks and shards.  At each node every
child draws an exponential variate of the rate of its subtree's weight from a
hash of the document id and its own name, and the least draw is taken (weighted
rendezvous hashing at each level).  Only the children of nodes on the way are
hashed.  If a weight changes, the draws of that leaf and of the nodes above it
change and no others, so at each level rows move only into or out of the
subtree that holds it.  A shard that :func:`grow` adds is a region of its own,
so no other draw changes and it takes rows only into itself.

The law is ``key``: the document id and the tree alone decide the shard.
Slots are gapless within a shard: rows are numbered within hash blocks of the
shard, behind the rows of the blocks before, so no task sorts a whole shard.
Rows that are equal in all that is returned are counted, not sorted, and dealt
out again by number, so copies of one row don't meet in one task either.

Defined cases: a null text counts as empty (size 16, CRC 0); texts of any
length are measured whole; rows with the same or no id share a shard and get
slots of their own; equal rows get different slots in either order; columns
other than ``doc_id`` and ``text`` may have any name; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Hash blocks of a shard that its rows are numbered in.
BLOCKS = 256
#: Equal rows that one task deals out.
DEALT = 100_000


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards dealt over regions and racks."""
    return [Leaf(s % regions, s // regions % racks, s) for s in range(shards)]


def grow(tree: list[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, 0, shard, weight)]


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential variate of rate ``weight``, from the hash of a key and a node's name."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(unit) / F.lit(float(weight))


def _level(key: Column, children: dict[str, tuple[float, Callable[[], Column]]]) -> Column:
    """What lies below the child of the least draw; other children's subtrees aren't evaluated."""
    if len(children) == 1:
        return next(iter(children.values()))[1]()
    picked = F.array_min(F.array(*(F.struct(draw(key, name, w).alias("draw"), F.lit(i).alias("i")) for i, (name, (w, _)) in enumerate(children.items()))))["i"]
    out = None
    for i, (_, below) in enumerate(children.values()):
        out = F.when(picked == i, below()) if out is None else out.when(picked == i, below())
    return out


def descend(key: Column, tree: list[Leaf]) -> Column:
    """``struct(region, rack, shard)`` that a key comes to."""
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for x in tree:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    weight = lambda leaves: sum(x.weight for x in leaves)

    def leaf(x: Leaf) -> Column:
        return F.struct(F.lit(x.region).alias("region"), F.lit(x.rack).alias("rack"), F.lit(x.shard).alias("shard"))

    def rack(leaves: list[Leaf]) -> Column:
        return _level(key, {f"shard-{x.shard}": (x.weight, lambda x=x: leaf(x)) for x in leaves})

    def region(r: int, racks: dict[int, list[Leaf]]) -> Column:
        return _level(key, {f"rack-{r}-{k}": (weight(v), lambda v=v: rack(v)) for k, v in racks.items()})

    return _level(key, {f"region-{r}": (sum(map(weight, v.values())), lambda r=r, v=v: region(r, v)) for r, v in regions.items()})


def place(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, region, rack, shard, slot, grown_shard`` for each row."""
    text, row = F.coalesce("text", F.lit("")), ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")).groupBy(*row).agg(F.count("*").alias("n"))
    at = rows.select(*row, "n", descend(_key(F.col("doc_id")), tree).alias("at"), (descend(_key(F.col("doc_id")), grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"))
    block = F.pmod(F.xxhash64(_key(F.col("doc_id")), "size", "text_crc32"), F.lit(BLOCKS)).cast("int")
    placed = cut(at.select(*row, "n", "at.region", "at.rack", "at.shard", "grown_shard", block.alias("block")))
    # at most shards x BLOCKS rows
    before = placed.groupBy("shard", "block").agg(F.sum("n").alias("held"))
    before = before.select("shard", "block", (F.sum("held").over(Window.partitionBy("shard").orderBy("block")) - F.col("held")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("shard", "block").orderBy(*row).rowsBetween(Window.unboundedPreceding, 0))
    first = placed.withColumn("own", upto - F.col("n")).join(F.broadcast(before), ["shard", "block"]).withColumn("slot", F.col("before") + F.col("own"))
    one, many = first.where("n = 1"), first.where("n > 1")
    pieces = many.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DEALT)))).repartition(*row, "p")
    dealt = pieces.withColumn("j", F.explode(F.sequence(F.col("p") * DEALT, F.least(F.col("n"), (F.col("p") + 1) * DEALT) - 1))).withColumn("slot", F.col("slot") + F.col("j"))
    names = [*row, "region", "rack", "shard", "slot", "grown_shard"]
    return one.select(*names).unionAll(dealt.select(*names))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(40)
    placed = place(table(spark, sf_dir, "documents"), tree, grow(tree, 40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}
