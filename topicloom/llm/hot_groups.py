"""Links within groups that are too large for one task.

A group's members are dealt out to blocks, and its leader, the member of the
smallest id, joins every block.  Each block is compared in full, so whatever
hangs together with the leader is one component without comparing blocks with
each other.  Members that don't are few where a group consists of near copies;
they, and they alone, then meet every block of their group.  All links that
connect members are found, and rows are multiplied only by the number of
blocks that the unconnected members fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Gives pairs of ids that connect whatever all links among the ids and their payloads connect.
Links = Callable[[list, list], Iterable[tuple[int, int]]]


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["u", "v", "key"])


def _grouped(keys: int, work: Callable[[tuple, dict], list[tuple]]):
    """Calls ``work(group, members)`` for each run of equal leading ``keys`` columns; a row is those, ``node`` and ``own``."""

    def run(batches):
        group, members = None, {}
        for batch in batches:
            found = []
            for *at, node, own in zip(*(batch.column(k).to_pylist() for k in range(keys + 2)), strict=True):
                if at != group:
                    if group is not None:
                        found += work(tuple(group), members)
                    group, members = at, {}
                members[node] = own
            yield _batch(found)
        if group is not None:
            yield _batch(work(tuple(group), members))

    return run


def _apart(ids: Iterable[int], links: list[tuple[int, int]], leader: int) -> list[int]:
    """The ids that links don't connect with the leader."""
    parent = {i: i for i in ids}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    top = find(leader)
    return [i for i in parent if find(i) != top]


def small_links(members: DataFrame, links: Links) -> DataFrame:
    """``u, v`` over ``key, node, own`` whose groups fit a task."""

    def work(_, own):
        return [(a, b, None) for a, b in links(list(own), list(own.values()))] if len(own) > 1 else []

    rows = members.select("key", "node", "own").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_grouped(1, work), "u long, v long, key long").select("u", "v")


def hot_links(members: DataFrame, links: Links, block: int) -> DataFrame:
    """``u, v`` over ``key, node, own``, groups of any size; materialised in part."""

    def piece(n: Column) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(11)), n).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = cut(members)
    size = cut(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"), F.min("node").alias("lead")))
    own = members.join(size, "key")
    blocks = own.where("node <> lead").withColumn("at", piece(F.col("pieces"))).unionByName(own.where("node = lead").withColumn("at", every(F.col("pieces"))))

    def first(group, own):
        found = list(links(list(own), list(own.values()))) if len(own) > 1 else []
        return [(a, b, None) for a, b in found] + [(i, None, group[0]) for i in _apart(own, found, group[2])]

    by = ["key", "at", "lead"]
    met = blocks.select(*by, "node", "own").repartition("key", "at").sortWithinPartitions(*by)
    met = cut(met.mapInArrow(_grouped(3, first), "u long, v long, key long"))
    done = met.where("v is not null").select("u", "v")
    apart = met.where("v is null").select("key", F.col("u").alias("node"))
    parts = cut(apart.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    if parts.isEmpty():
        return done
    own = own.join(parts, "key")
    left = own.join(apart, ["key", "node"], "left_semi").withColumn("i", piece(F.col("parts"))).withColumn("j", every(F.col("pieces")))
    right = own.withColumn("j", piece(F.col("pieces"))).withColumn("i", every(F.col("parts")))

    def second(_, own):
        return [(a, b, None) for a, b in links(list(own), list(own.values()))] if len(own) > 1 else []

    by = ["key", "i", "j"]
    rest = left.unionByName(right).select(*by, "node", "own").repartition(*by).sortWithinPartitions(*by)
    return done.unionAll(rest.mapInArrow(_grouped(3, second), "u long, v long, key long").select("u", "v"))
