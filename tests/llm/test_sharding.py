"""The hash tree level by level against brute force, and the slots."""

import math
import zlib

import pytest
import xxhash

from topicloom.llm import sharding

SCHEMA = "doc_id long, text string, shard int, slot string, n int"


def draw(i, name, weight):
    h = xxhash.xxh64_intdigest(("" if i is None else str(i)).encode(), xxhash.xxh64_intdigest(name.encode(), 42))
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def descend(i, tree):
    """Region, then a rack of it, then a shard of that, each by the least draw of its own name."""
    weight = lambda keep: sum(x.weight for x in tree if keep(x))
    least = lambda nodes: min(nodes)[1]
    r = least((draw(i, f"region-{r}", weight(lambda x: x.region == r)), r) for r in {x.region for x in tree})
    k = least((draw(i, f"rack-{r}-{k}", weight(lambda x: (x.region, x.rack) == (r, k))), k) for k in {x.rack for x in tree if x.region == r})
    return r, k, least((draw(i, f"shard-{x.shard}", x.weight), x.shard) for x in tree if (x.region, x.rack) == (r, k))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def test_every_level_matches_brute_force(spark):
    rows = [(i, f"t{i}" * (i % 7)) for i in range(400)] + [(None, None), (3, "again"), (3, "again"), (7, "é" * 50_000)]
    tree = [x._replace(weight=1.0 + x.shard % 3) for x in sharding.even_tree(40)]
    grown = sharding.grow(tree, 40, 3.0)
    got = sharding.place(table(spark, rows), tree, grown).collect()
    for r in got:
        assert (r.region, r.rack, r.shard) == descend(r.doc_id, tree)
        assert r.grown_shard == descend(r.doc_id, grown)[2] and r.grown_shard in (r.shard, 40)
    assert sum(r.grown_shard == 40 for r in got) > 0
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


@pytest.mark.parametrize("shard", [5, 12])
def test_a_changed_weight_moves_rows_in_its_subtrees_only(shard):
    tree = sharding.even_tree(16, 4, 2)
    heavier = [x._replace(weight=3.0) if x.shard == shard else x for x in tree]
    own, moved = next(x for x in tree if x.shard == shard), 0
    for i in range(3000):
        a, b = descend(i, tree), descend(i, heavier)
        if a != b:
            moved += 1
            # across regions only into its region, within it only into its rack, within that only into it
            assert b[0] == own.region and (a[0] != b[0] or b[1] == own.rack and (a[1] != b[1] or b[2] == shard))
    assert 0 < moved < 1500


def test_rows_without_id_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DEALT", 7)
    rows = [(None, f"t{i}") for i in range(300)] + [(9, "same")] * 100 + [(None, None)] * 50
    got = sharding.place(table(spark, rows), sharding.even_tree(40)).collect()
    assert len(got) == 450 and len({r.shard for r in got if r.doc_id is None}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard is None for r in got)
    assert sharding.place(table(spark, []), sharding.even_tree(40)).count() == 0


def test_query(spark):
    got = sharding.op8_sharding(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert {r.law for r in rows} == {"key"} and all(r.grown_shard in (r.shard, 40) for r in rows) and {r.shard for r in rows} <= set(range(40))
