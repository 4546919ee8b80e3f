"""SimHash fingerprints and near-duplicate groups by generalised pigeonhole.

Fingerprints are 64 bits over word shingles.  All pairs within ``radius``
differing bits are linked without comparing all pairs: the 64 positions are
split into parts of correlated bits, every part gets its own threshold with
``sum(threshold + 1) = radius + 1`` (Qin et al., "GPH: Similarity Search in
Hamming Space", 2018), so two fingerprints within the radius agree to the
threshold in at least one part.  A dynamic programme picks the thresholds that
give the fewest estimated candidates; the plan changes cost only, never the
links that are found.

Defined cases: a null text counts as empty; texts without words have
fingerprint zero and are linked like any other; fewer words than a shingle give
one shingle; repeated rows each get a row; a null id takes part and never is
the smallest id of a group that has others; texts of any length are read whole;
columns other than ``doc_id`` and ``text`` may have any name; an empty table
gives an empty one.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, table
from .components import connected_components
from .hot_groups import hot_links

BITS = 64
#: Rows of one key that are compared in one piece.
BLOCK = 4096
#: Fingerprints that the plan is estimated on, about.
PLAN_SAMPLE = 2048


def bits_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as an unsigned number."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    return bits_of(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long, a row for each row."""

    def make():
        def work(ids, texts):
            fp = np.fromiter((simhash(x, width) for x in texts), np.uint64, len(texts)).view(np.int64)
            return pa.RecordBatch.from_arrays([ids, pa.array(fp)], names=["doc_id", "fp"])

        return work

    return map_texts(docs, make, "doc_id long, fp long")


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def plan_parts(sample: np.ndarray, rows: int, radius: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """Parts of bit positions with their thresholds, of least estimated cost.

    ``sample`` estimates how many of the ``rows`` fingerprints agree in a part;
    a uniform term keeps a part that the sample never saw agree from looking
    free.  Parts with threshold -1 aren't probed and are left out.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) if len(sample) else np.zeros((1, BITS))
    x = bits - bits.mean(axis=0)
    scale = np.sqrt((x * x).mean(axis=0)) + 1e-9
    like = np.abs(x.T @ x) / len(bits) / np.outer(scale, scale)
    pairs = rows * rows / 2
    best: tuple[float, list] = (inf, [])
    for m in range(1, most_parts + 1):
        left, parts = set(range(BITS)), []
        for k in range(m):
            size = BITS // m + (k < BITS % m)
            own = [max(sorted(left), key=lambda b: like[b, sorted(left)].sum())]
            left.discard(own[0])
            while len(own) < size:
                own.append(b := max(sorted(left), key=lambda b: like[b, own].sum()))
                left.discard(b)
            parts.append(sorted(own))
        costs = []
        for own in parts:
            key = sum(((sample >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(own)) if len(sample) else np.zeros(0, np.uint64)
            near = np.zeros(radius + 2)
            for at in range(0, len(key), 256):
                d = np.bitwise_count(key[at : at + 256, None] ^ key[None, :])
                near += np.bincount(np.minimum(d, radius + 1).ravel(), minlength=radius + 2)[: radius + 2]
            near[0] -= len(key)
            share = np.cumsum(near)[: radius + 1] / max(1, len(key) * (len(key) - 1))
            costs.append([0.0] + [pairs * max(share[t], ball(len(own), t) / 2.0 ** len(own)) + 4.0 * rows * ball(len(own), t) for t in range(radius + 1)])
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, picked) in table_.items():
                for t in range(-1, radius + 1):
                    if (u := used + t + 1) <= radius + 1 and c + cost[t + 1] < step.get(u, (inf,))[0]:
                        step[u] = (c + cost[t + 1], [*picked, t])
            table_ = step
        if radius + 1 in table_ and table_[radius + 1][0] < best[0]:
            best = (table_[radius + 1][0], [(p, t) for p, t in zip(parts, table_[radius + 1][1], strict=True) if t >= 0])
    return best[1]


def _probe_rows(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, fp``: each fingerprint at its own key and at the keys near it.

    Of two keys that differ, the one with more ones in the differing places
    goes to the other, or both meet halfway, so each pair meets at least once.
    """

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for k, (own, t) in enumerate(parts):
                key = np.zeros(len(fp), np.uint64)
                for i, b in enumerate(own):
                    key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
                out.append((k, key, fp))
                for r in range(1, t + 1):
                    for flip in combinations(range(len(own)), r):
                        mask = np.uint64(sum(1 << i for i in flip))
                        # the side with at least half of the differing places set makes the step; an even split is made by both
                        has = 2 * np.bitwise_count(key & mask) >= r
                        if has.any():
                            out.append((k, key[has] ^ mask, fp[has]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in out])), pa.array(np.concatenate([x for _, x, _ in out]).view(np.int64)), pa.array(np.concatenate([y for *_, y in out]).view(np.int64))],
                names=["part", "key", "fp"],
            )

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long")


def spanning_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius that connect whatever all such links connect, at most ``len(fp) - 1``."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            at = edge.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            edge.extend(found)
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _verify(radius: int):
    """Over rows sorted by group: the verified links of each, as a spanning set in large groups."""

    def links(group: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(group)])
        of = np.repeat(size, size)
        small = np.flatnonzero(of <= 32)
        g, f, n = group[small], fp[small], of[small]
        for d in range(1, int(n.max(initial=1))):
            i = np.flatnonzero((g[d:] == g[:-d]) & (n[d:] > d))
            near = np.bitwise_count(f[i] ^ f[i + d]) <= radius
            yield f[i[near]], f[i[near] + d]
        for s, c in zip(start[size > 32], size[size > 32], strict=True):
            own = np.unique(fp[s : s + c])
            a, b = spanning_links(own, radius)
            yield own[a], own[b]

    def run(batches):
        held: list[np.ndarray] = []
        kept: list[np.ndarray] = []

        def out(group, fp):
            found = [x for x in links(group, fp) if len(x[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

        ends = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            new = np.r_[ends is None or any(c[0] != e for c, e in zip(cols, ends, strict=True)), np.logical_or.reduce([c[1:] != c[:-1] for c in cols])] if len(fp) > 1 else np.array([ends is None or any(c[0] != e for c, e in zip(cols, ends, strict=True))])
            ends = [c[-1] for c in cols]
            group = np.cumsum(new) + (held[-1][-1] if held else 0)
            held.append(group)
            kept.append(fp)
            last = group[-1]
            if group[0] != last or (len(held) > 1 and held[0][0] != last):
                group, fp = np.concatenate(held), np.concatenate(kept)
                done = group != last
                yield from out(group[done], fp[done])
                held, kept = [group[~done]], [fp[~done]]
        if held:
            yield from out(np.concatenate(held), np.concatenate(kept))

    return run


def near_links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` of distinct fingerprints that connect all pairs within ``radius``.

    ``fps`` has one row for each fingerprint (column ``fp``).  Keys with more
    than ``block`` rows are dealt out in blocks as ``hot_groups`` says.
    """
    rows = fps.count()
    share = min(1.0, PLAN_SAMPLE / max(1, rows))
    sample = [x[0] for x in fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(2 * PLAN_SAMPLE).collect()]
    parts = plan_parts(np.sort(np.array(sample, np.int64)).view(np.uint64), rows, radius)
    probes = _probe_rows(fps, parts)
    hot = cut(probes.groupBy("part", "key").count().where(F.col("count") > block).select("part", "key"))
    by = ["part", "key"]
    cold = probes if hot.isEmpty() else probes.join(hot, by, "left_anti")
    found = cold.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify(radius), "u long, v long")
    if not hot.isEmpty():

        def links(nodes, _):
            own = np.array(nodes, np.int64)
            a, b = spanning_links(own.view(np.uint64), radius)
            return zip(own[a].tolist(), own[b].tolist(), strict=True)

        # groups of equal hashes are compared together, which finds no other links
        members = probes.join(hot, by, "left_semi").select(F.xxhash64(*by).alias("key"), F.col("fp").alias("node"), F.lit(None).cast("binary").alias("own")).distinct()
        found = found.unionAll(hot_links(members, links, block))
    return found.distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    marked = cut(fingerprints(docs, width))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(fps, radius))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(of.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, one of each id."""
    return least_of_each(docs, near_duplicates(docs, radius, width))


def least_of_each(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is its ``component_id`` in ``marked``, one of each id.

    Texts are joined with the ids of the rows that go, which is what is left
    out, and among rows of one kept id the first by text and other columns
    stays.  Rows without an id are kept once for each group without any id.
    """
    keep = cut(marked.where("doc_id <=> component_id").select("doc_id").distinct())
    out = docs.join(keep, docs.doc_id.eqNullSafe(keep.doc_id), "left_semi")
    twice = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return out
    again = docs.doc_id.eqNullSafe(twice.doc_id)
    order = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    first = out.join(twice, again, "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return out.join(twice, again, "left_anti").unionByName(first)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
