"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample, with about the square root of the
table's rows as leaves (``MOST_LEAVES`` at most); every row goes to a leaf.  A
query visits leaves best-bin-first: a priority queue holds tree nodes by how
far their centre is from the query (Muja & Lowe, 2014).  How many leaves are
visited is calibrated: for a block of calibration queries the true neighbours
are found by brute force over all rows, and the visits are widened until what
is searched holds ``RECALL`` of them; that is above the 0.9 that is promised by
four standard errors of the block.

Leaves that are next to each other in the tree share a bin of bounded size, and
a visited leaf's whole bin is searched, so a query's vector travels once to a
bin.  Rows and queries meet by bin.  A leaf with more rows than a bin, or a bin
with many queries, is split into pieces and the pairs of pieces are dealt out,
so no task holds more than ``MOST_ROWS`` rows and ``QUERIES_AT_ONCE`` queries,
and equal vectors are first cut to the ``k + 1`` smallest ids, which are all
that any result can name.

Where vectors have no structure to prune by (independent components), no tree
reaches the recall without searching a fixed share of the rows; the calibration
then says so by widening the visits, and the work is that of blockwise brute
force.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or that hold null or non-finite components take no part as rows or
queries; equal similarities go to the smaller id; rows with a repeated id are
one candidate for each vector; fewer than ``k`` rows give all there are; other
columns may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows that the tree is fitted on, about.
SAMPLE = 16_384
BRANCHES = 16
MOST_LEAVES = 1024
CALIBRATION = 128
RECALL = 0.94
#: Rows of a bin: a sixteenth of the table within these.
LEAST_ROWS, MOST_ROWS = 1024, 8192
QUERIES_AT_ONCE = 2048


class Tree:
    """``centres`` and ``children`` of nodes; node 0 is the root, a leaf has no children."""

    def __init__(self, x: np.ndarray, leaf: int, branches: int = BRANCHES):
        self.centres, self.children = [x.mean(axis=0) if len(x) else np.zeros(1)], [[]]
        rng, todo = np.random.default_rng(0), [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            if len(rows) <= leaf or depth >= 12:
                continue
            own = x[rows]
            c = own[rng.choice(len(rows), max(2, min(branches, round(len(rows) / leaf))), replace=False)]
            at = None
            for _ in range(12):
                new = (own @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
                if at is not None and (new == at).all():
                    break
                at = new
                c = np.array([own[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
            groups = [g for i in range(len(c)) if len(g := np.flatnonzero(at == i))]
            if len(groups) < 2:
                continue
            for g in groups:
                self.centres.append(own[g].mean(axis=0))
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, rows[g], depth + 1))
        self.centres = np.array(self.centres)
        self.half = 0.5 * (self.centres**2).sum(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every level."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = node
                continue
            own = np.array(self.children[node])
            best = (x[rows] @ self.centres[own].T - self.half[own]).argmax(axis=1)
            todo += [(own[i], rows[best == i]) for i in np.unique(best)]
        return out

    def leaves(self) -> list[int]:
        """All leaves, those of one subtree together."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += self.children[node]
            else:
                out.append(node)
        return out

    def visits(self, q: np.ndarray):
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            own = np.array(self.children[node])
            for d, i in zip((self.half[own] - self.centres[own] @ q).tolist(), own.tolist(), strict=True):
                heapq.heappush(queue, (d, i))


def unit(v: np.ndarray) -> np.ndarray:
    """Unit rows; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def stacked(column, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.ChunkedArray)) else pa.array(column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(v.isNotNull() & F.col(key).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).alias("id"), v.cast("array<double>").alias("v"))


def top(q: np.ndarray, q_id: np.ndarray, r: np.ndarray, r_id: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query, row, cosine)`` of the ``k`` best rows for each query; unit rows, own ids left out."""
    out = []
    for at in range(0, len(q), 256):
        part, ids = q[at : at + 256], q_id[at : at + 256]
        like = part @ r.T
        like[ids[:, None] == r_id[None, :]] = -np.inf
        edges = np.partition(like, len(r) - k, axis=1)[:, len(r) - k] if len(r) > k else np.full(len(part), -2.0)
        for i in range(len(part)):
            near = np.flatnonzero(like[i] >= max(edges[i] - 1e-9, -2))
            exact = (part[i] * r[near]).sum(axis=1)  # the same order of additions for equal vectors
            for j in np.lexsort((r_id[near], -exact))[:k]:
                out.append((int(ids[i]), int(r_id[near[j]]), float(exact[j])))
    return out


def bins_of(leaves: list[int], size: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """``(leaf to bin, bin to rows)``: leaves in order, as many to a bin as it has room for; a leaf that is larger has a bin of its own."""
    of, rows, at, held = {}, {}, 0, 0
    for leaf in leaves:
        n = size.get(leaf, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        held += n
        of[leaf], rows[at] = at, held
    return of, rows


def search(rows: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` rows of largest cosine found for each query, best first.

    Both tables have ``id`` and ``v`` as :func:`usable` gives them; rows with the
    query's own id are no candidates.
    """
    spark = rows.sparkSession
    same = Window.partitionBy("v").orderBy("id")
    kept = cut(rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v"))
    total = kept.count()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not total:
        return empty
    most = 1 << 30
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))
    sampled = kept.where(draw("tree") <= int(min(1.0, SAMPLE / total) * most)).limit(2 * SAMPLE).toArrow()
    sampled = (sampled if sampled.num_rows else kept.limit(1).toArrow()).sort_by("id").column(1).combine_chunks()
    lengths = np.diff(sampled.offsets.to_numpy())
    width = Counter(lengths.tolist()).most_common(1)[0][0]
    x = unit(stacked(sampled.filter(pa.array(lengths == width)), width))
    tree = Tree(x, max(8, round(len(x) / min(MOST_LEAVES, total**0.5))))
    shared = spark.sparkContext.broadcast(tree)
    kept, queries = kept.where(F.size("v") == width), cut(queries.where(F.size("v") == width).distinct())

    def to_leaf(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(unit(stacked(batch.column(1), width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    leafed = cut(kept.select("id", "v").mapInArrow(to_leaf, "id long, v array<double>, leaf int"))
    n_queries = queries.count()
    if not n_queries:
        return empty
    # leaves are bounded by the sample, bins by the leaves
    size = {r[0]: r[1] for r in leafed.groupBy("leaf").count().collect()}
    room = min(MOST_ROWS, max(LEAST_ROWS, -(-total // 16)))
    bin_of, bin_rows = bins_of(tree.leaves(), size, room)
    # a bounded block of calibration queries against all rows
    probe = queries.where(draw("calibrate") <= int(min(1.0, CALIBRATION / n_queries) * most)).limit(4 * CALIBRATION).collect() or queries.limit(1).collect()
    p_id, p = np.array([r[0] for r in probe]), unit(np.array([r[1] for r in probe]))
    block = spark.sparkContext.broadcast((p_id, p))

    def brute(batches):
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                got = top(block.value[1], block.value[0], unit(stacked(batch.column(1), width)), ids, k)
                of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                yield pa.RecordBatch.from_pylist([{"q": a, "score": s, "id": b, "leaf": of[b]} for a, b, s in got], schema=pa.schema([("q", pa.int64()), ("score", pa.float64()), ("id", pa.int64()), ("leaf", pa.int32())]))

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    truth: dict[int, list[int]] = {}
    for q, leaf in leafed.mapInArrow(brute, "q long, score double, id long, leaf int").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "leaf").collect():
        truth.setdefault(q, []).append(bin_of[leaf])
    depth = []
    for q, v in zip(p_id.tolist(), p, strict=True):
        first: dict[int, int] = {}
        for i, leaf in enumerate(tree.visits(v)):
            first.setdefault(bin_of[leaf], i)
        depth += [first[b] for b in truth.get(q, ())]
    visits = int(np.quantile(depth, recall, method="inverted_cdf")) + 1 if depth else 1

    def to_bins(batches):
        for batch in batches:
            at, out = [], []
            for i, v in enumerate(unit(stacked(batch.column(1), width)) if batch.num_rows else ()):
                held, seen = 0, set()
                for n, leaf in enumerate(shared.value.visits(v)):
                    if n >= visits and held > k:
                        break
                    if (b := bin_of[leaf]) not in seen:
                        seen.add(b)
                        held += bin_rows[b]
                at += [i] * len(seen)
                out += sorted(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), batch.column(1).take(pa.array(at, pa.int32())), pa.array(out, pa.int32())], names=["q", "v", "bin"])

    asked = cut(queries.select("id", "v").repartition("id").mapInArrow(to_bins, "q long, v array<double>, bin int"))
    queried = {r[0]: r[1] for r in asked.groupBy("bin").count().collect()}
    load = spark.createDataFrame([(leaf, b, max(1, -(-bin_rows[b] // room)), -(-queried.get(b, 0) // QUERIES_AT_ONCE)) for leaf, b in bin_of.items()], "leaf int, bin int, rc int, qc int").where("qc > 0")
    of_bin = F.broadcast(load.select("bin", "rc", "qc").distinct())
    piece = lambda key, n: F.pmod(F.xxhash64(F.col(key), F.lit("piece")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(of_bin, "bin").withColumn("i", piece("q", "qc")).withColumn("j", every("rc")).select("bin", "i", "j", "q", "v")
    right = leafed.join(F.broadcast(load), "leaf").withColumn("j", piece("id", "rc")).withColumn("i", every("qc")).select("bin", "i", "j", "id", "v")
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got = top(unit(stacked(a["v"].combine_chunks(), width)), a["q"].to_numpy(), unit(stacked(b["v"].combine_chunks(), width)), b["id"].to_numpy(), k) if len(a) and len(b) else []
        return pa.table([pa.array([x[c] for x in got], t) for c, t in enumerate(schema.types)], schema=schema)

    by = ["bin", "i", "j"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


QUERIES = {"op6_ann": op6_ann}
ORACLE_SQL: dict[str, str] = {}
