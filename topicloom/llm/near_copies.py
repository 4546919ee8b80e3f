"""Near copies: SimHash groups over five-word shingles, completed to a similarity of 0.8.

Texts are linked as in ``simhash``, over shingles of five words: fingerprints
within three differing bits.  Most pairs whose sets of shingles have a Jaccard
similarity of 0.8 differ by four to eleven of 64 bits, though, where a
pigeonhole over 64 bits proposes a fixed share of all pairs.  Such pairs are
proposed by bands of least hashes instead, and linked if the similarity of the
whole sets is 0.8 or more.  With 32 bands of five hashes a pair at 0.8 meets in
no band with a probability of 3e-6, a pair at 0.9 of 5e-13.  Texts of equal
sets are one node, so exact copies cost nothing.

Defined cases: as in ``simhash``; texts without words have the empty set and
are copies of each other; fewer words than a shingle give one shingle; texts of
any length are read whole; columns other than ``doc_id`` and ``text`` may have
any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .components import connected_components
from .hot_groups import hot_links, small_links
from .simhash import bits_of, least_of_each, near_links

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
RADIUS = 3
#: Members of one bucket that are compared in one piece.
BLOCK = 1024

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, n)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(text, width))


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band, equal where the least hashes of the band are; none for the empty set."""
    if not len(own):
        return []
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, ((x[None, at : at + 1024] ^ _XOR) * _TIMES).min(axis=1))
    raw = least.tobytes()
    step = 4 * ROWS
    return [xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)]


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fp, keys`` for each row: the id of its set, its fingerprint and the keys of its bands."""

    def make():
        def work(ids, texts):
            all_ = [shingle_hashes(t) for t in texts]
            fp = np.fromiter(map(bits_of, all_), np.uint64, len(all_)).view(np.int64)
            sets = list(map(np.unique, all_))
            node = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
            keys = [band_keys(s) for s in sets]
            flat = np.fromiter((k for x in keys for k in x), np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.array(node), pa.array(fp), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "node", "fp", "keys"])

        return work

    return map_texts(docs, make, "doc_id long, node long, fp long, keys array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """``node, own``: the set of each row as the bytes of its sorted hashes."""

    def make():
        def work(_, texts):
            sets = [shingles(t) for t in texts]
            node = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

        return work

    return map_texts(docs, make, "node long, own binary")


#: Cells of the matrix in which a bucket's sets are compared all at once.
CELLS = 1 << 24


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs at ``similarity`` or more that connect whatever all such pairs connect."""
    size = np.array([len(s) for s in sets])
    at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    # what only one set holds is in no intersection
    common = n[at] > 1
    row, column = np.repeat(np.arange(len(sets)), size)[common], (np.cumsum(n > 1) - 1)[at[common]]
    width = int((n > 1).sum())
    if len(sets) * width <= CELLS:
        x = np.zeros((len(sets), width), np.float32)
        x[row, column] = 1
        both = np.rint(x @ x.T)
        near = both >= similarity * (size[:, None] + size[None] - both) - 1e-9

        def neighbours(i: int, left: np.ndarray) -> np.ndarray:
            return left[near[i, left]]
    else:
        parts = np.split(at, np.cumsum(size)[:-1])
        marked = np.zeros(len(n), bool)

        def neighbours(i: int, left: np.ndarray) -> np.ndarray:
            # sets of sizes that differ more can't be that similar
            fit = left[np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i]) - 1e-9]
            if not len(fit):
                return fit
            marked[parts[i]] = True
            both = np.add.reduceat(marked[np.concatenate([parts[j] for j in fit])], np.r_[0, np.cumsum(size[fit])[:-1]], dtype=np.int64)
            marked[parts[i]] = False
            return fit[both >= similarity * (size[fit] + size[i] - both) - 1e-9]

    out, left = [], np.arange(len(sets))
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            i = edge.pop()
            found = neighbours(i, left)
            out.extend((i, j) for j in found)
            edge.extend(found)
            left = left[~np.isin(left, found, assume_unique=True)] if len(found) else left
    return out


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``."""
    marked = cut(marks(docs))
    # one set has one fingerprint, but for repeated shingles: any of them links it
    nodes = cut(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")))
    met = nodes.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    # buckets of the same members, as near copies have in many bands, are compared once
    buckets = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.sum(F.xxhash64("node", F.lit(3)).cast("decimal(38,0)")).alias("m2")).where("n > 1")
    kept = buckets.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key", (F.col("n") > block).alias("hot"))
    members = cut(met.join(kept, "key").select("key", "hot", "node"))
    # the sets of those that meet others, from one row for each id
    ids = cut(members.select("node").distinct().join(nodes.groupBy("node").agg(F.min("least").alias("least")), "node"))
    own = docs.join(ids.select(F.col("least").alias("_id")).distinct(), docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")
    sets = sets_of(own).join(ids.select("node"), "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))

    def links(nodes, owns):
        return [(nodes[a], nodes[b]) for a, b in similar_links([np.frombuffer(x, np.uint64) for x in owns], similarity)]

    found = small_links(members.where("not hot").join(sets, "node"), links)
    hot = members.where("hot")
    hub = lambda c, kind: F.xxhash64(c, F.lit(kind))
    if not hot.isEmpty():
        # large buckets of different bands that share members make one group, in which each set is compared once
        group = connected_components(hot.select(F.col("node").alias("u"), hub("key", "bucket").alias("v")))
        whole = hot.select("node").distinct().join(group, "node").join(sets, "node").select(F.col("root").alias("key"), "node", "own")
        found = found.unionAll(hot_links(whole, links, block))
    # fingerprints are nodes of their own, beside the sets that have them
    near = cut(near_links(nodes.select("fp").distinct(), radius))
    shared = nodes.groupBy("fp").count().where("count > 1").select("fp").unionAll(near.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    found = found.unionAll(near.select(hub("u", "fingerprint").alias("u"), hub("v", "fingerprint").alias("v"))).unionAll(nodes.join(shared, "fp").select(F.col("node").alias("u"), hub("fp", "fingerprint").alias("v")))
    roots = connected_components(found.distinct())
    of = nodes.groupBy("node").agg(F.min("least").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(of.select("node", "root").join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their near copies, one of each id."""
    return least_of_each(docs, near_copies(docs, similarity))
