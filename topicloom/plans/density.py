"""Clustering with a number of clusters that the data decide.

Rows stay in DataFrames.  Matrices that a tier bounds are broadcast and swept
by parallel tasks; beyond the medium tier, rows are sharded by coarse k-means
and each shard is searched in a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as N
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import corpus as P
from ..operators import tuning
from ..operators.profile import Profile, dataset_profile
from ..operators.quantiles import percentiles
from ..shared import cut
from . import search

NO_UMAP = "umap-unavailable, used PCA-only fallback"


@dataclass
class Report:
    """How a result came about; ``to_dict`` is safe for JSON."""

    n: int = 0
    k: int = 0
    tier: str = ""
    band: str = ""
    algorithm: str = ""
    confidence: str = "high"
    seed: int = 42
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    profile: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def warn(self, text: str, low: bool = False) -> None:
        if text not in self.warnings:
            self.warnings.append(text)
        if low:
            self.confidence = "low"

    def to_dict(self) -> dict:
        def plain(x):
            if isinstance(x, dict):
                return {str(k): plain(v) for k, v in x.items()}
            if isinstance(x, (list, tuple, set, np.ndarray)):
                return [plain(v) for v in x]
            if isinstance(x, (bool, np.bool_)):
                return bool(x)
            if isinstance(x, (int, np.integer)):
                return int(x)
            if isinstance(x, (float, np.floating)):
                return float(x) if np.isfinite(x) else None
            return x if x is None or isinstance(x, str) else str(x)

        return plain(self.__dict__)


def _matrix(rows: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and vectors in id order, of at most the medium tier's size."""
    got = rows.select("row_id", "v").orderBy("row_id").toPandas()
    return got["row_id"].tolist(), np.stack(got["v"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))


def _labelled(rows: DataFrame, ids: list, labels: np.ndarray) -> DataFrame:
    table = rows.sparkSession.createDataFrame(pd.DataFrame({"row_id": ids, "cluster_id": np.asarray(labels, np.int32)}), "row_id long, cluster_id int")
    return rows.join(F.broadcast(table), "row_id")


def _sweep_in_tasks(rows: DataFrame, x: np.ndarray, grid: list[tuple[int, int]], sizes: list[int], boost: float, methods=tuning.METHODS) -> list[dict]:
    """Sweeps ``(width, neighbours)`` pairs, a task each."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(x.astype(np.float32))

    def run(frames):
        for frame in frames:
            out = []
            for dim, neighbours in zip(frame["dim"], frame["neighbours"], strict=True):
                full = N.unit_rows(shared.value)
                y = N.unit_rows(N.pca(full, dim)) if dim < full.shape[1] else full
                for c in search.sweep(y, full, sizes, neighbours, boost, methods):
                    out.append({**c, "labels": c["labels"].tolist()})
            yield pd.DataFrame(out, columns=["score", "k", "separation", "noise", "largest", "stability", "labels", "mcs", "min_samples", "method", "dim"])

    tasks = spark.createDataFrame(grid, "dim int, neighbours int").repartition(len(grid), "dim", "neighbours")
    schema = "score double, k int, separation double, noise double, largest double, stability double, labels array<int>, mcs int, min_samples int, method string, dim int"
    found = [r.asDict() for r in tasks.mapInPandas(run, schema).collect()]
    return sorted(found, key=lambda c: (-c["score"], c["k"], c["mcs"], c["min_samples"], c["method"], c["dim"]))


def recover(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Noise rows that are near enough to one cluster, and clearly nearer than to the next, join it."""
    labels, names = labels.copy(), np.unique(labels[labels >= 0])
    noise = np.flatnonzero(labels < 0)
    if not len(names) or not len(noise):
        return labels
    c = N.unit_rows(np.array([x[labels == k].mean(axis=0) for k in names]))
    reach = np.array([max(1.5 * float((1 - x[labels == k] @ m).max()), 0.40) for k, m in zip(names, c, strict=True)])
    s = x[noise] @ c.T
    best = s.argmax(axis=1)
    top = s[np.arange(len(s)), best]
    s[np.arange(len(s)), best] = -np.inf
    ok = (1 - top <= reach[best]) & ((len(names) < 2) | (top - s.max(axis=1) > 0.01))
    labels[noise[ok]] = names[best[ok]]
    return labels


def merge(x: np.ndarray, labels: np.ndarray, limit: float | None) -> np.ndarray:
    """Merges clusters with similar centroids to a fixed point; without a limit once, at the near-duplicate limit."""
    labels = labels.copy()
    while True:
        names = np.unique(labels[labels >= 0])
        if len(names) < 2:
            return labels
        c = N.unit_rows(np.array([x[labels == k].mean(axis=0) for k in names]))
        i, j = np.triu_indices(len(names), 1)
        s = (c @ c.T)[i, j]
        close = np.flatnonzero(s >= (max(0.88, s.mean() + 0.03) if limit is None else limit))
        for e in close:
            a, b = sorted((names[i[e]], names[j[e]]))
            labels[labels == b] = a
            names[names == b] = a
        if not len(close) or limit is None:
            return labels


def compact(labels: np.ndarray) -> np.ndarray:
    names = np.unique(labels[labels >= 0])
    return np.where(labels >= 0, np.searchsorted(names, labels), -1).astype(np.int32)


def _polish(x: np.ndarray, labels: np.ndarray, limit: float) -> np.ndarray:
    return compact(merge(x, recover(x, merge(x, recover(x, labels), None)), limit))


def _bounded(rows: DataFrame, config: tuning.Config, tier: str, band: str, profile: Profile, report: Report) -> DataFrame:
    ids, raw = _matrix(rows)
    x = N.unit_rows(raw)
    n, preset = len(x), config.cluster_granularity
    g = tuning.GRANULARITY[preset]
    sizes = [config.min_cluster_size] if config.min_cluster_size else tuning.cluster_size_spread(preset, band, n)
    if tier == "small" and band == "low" and preset == "balanced":
        sizes = [s for s in sizes if s <= 1.8 * tuning.least_cluster_size(preset, band, n)] or sizes[:1]
    neighbours = [config.min_samples] if config.min_samples else tuning.MIN_SAMPLES[tier]
    report.warn(NO_UMAP)
    boost = g[band].fragmentation if tier == "small" and band != "low" else 0.0
    if tier == "small":
        dims = [x.shape[1]] if band == "low" else sorted({min(t, x.shape[1]) for t in tuning.PCA_TARGETS["small"][band]})
    else:
        dims = tuning.width_candidates(tuning.medium_width(profile), x.shape[1])
    methods = tuning.METHODS
    if tier == "medium":
        sizes, neighbours, methods = tuning.direct_caps(n, profile.density_cv, sizes, neighbours)
    found = _sweep_in_tasks(rows, x, [(d, m) for d in dims for m in neighbours], sizes, boost, methods)
    best = found[0] if found else None
    if best and (best["score"] < 0.38 or best["noise"] > 0.35 or tier == "small" and tuning.blob(best["largest"], best["k"], best["separation"], best["stability"])):
        more = tuning.size_candidates([s * best["mcs"] for s in ((0.75, 1.35) if tier == "small" else (0.7, 1.3))], n // 3)
        near = [best["min_samples"]] if tier == "small" else sorted({max(1, best["min_samples"] + step) for step in (-1, 0, 1)})
        found += _sweep_in_tasks(rows, x, [(best["dim"], m) for m in near], more, boost)
    limit = g["mid" if tier == "small" and band == "low" else band].merge
    done = []
    for c in search.diverse(found, n):
        own = np.array(c["labels"], np.int32)
        if tier == "small":
            own = search.split_oversized(x, own, boost, least=c["mcs"], cohesive=0.88, gain=0.0)
        else:
            own = search.split_oversized(x, own, boost, sizes=tuning.SIZE_RATIOS["small"][band])
        labels = _polish(x, own, limit)
        done.append((search.score(x, labels, boost), labels, c))
    if not done:
        return _labelled(rows, ids, np.full(n, -1))
    s, labels, c = max(done, key=lambda d: (d[0]["score"], -d[0]["k"]))
    report.metrics, report.params, report.algorithm = s, {k: c[k] for k in ("mcs", "min_samples", "method", "dim")}, "hdbscan"
    return _labelled(rows, ids, labels)


def search_shard(x: np.ndarray, preset: str, band: str, seed: int = 42) -> np.ndarray:
    """Labels of one shard; small or unclear shards fall back to one cluster, to singles or to noise.

    Up to three sizes and two neighbour counts are tried on each representation;
    the three best solutions are scored again once near noise has joined them.
    """
    n = len(x)
    if n <= 3:
        return np.arange(n, dtype=np.int32)
    sizes, found = tuning.cluster_size_spread(preset, band, n)[:3], []
    for dim in sorted({min(d, x.shape[1]) for d in tuning.PCA_TARGETS["large"][band]}):
        y = N.unit_rows(N.pca(x, dim)) if dim < x.shape[1] else x
        for m in tuning.large_min_samples(search_profile(y, seed), sizes[0])[:2]:
            found += [c for c in search.sweep(y, x, sizes, m, 0.0) if c["k"]]
    if found:
        best = sorted(found, key=lambda c: -c["score"])[:3]
        done = [(search.score(x, labels)["score"], labels) for c in best for labels in [recover(x, c["labels"])]]
        return max(done, key=lambda d: d[0])[1]
    c = N.unit_rows(x.mean(axis=0, keepdims=True))[0]
    return np.zeros(n, np.int32) if n <= 16 and float((x @ c).mean()) > 0.6 else np.full(n, -1, np.int32)


def search_profile(x: np.ndarray, seed: int) -> float:
    k = min(20, len(x) - 1)
    own = x[np.random.default_rng(seed).choice(len(x), min(512, len(x)), replace=False)]
    far = np.partition(1 - own @ x.T, k, axis=1)[:, k]
    return float(far.std() / max(far.mean(), 1e-12))


def split_shards(sharded: DataFrame, target: int, seed: int, rounds: int = 3, branches: int = 32) -> DataFrame:
    """``row_id, v, shard, piece`` from ``row_id, v, shard`` with unit vectors: shards far over the target are split by k-means, round by round.

    A shard's centres are fitted in a task of its own on a bounded sample of
    it; ``piece`` parts what stays too large after that, as equal vectors do.
    """
    spark, limit = sharded.sparkSession, 1.35 * target
    sharded = cut(sharded.select("row_id", "v", F.col("shard").cast("long").alias("shard")))
    for r in range(rounds):
        sizes = sharded.groupBy("shard").agg(F.count("*").alias("_n"))
        big = cut(sizes.where(F.col("_n") > limit))
        if big.isEmpty():
            break
        draw = F.pmod(F.xxhash64(F.col("row_id").cast("string"), F.lit(f"split-{r}")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = sharded.join(big, "shard").where(draw <= F.lit(4096.0) / F.col("_n"))

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("row_id")
            x = np.stack(frame["v"].to_numpy())
            k = int(min(branches, max(2, -(-int(frame["_n"].iloc[0]) // target)), len(x)))
            at = N.kmeans(x, k, seed, 20)[0]
            c = N.unit_rows(np.array([x[at == i].mean(axis=0) for i in np.unique(at)]))
            return pd.DataFrame({"shard": frame["shard"].iloc[0], "i": np.arange(len(c), dtype=np.int32), "c": list(c)})

        centres = cut(sample.groupBy("shard").applyInPandas(fit, "shard long, i int, c array<double>"))
        packed = centres.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
        if (centres.agg(F.sum(F.size("c"))).first()[0] or 0) * 8 <= C.BROADCAST_BYTES:
            packed = F.broadcast(packed)
        like = F.transform("cs", lambda c: V.dot(F.col("v"), c["c"]))
        best = F.coalesce(F.array_position(like, F.array_max(like)) - 1, F.lit(0))
        sharded = cut(sharded.join(packed, "shard", "left").select("row_id", "v", (F.col("shard") * branches + best).alias("shard")))
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("_n"))
    pieces = F.ceil(F.col("_n") / limit).cast("int")
    return sharded.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64(F.col("row_id").cast("string")), pieces).cast("int")).drop("_n")


def cluster_large(rows: DataFrame, config: tuning.Config, band: str, profile: Profile, report: Report) -> DataFrame:
    """Coarse k-means shards on reduced vectors, a search in each, and stitching of clusters across shards."""
    target, preset = tuning.shard_size(profile), config.cluster_granularity
    vec = cut(rows.select("row_id", V.unit(F.col("v")).alias("v"))).withColumn("_f", array_to_vector("v"))
    column, width = "_f", tuning.large_width(profile)
    if width < profile.width:
        vec, column = PCA(k=width, inputCol="_f", outputCol="_r").fit(vec).transform(vec), "_r"
    model = KMeans(k=tuning.coarse_partitions(profile), seed=config.random_state, distanceMeasure="cosine", featuresCol=column, predictionCol="shard", maxIter=10).fit(vec)
    sharded = split_shards(model.transform(vec).select("row_id", "v", "shard"), target, config.random_state)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id")
        labels = search_shard(N.unit_rows(np.stack(frame["v"].to_numpy())), preset, band)
        return pd.DataFrame({"row_id": frame["row_id"], "v": frame["v"], "shard": frame["shard"], "piece": frame["piece"], "local": labels})

    found = cut(sharded.select("row_id", "v", "shard", "piece").groupBy("shard", "piece").applyInPandas(run, "row_id long, v array<double>, shard long, piece int, local int"))
    own = found.where("local >= 0").select("shard", "piece", "local").distinct()
    number = own.withColumn("cluster_id", (F.row_number().over(Window.orderBy("shard", "piece", "local")) - 1).cast("int"))  # a row for each cluster
    labelled = cut(found.join(number, ["shard", "piece", "local"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))))
    if labelled.where("cluster_id >= 0").isEmpty():
        # no shard gave clusters
        report.warn("large-global-fallback", low=True)
        whole = KMeans(k=max(2, profile.n // 1500), seed=config.random_state, distanceMeasure="cosine", featuresCol=column, predictionCol="cluster_id", maxIter=20).fit(vec)
        labelled = whole.transform(vec).select("row_id", "v", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("piece"), "cluster_id")
    merge_at = tuning.GRANULARITY[preset][band].merge
    cents = cut(C.centroids(labelled))
    radius = percentiles(C.similarities(labelled, cents), ["cluster_id"], "sim", [0.1]).select("cluster_id", (1 - F.col("p")[0]).alias("radius"))
    shards = labelled.where("cluster_id >= 0").select("cluster_id", F.struct("shard", "piece").alias("shard")).distinct()
    pairs = C.mutual_pairs(cents.join(radius, "cluster_id").join(shards, "cluster_id"), merge_at)
    labelled = cut(C.relabel(labelled.select("row_id", "v", "cluster_id"), C.merge_roots(pairs, [r[0] for r in cents.select("cluster_id").collect()])))
    cents = cut(C.centroids(labelled))
    again = C.recover_noise(labelled, cents, C.similarities(labelled, cents)).withColumnRenamed("cluster_id", "_again")
    labelled = cut(labelled.join(again, "row_id", "left").withColumn("cluster_id", F.coalesce("_again", "cluster_id")).drop("_again"))
    labelled, _ = C.merge_by_similarity(labelled, merge_at)
    report.algorithm, report.params = "sharded hdbscan", {"shards": model.summary.k, "target": target}
    return P.compact_labels(labelled.select("row_id", "v", "cluster_id"), "cluster_id").select("row_id", "v", F.col("compact").alias("cluster_id"))


def sample_and_assign(rows: DataFrame, config: tuning.Config, n: int, report: Report) -> DataFrame:
    """Clusters a sample of ``max_samples`` rows; the others go to the nearest centroid."""
    report.warn("oversized-subsampled")
    sample = cut(P.subsample(rows, "row_id", config.max_samples, config.random_state))
    done, own = cluster_vectors(sample, {**config.__dict__, "max_samples": None}, config.max_samples)
    done = cut(done.select("row_id", "v", "cluster_id"))
    report.algorithm, report.params, report.metrics, report.profile = own.algorithm, own.params, own.metrics, own.profile
    rest = rows.select("row_id", "v").join(done.select("row_id"), "row_id", "left_anti")
    if done.where("cluster_id >= 0").isEmpty():
        return done.unionByName(rest.withColumn("cluster_id", F.lit(-1)))
    given = C.nearest_two(rest, C.centroids(done)).select("row_id", "v", F.col("best").cast("int").alias("cluster_id"))
    return done.unionByName(given)


def cluster_vectors(rows: DataFrame, options=None, n: int | None = None) -> tuple[DataFrame, Report]:
    """``row_id, v, cluster_id`` and a report, from ``row_id, v``; -1 is noise."""
    config = tuning.Config.of(options)
    n = rows.count() if n is None else n
    report = Report(n=n, seed=config.random_state)
    if not n:
        return rows.withColumn("cluster_id", F.lit(-1)), report
    width = rows.select(F.size("v")).first()[0]
    report.tier, report.band = tuning.tier(n), tuning.dim_band(width)
    if config.max_samples is not None and n > config.max_samples:
        out = sample_and_assign(rows, config, n, report)
        quality_floor(report, width)
        report.k = report.metrics.get("k", 0)
        return out, report
    profile = dataset_profile(rows, n, config.random_state)
    report.profile = dict(profile.__dict__)
    if n > 2:  # what a manifold reducer would be given
        report.profile |= {"manifold_neighbours": tuning.manifold_neighbours(n), "manifold_width": tuning.manifold_width(n, width)}
    tuning.say(config, f"{n} rows of width {width}: tier {report.tier}, band {report.band}")
    if report.tier == "tiny":
        ids, raw = _matrix(rows)
        x = N.unit_rows(raw) if config.normalize_embeddings else raw
        labels, how = search.tiny(x, config.cluster_granularity, config.random_state)
        labels = compact(merge(N.unit_rows(raw), labels, tuning.GRANULARITY[config.cluster_granularity][report.band].merge)) if n > 2 else labels
        report.algorithm, report.params, report.metrics = how["source"], how, search.score(x, labels)
        out = _labelled(rows, ids, labels)
    elif report.tier == "large":
        out = cluster_large(rows, config, report.band, profile, report)
    else:
        out = _bounded(rows, config, report.tier, report.band, profile, report)
    quality_floor(report, width)
    report.k = report.metrics.get("k", 0)
    tuning.say(config, f"{report.algorithm}: {report.k or '?'} clusters, confidence {report.confidence}")
    return out, report


def quality_floor(report: Report, width: int) -> None:
    if not report.metrics:
        return
    floor = tuning.FLOORS[report.tier] - (0.05 if width >= 1024 or width < 512 else 0.0)
    if report.metrics["noise"] > 0.85:
        report.warn("high-noise-ratio", low=True)
    if report.profile.get("tendency", 0) >= 0.40 and report.metrics["score"] < floor:
        report.warn("no-cluster-met-quality-floor", low=True)
