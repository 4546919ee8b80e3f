"""Agreement of labels with a truth, and intrinsic scores of a clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``t, p, n`` over rows with a prediction; everything below works on this table of classes by clusters."""
    return df.where(F.col(predicted) >= 0).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))


def external_metrics(table: DataFrame) -> DataFrame:
    """One row: ``ari, nmi, homogeneity, completeness, v_measure``."""
    pairs = lambda n: F.sum(n * (n - 1.0) / 2.0)
    a = table.groupBy("t").agg(F.sum("n").alias("a"))
    b = table.groupBy("p").agg(F.sum("n").alias("b"))
    total = table.agg(F.sum("n").alias("total"), pairs(F.col("n")).alias("both"))
    ha = a.crossJoin(total).agg(pairs(F.col("a")).alias("pa"), (-F.sum(F.col("a") / F.col("total") * F.log(F.col("a") / F.col("total")))).alias("ht"))
    hb = b.crossJoin(total).agg(pairs(F.col("b")).alias("pb"), (-F.sum(F.col("b") / F.col("total") * F.log(F.col("b") / F.col("total")))).alias("hp"))
    mi = table.join(a, "t").join(b, "p").crossJoin(total).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    x = total.crossJoin(ha).crossJoin(hb).crossJoin(mi)  # one row each
    expected = F.col("pa") * F.col("pb") / (F.col("total") * (F.col("total") - 1.0) / 2.0)
    most = (F.col("pa") + F.col("pb")) / 2.0
    share = lambda top, under: F.when(under <= 1e-12, F.lit(1.0)).otherwise(top / under)
    h, c = share(F.col("mi"), F.col("ht")), share(F.col("mi"), F.col("hp"))
    return x.select(
        F.when(F.abs(most - expected) < 1e-12, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"),
        share(F.col("mi"), (F.col("ht") + F.col("hp")) / 2.0).alias("nmi"),
        h.alias("homogeneity"),
        c.alias("completeness"),
        F.when(h + c <= 1e-12, F.lit(0.0)).otherwise(2.0 * h * c / (h + c)).alias("v_measure"),
    )


def coverage(df: DataFrame, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) >= 0).cast("double")).alias("coverage"))


def purity(table: DataFrame) -> DataFrame:
    """``cluster_id, size, dominant, purity``; equal counts go to the smaller class."""
    return table.groupBy(F.col("p").alias("cluster_id")).agg(F.sum("n").alias("size"), F.min_by("t", F.struct(-F.col("n"), "t")).alias("dominant"), F.max("n").alias("top")).select("cluster_id", F.col("size").cast("long").alias("size"), "dominant", (F.col("top") / F.col("size")).alias("purity"))


def class_recovery(table: DataFrame) -> DataFrame:
    """``class, size, clusters, recovered``: the share of a class in the cluster that holds most of it."""
    return table.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("size"), F.count("*").alias("clusters"), (F.max("n") / F.sum("n")).alias("recovered")).withColumn("size", F.col("size").cast("long"))


def pair_distances(rows: DataFrame) -> DataFrame:
    """``a, la, b, lb, d``: cosine distances of all row pairs; for small tables such as samples."""
    u = rows.select("row_id", "cluster_id", V.unit(F.col("v")).alias("u"))
    x = u.select(F.col("row_id").alias("a"), F.col("cluster_id").alias("la"), F.col("u").alias("ua"))
    y = u.select(F.col("row_id").alias("b"), F.col("cluster_id").alias("lb"), F.col("u").alias("ub"))
    return x.join(y, F.col("a") != F.col("b")).select("a", "la", "b", "lb", (1 - V.dot(F.col("ua"), F.col("ub"))).alias("d"))


def silhouette(rows: DataFrame) -> DataFrame:
    """One row, ``silhouette``: the mean cosine silhouette over all of ``row_id, cluster_id, v``; rows alone in their cluster count as 0.

    The mean cosine distance to a cluster follows from the sum of its unit
    vectors, so rows meet clusters and never each other.
    """
    u = rows.select("row_id", "cluster_id", V.unit(F.col("v")).alias("u"))
    sums = u.groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"), V.mean(F.col("u")).alias("m"))
    x = u.crossJoin(sums.select(F.col("cluster_id").alias("c"), "n", "m")).select("row_id", "cluster_id", "c", "n", (F.col("n") * (1 - V.dot(F.col("u"), F.col("m")))).alias("d"))  # rows by clusters
    own = F.max(F.when((F.col("c") == F.col("cluster_id")) & (F.col("n") > 1), F.col("d") / (F.col("n") - 1)))
    per = x.groupBy("row_id", "cluster_id").agg(own.alias("own"), F.min(F.when(F.col("c") != F.col("cluster_id"), F.col("d") / F.col("n"))).alias("other"))
    s = F.when(F.col("own").isNull() | F.col("other").isNull(), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / F.greatest(F.col("own"), F.col("other"), F.lit(1e-12)))
    return per.agg(F.avg(s).alias("silhouette"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """One row, ``davies_bouldin``, over all of ``row_id, cluster_id, v``."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    cents = rows.groupBy("cluster_id").agg(V.mean(F.col("v")).alias("m"))
    spread = rows.join(cents, "cluster_id").groupBy("cluster_id").agg(F.avg(far(F.col("v"), F.col("m"))).alias("s"))
    c = cents.join(spread, "cluster_id")
    a, b = c.select(F.col("cluster_id").alias("a"), F.col("m").alias("ma"), F.col("s").alias("sa")), c.select(F.col("cluster_id").alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    ratio = (F.col("sa") + F.col("sb")) / F.greatest(far(F.col("ma"), F.col("mb")), F.lit(1e-12))
    return a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def nearest_distances(distances: DataFrame, k: int) -> DataFrame:
    """``a, kth``: distance to the ``k``-th nearest other row."""
    return distances.groupBy("a").agg(F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1)).alias("kth"))


WEIGHTS = {"density": 0.15, "coverage": 0.15, "cohesion": 0.20, "separation": 0.22, "stability": 0.10, "fragmentation": 0.10, "largest": 0.10}


def _median(c: str) -> Column:
    return F.percentile(c, F.lit(0.5))


def composite_score(stats: DataFrame, pairs: DataFrame, n: int, dim: int, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of terms and ``score`` from ``size, cohesion`` of clusters and ``sim`` of their centroid pairs, over ``n`` rows.

    Without a density term its weight is shared out over the other gains.
    """
    w = WEIGHTS | (weights or {})
    gains = [k for k in ("coverage", "cohesion", "separation", "stability")]
    spread = w["density"] / sum(w[k] for k in gains)
    w = {k: v * (1 + spread) if k in gains else v for k, v in w.items()}
    size = F.col("size").cast("double")
    agg = stats.agg(
        F.count("*").cast("double").alias("k"), F.sum(size).alias("held"), (F.sum(size * F.col("cohesion")) / F.sum(size)).alias("mean_cohesion"), F.min("cohesion").alias("least_cohesion"), F.max(size).alias("largest"), _median("size").alias("middle"), F.avg(size).alias("mean_size"), F.stddev_pop(size).alias("std_size")
    )
    base = float(max(2, min(22, int((n / 3) ** 0.5))))
    floor = F.greatest(F.lit(3.0), F.floor(0.25 * n / F.col("k")).cast("double"))
    frag = stats.crossJoin(agg.select("k")).agg(F.avg((size <= floor).cast("double")).alias("tiny"))  # one row
    sep = pairs.agg(F.avg(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim")))).alias("sep"))
    x = agg.crossJoin(frag).crossJoin(sep)  # one row each
    k = F.col("k")
    scale = min(2.5, 1 + (dim - 512) / 1024) if dim >= 1024 else 1 + (dim - 512) / 2048 if dim >= 512 else 1.0
    separation = F.coalesce(F.col("sep"), F.lit(0.0)) * F.lit(float(scale))
    separation = separation * F.when(F.col("largest") > 2 * F.col("middle"), F.sqrt(F.col("middle") / F.col("largest"))).otherwise(F.lit(1.0))
    low = float(max(4, int(base) // 2))
    separation = F.when((k <= 3) & F.lit(n > 150), F.lit(0.0)).when((k >= 4) & F.lit(n > 500) & (k < low), separation * k / low).otherwise(separation)
    parts = {
        "coverage": F.col("held") / F.lit(float(n)),
        "cohesion": (F.col("mean_cohesion") + 1.0) / 2.0,
        "separation": V.clip01(separation),
        "stability": F.when(k <= 1, F.lit(0.5)).otherwise(1.0 - F.least(F.col("std_size") / F.col("mean_size"), F.lit(2.0)) / 2.0),
        "fragmentation": F.greatest(F.col("tiny"), V.clip01((k - base) / base)),
        "largest": F.greatest(F.lit(0.0), F.col("largest") / float(n) - 0.10),
    }
    blob = F.greatest(F.lit(0.0), 0.15 - F.col("least_cohesion"))
    score = V.clip01(sum((parts[g] * w[g] for g in gains), F.lit(0.0)) - parts["fragmentation"] * w["fragmentation"] - parts["largest"] * w["largest"] - blob)
    none = k == 0
    bad = {"fragmentation": 1.0, "largest": 1.0}
    return x.select(k.cast("long").alias("k"), *(F.when(none, F.lit(bad.get(c, 0.0))).otherwise(v).alias(c) for c, v in parts.items()), F.when(none, F.lit(0.0)).otherwise(score).alias("score"))
