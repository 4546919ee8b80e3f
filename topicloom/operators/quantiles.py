"""Exact interpolated quantiles whose groups may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a group that are gathered in one task.
GATHERED = 4096


def percentiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """``by`` columns, ``n`` and ``p``, the interpolated quantiles ``at`` of a bounded ``value`` in -1..1 over each group.

    A first aggregate counts values by ``2 * GATHERED`` bins, which combine
    before the shuffle; only values of the bins that hold a wanted rank are
    then looked at, and equal ones are counted before they are sorted.
    """
    key = [*by, "_bin"]
    binned = rows.select(*by, F.col(value).alias("_x"), F.floor((F.col(value) + 1) * GATHERED).cast("int").alias("_bin"))
    bins = binned.groupBy(*key).agg(F.count("*").alias("_held"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # bins only: a bounded number for each group
    bins = bins.withColumn("_upto", F.sum("_held").over(w.orderBy("_bin"))).withColumn("n", F.sum("_held").over(w)).withColumn("_before", F.col("_upto") - F.col("_held"))
    rank = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_upto"))
    wanted = None
    for p in at:
        hit = inside(F.floor(rank(p))) | inside(F.ceil(rank(p)))
        wanted = hit if wanted is None else wanted | hit
    few = bins.where(wanted).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "_before", "n")
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    values = binned.join(few, on).groupBy(*key, "_before", "n", "_x").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_x")) + F.col("_before")
    values = values.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    pick = lambda r: F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_x")))
    picked = values.groupBy(*by, "n").agg(*(f for i, p in enumerate(at) for f in (pick(F.floor(rank(p))).alias(f"_l{i}"), pick(F.ceil(rank(p))).alias(f"_h{i}"))))
    part = lambda i, p: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (rank(p) - F.floor(rank(p)))
    return picked.select(*by, "n", F.array(*(part(i, p) for i, p in enumerate(at))).alias("p"))
