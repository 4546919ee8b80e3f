"""Cleaning, deduplication, index maps and projection of labels back to rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut

#: Blocks that rows are numbered in, at most.
BLOCKS = 1024
#: Rows of a sample that one task may gather.
GATHERED = 4096


def require_string(df: DataFrame, column: str) -> None:
    if (kind := dict(df.dtypes)[column]) != "string":
        raise TypeError(f"column {column} holds {kind}, not string")


def dense_index(df: DataFrame, key: str, name: str, blocks: int = BLOCKS) -> DataFrame:
    """Numbers rows by a numeric key, from 0 without gaps.

    Approximate quantiles of the key part it into blocks of about equal size,
    whatever its distribution; rows are numbered within their block, behind the
    counts of the blocks before, so one task sees a block and no more.
    """
    df = cut(df)
    edges = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / blocks for i in range(1, blocks)], F.lit(10 * blocks))).first()[0] or []
    at = Bucketizer(splits=[float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")], inputCol="_key", outputCol="_block", handleInvalid="keep")
    blocked = at.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    counts = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row for each block
    own = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return blocked.withColumn("_own", own).join(F.broadcast(counts), "_block").withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_block", "_own", "_before")


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 0) -> DataFrame:
    """``row_id, clean_text``; null where the row is filtered: missing, empty once cleaned, or too short."""
    require_string(df, text)
    c = F.col("clean_text")
    return df.select(F.col(key).alias("row_id"), T.clean(F.col(text)).alias("clean_text")).withColumn("clean_text", F.when((c != "") & (F.length(c) >= min_length), c))


def unique_texts(rows: DataFrame) -> DataFrame:
    """``proc_id, clean_text, first_row_id``: each cleaned text once, numbered by where it comes first."""
    first = rows.where("clean_text is not null").groupBy("clean_text").agg(F.min("row_id").alias("first_row_id"))
    return dense_index(first, "first_row_id", "proc_id").select("proc_id", "clean_text", "first_row_id")


def index_map(rows: DataFrame, deduplicate: bool = True) -> DataFrame:
    """``row_id, proc_id``; null for filtered rows."""
    if deduplicate:
        return rows.join(unique_texts(rows).select("clean_text", "proc_id"), "clean_text", "left").select("row_id", "proc_id")
    kept = dense_index(rows.where("clean_text is not null").select("row_id"), "row_id", "proc_id")
    return rows.select("row_id").join(kept, "row_id", "left").select("row_id", "proc_id")


def project_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, cluster_id`` for every input row from ``clean_text, cluster_id``; -1 for filtered rows and noise."""
    return rows.join(labels, "clean_text", "left").select("row_id", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"))


def groups(labelled: DataFrame) -> DataFrame:
    """``cluster_id, items``: the texts of each cluster in row order, noise left out; what a caller asks for as a list."""
    items = F.array_sort(F.collect_list(F.struct("row_id", "text")))
    return labelled.where("cluster_id >= 0").groupBy("cluster_id").agg(F.transform(items, lambda x: x["text"]).alias("items"))


def missing_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """``missing``: the labels in ``0..k-1`` that no row has."""
    used = df.select(F.col(label).cast("long").alias("missing")).distinct()
    return df.sparkSession.range(k).select(F.col("id").alias("missing")).join(used, "missing", "left_anti")


def compact_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``compact``: labels from 0 up in ascending order, negative ones kept."""
    own = df.where(F.col(label) >= 0).select(label).distinct()
    number = own.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("compact"))  # a row for each cluster
    return df.join(number, label, "left").withColumn("compact", F.coalesce("compact", F.lit(-1)))


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones whatever the partitioning: the first by the hash of the key.

    More than ``GATHERED`` aren't sorted in one task: rows are counted by the
    top bits of the hash, and only the bin that holds the last row is sorted.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit(str(seed)))
    if n <= GATHERED:
        return df.orderBy(h, key).limit(n)
    at = F.shiftright(h, 52)
    before = 0
    for edge, held in sorted(tuple(r) for r in df.groupBy(at.alias("_bin")).count().collect()):
        if before + held >= n:
            return df.where(at < edge).unionByName(df.where(at == edge).orderBy(h, key).limit(n - before))
        before += held
    return df


def round_robin(df: DataFrame, key: str, k: int) -> DataFrame:
    """Labels ``i % k`` in the order of the key."""
    return dense_index(df, key, "i").withColumn("cluster_id", (F.col("i") % k).cast("int")).drop("i")


def stratified(df: DataFrame, label: str, key: str, total: int) -> DataFrame:
    """About ``total`` rows with the shares of ``label`` kept: the first of each stratum by the hash of the key."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = df.count()
    want = sizes.withColumn("_want", F.greatest(F.lit(1), F.round(F.col("_n") * F.lit(float(total)) / F.lit(float(max(n, 1)))).cast("int")))
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.join(F.broadcast(want), label).withColumn("_i", F.row_number().over(order)).where("_i <= _want").drop("_i", "_n", "_want")
