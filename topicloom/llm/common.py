"""What the operators of this subpackage share: table access, lineage cuts and
row-wise Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_folder

__all__ = ["cut", "fold", "map_texts", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], pa.RecordBatch]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run ``make()(keys, texts)`` over Arrow batches of two columns.

    ``make`` is called once per task, so models and caches are built there.
    Only the key and the text cross into Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield work(part.column(0), part.column(1).to_pylist())

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
