"""Reducers: fitted once, then applied to any rows of the same width."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


class Reducer(Protocol):
    """What ``fit`` returns transforms ``row_id, v`` to vectors of fewer components."""

    def fit(self, rows: DataFrame) -> Reducer: ...

    def transform(self, rows: DataFrame) -> DataFrame: ...


class PcaReducer:
    """Projection of unit vectors on the leading axes of the rows fitted on; only the covariance reaches the driver."""

    def __init__(self, width: int):
        self.width, self.mean, self.model = width, None, None

    def fit(self, rows: DataFrame) -> PcaReducer:
        own = rows.select(V.unit(F.col("v")).alias("v"))
        self.mean = own.agg(V.mean(F.col("v"))).first()[0]
        model: PCAModel = PCA(k=min(self.width, len(self.mean)), inputCol="_f", outputCol="_r").fit(own.select(array_to_vector("v").alias("_f")))
        self.model = model
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the reducer first")
        mean = F.array(*(F.lit(float(x)) for x in self.mean))
        centred = F.zip_with(V.unit(F.col("v")), mean, lambda x, m: x - m)
        return self.model.transform(rows.withColumn("_f", array_to_vector(centred))).withColumn("v", vector_to_array("_r")).drop("_f", "_r")
