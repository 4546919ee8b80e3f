"""Column expressions on ``array<float|double>`` vectors; sums are kept in doubles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length, which counts as ``TINY`` at least.

    The length is bound as the one element of an array, as it would be computed
    anew for each component inside the lambda.
    """
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(TINY))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def mean(v: Column) -> Column:
    """Aggregate: the mean vector, in one pass that combines before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
