"""Assignment of a stream of texts or vectors to the clusters of a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import FittedModel


def predict_stream(stream: DataFrame, model: FittedModel, key: str = "doc_id", text: str = "text", threshold="auto") -> DataFrame:
    """A stateless projection of the stream; the model's tables are broadcast."""
    return model.predict(stream, key, text, threshold)


def assign_stream(stream: DataFrame, model: FittedModel, threshold="auto") -> DataFrame:
    """The same for a stream of ``row_id, v``."""
    return model.assign(stream, threshold)


def topic_counts(assigned: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows per cluster in windows of event time; ``assigned`` has the time column."""
    return assigned.withWatermark(time, late).groupBy(F.window(time, window), "cluster_id").count()


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now as Parquet, exactly once over restarts with the same checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
