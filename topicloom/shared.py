"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, as in tests, one of its own, which is local only if Spark is."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="topicloom-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder.

    Later stages read those files instead of recomputing a long lineage, so a
    lost executor costs only its running tasks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
