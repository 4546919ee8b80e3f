"""A corpus pipeline: five stages over ``documents``, each written and reread.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and is the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases: documents without text are dropped by the first stage; texts of
any length are read whole by each; copies leave the document of smallest id, and
of rows of one id one; columns other than those of ``documents`` are left out
and may have any name; empty tables give an empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import common, decontaminate, near_copies, pii, quality, sentencepiece_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return _same(quality.keep_good(_same(docs), common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies, by SimHash and similarity of 5-word shingles; of rows with that id, one."""
    return _same(near_copies.one_of_each(_same(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a full benchmark window, or at least a twentieth of whose words lie in windows of shorter items."""
    return _same(decontaminate.clean(_same(docs), common.table(spark, sf_dir, "benchmark")))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data with the kind's name in brackets."""
    docs = _same(docs)
    return _same(pii.redact(docs, pii.accepted_patterns(pii.extract(docs))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to."""
    return sentencepiece_bpe.token_digests(docs, sentencepiece_bpe.default_model())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_private),
    ("encode", encode),
]
#: The stages learn, hash and tokenise in ways that SQL can't express; a brute-force version tests them.
ORACLE_SQL = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in the session's shared folder; what a stage returns is deleted once the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    top, before = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before is not None:
            _delete(spark, before)
        before = f"{top}/{name}"
    return docs


QUERIES = {"pipeline": run}
