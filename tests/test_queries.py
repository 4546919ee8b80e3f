"""Queries against DuckDB on small tables, where these are there."""

import os

import duckdb
import pytest

from topicloom.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation lineitem documents embeddings labels benchmark".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    plain = lambda x: None if x is None or x != x else tuple(x) if isinstance(x, list) else x
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_duckdb(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    n = got.count()
    assert n > 0
    if name.startswith("fixed_k_") and "cluster_id" in got.columns and "size" not in got.columns:  # every id is used, and every row has one
        k = {"fixed_k_bisecting": 2, "fixed_k_spectral": 8, "fixed_k_balanced": 20, "fixed_k_agglomerative": 5, "fixed_k_minibatch": 10, "fixed_k_oversized": 6}[name]
        assert {r[0] for r in got.select("cluster_id").distinct().collect()} == set(range(k))
    if name in ("cluster_documents", "cluster_large", "cluster_small", "cluster_medium"):
        source = "documents" if name == "cluster_documents" else "embeddings"
        used = {r[0] for r in got.select("cluster_id").distinct().collect()} - {-1}
        assert n == spark.read.parquet(f"{DIR}/{source}.parquet").count() and used == set(range(len(used)))


def test_stream_reads_one_file_or_a_folder_of_files(spark, tmp_path):
    source = spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id < 60")
    source.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.QUERIES["stream_predict"](spark, str(tmp_path)).count() == source.count()


def test_cluster_documents_takes_any_number_of_rows(spark, monkeypatch):
    from topicloom.plans import model

    seen = []
    monkeypatch.setattr(model.DensityClusterer, "labels", lambda self, docs: seen.append(self.config.max_samples) or docs)
    catalogue.QUERIES["cluster_documents"](spark, DIR)
    assert seen == [None]  # with a limit, more rows than it are refused or sampled


def test_entry(spark):
    assert catalogue.flagship(spark, DIR).count() > 0
