import numpy as np
import pytest

from topicloom.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k=5):
    own = {}
    for i, v, *_ in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(own))
    x = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % 50 == 0:
            s = np.round(x @ x[n], 12)
            s[n] = -9
            out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def found(spark, rows):
    v = ann.usable(table(spark, rows), "vec_id", "embedding")
    out = {}
    for r in ann.search(v, v.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16))
    x[100:900] = x[100]  # a large group of equal vectors
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows)
    assert set(want) == set(got)
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [1.0, 1.0], None), (5, [2.0, 0.0], 1), (50, [None, 1.0], 1), (100, [1e-30, 1e-30], 1), (7, [float("inf"), 0.0], 1)]
    assert found(spark, rows) == brute(rows) == {0: [5, 4, 100], 100: [4, 0, 5]}
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 0.0], 1)]) == {}


def test_pieces_of_bins(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 16)
    monkeypatch.setattr(ann, "MOST_ROWS", 16)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4))
    x[200:260] = x[200] + rng.standard_normal((60, 4)) * 1e-2
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows)
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_bins_hold_leaves_in_order():
    of, rows = ann.bins_of([3, 1, 2, 9, 5], {3: 4, 1: 5, 2: 30, 9: 1}, 10)
    assert of == {3: 0, 1: 0, 2: 1, 9: 2, 5: 2} and rows == {0: 9, 1: 30, 2: 1}


@pytest.mark.parametrize("n", [2000, 12_000])
def test_recall_without_reading_all_where_there_is_structure(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "LEAST_ROWS", 64)
    monkeypatch.setattr(ann, "MOST_ROWS", 64)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, n)] + 0.2 * rng.standard_normal((n, 16))
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows)
    assert set(want) == set(got) and np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_query_at_two_sizes(spark):
    for d in ("sf0.001", "sf0.1"):
        rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{d}/embeddings.parquet").collect()]
        want, got = brute(rows), {}
        for r in ann.op6_ann(spark, f"/root/testdata/{d}").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
            assert r["rank"] == len(got[r.query_id]) and -1 <= r.score <= 1
        assert set(want) == set(got) and np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9
