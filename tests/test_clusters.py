"""Blockwise comparison, quantiles, merging and sharding against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import vectors as V
from topicloom.operators import clusters as C
from topicloom.operators import topics as K
from topicloom.operators.quantiles import percentiles
from topicloom.plans import density


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, int(0 if labels is None else labels[i]), [float(a) for a in v]) for i, v in enumerate(x)], "row_id long, cluster_id int, v array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).standard_normal((90, 8))


@pytest.fixture(scope="module")
def u(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1024, 7])
def test_similarities_in_blocks(spark, x, u, block):
    t = table(spark, x)
    got = {(r.a, r.b): r.sim for r in C.block_similarities(t.where("row_id < 20"), t, block).collect()}
    assert len(got) == 20 * 90 and all(abs(s - u[a] @ u[b]) < 1e-12 for (a, b), s in got.items())


def test_nearest_and_close_clusters(spark, u):
    cents = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(u[:40])], "cluster_id int, c array<double>")
    s = u[:40] @ u[:40].T
    got = {(r.a, r["rank"]): r.b for r in C.nearest_clusters(cents, 3).collect()}
    np.fill_diagonal(s, -9)
    assert all(got[i, k + 1] == j for i in range(40) for k, j in enumerate(np.argsort(-s[i])[:3]))
    assert {(r.a, r.b) for r in C.close_pairs(cents, 0.5).collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    i, j = np.triu_indices(40, 1)
    assert C.mean_pair_similarity(cents) == pytest.approx(s[i, j].mean())


def test_more_centroids_than_are_broadcast(spark, x, u, monkeypatch):
    cents = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(u[:12])], "cluster_id int, c array<double>")
    get = lambda: {r.row_id: (r.best, r.second, round(r.best_sim, 9), round(r.second_sim, 9)) for r in C.nearest_two(table(spark, x).select("row_id", "v"), cents).collect()}
    small = get()
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    assert get() == small and len(small) == 90


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {0: rng.uniform(-1, 1, 500), 1: np.round(rng.uniform(0, 1, 300), 1), 2: np.full(40, 0.25), 3: np.array([0.5]), 4: 0.9999 + rng.uniform(0, 1e-6, 200)}
    rows = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own], "g int, s double")
    at = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.g: r for r in percentiles(rows, ["g"], "s", at).collect()}
    for g, own in groups.items():
        assert got[g].n == len(own) and got[g].p == pytest.approx(np.quantile(own, at).tolist(), abs=1e-12)
    assert percentiles(rows, [], "s", at).first().p == pytest.approx(np.quantile(np.concatenate(list(groups.values())), at).tolist(), abs=1e-12)


def test_merging_to_a_fixed_point(spark):
    rng = np.random.default_rng(2)
    angle = np.array([0, 8, 16, 90, 180, 186]) * np.pi / 180
    labels = np.repeat(np.arange(6), 5)
    x = np.stack([np.cos(angle[labels]), np.sin(angle[labels])], axis=1) * rng.uniform(0.5, 2, (30, 1))
    out, merges = C.merge_by_similarity(table(spark, x, labels), np.cos(12.5 * np.pi / 180))
    got = [r.cluster_id for r in out.orderBy("row_id").collect()]
    assert got == np.repeat([0, 0, 0, 3, 4, 4], 5).tolist() and merges == 3


def test_unit_takes_linear_time(spark):
    def took(width):
        df = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
        df.select(F.sum(V.unit(F.col("v"))[0])).collect()
        began = time.time()
        df.select(F.sum(F.aggregate(V.unit(F.col("v")), F.lit(0.0), lambda s, x: s + x))).collect()
        return time.time() - began

    took(64)
    assert took(4096) < 64 * 6 * max(took(64), 0.05)
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(V.unit(F.col("v"))).collect()
    assert [list(r[0]) for r in v] == [[0.6, 0.8], [0.0, 0.0]]


def test_shards_are_split_by_closeness(spark):
    rng = np.random.default_rng(3)
    c = np.eye(6)
    truth = np.repeat(np.arange(6), 100)
    x = c[truth] + 0.02 * rng.standard_normal((600, 6))
    same = np.tile(c[0], (300, 1))
    rows = spark.createDataFrame([(i, [float(a) for a in v], 7 if i < 600 else 9) for i, v in enumerate(np.concatenate([x, same]))], "row_id long, v array<double>, shard int")
    got = {r.row_id: (r.shard, r.piece) for r in density.split_shards(rows, 100, 0).select("row_id", "shard", "piece").collect()}
    sizes = {}
    for at in got.values():
        sizes[at] = sizes.get(at, 0) + 1
    assert len(got) == 900 and max(sizes.values()) <= 160
    own = [{got[i][0] for i in range(k * 100, k * 100 + 100)} for k in range(6)]
    assert sum(len(s) == 1 for s in own) >= 4
    assert len({got[i][0] for i in range(600, 900)}) == 1


def test_no_shard_with_clusters_falls_back_on_k_means(spark, monkeypatch):
    from topicloom.operators import tuning
    from topicloom.operators.profile import dataset_profile

    monkeypatch.setattr(density, "search_shard", lambda x, *_: np.full(len(x), -1, np.int32))
    rng = np.random.default_rng(4)
    rows = table(spark, np.repeat(np.eye(4)[:2], 60, axis=0) + 0.05 * rng.standard_normal((120, 4))).select("row_id", "v")
    report = density.Report()
    out = density.cluster_large(rows, tuning.Config(), "low", dataset_profile(rows), report)
    assert "large-global-fallback" in report.warnings and {r.cluster_id for r in out.collect()} == {0, 1}


def test_terms_and_label_suitability(spark):
    rows = spark.createDataFrame([(0, "the café provides über safety a"), (1, None), (-1, "noise word")], "cluster_id int, clean_text string")
    assert sorted(r.term for r in K.term_counts(rows).collect()) == sorted(["cafe", "provides", "uber", "safety", "cafe provides", "provides uber", "uber safety"])
    want = {"safety": 1.35, "city": 1.0, "cafe provides": 0.0, "network": 1.35, "work": 0.0, "local": 0.0, "local network": 1.0 * 1.55 * 1.35 * 0.3, "a b c": 0.0, "varies": 0.0, "pass": 1.0}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.label_score(F.col("t"), F.lit(1.0)).alias("s")).collect()
    assert {r.t: pytest.approx(r.s) for r in got} == want


def test_reducer_projects_rows_it_was_not_fitted_on(spark):
    from topicloom.operators.reduce import PcaReducer

    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 8)) + 0.01 * rng.standard_normal((200, 8))
    rows = table(spark, x)
    with pytest.raises(RuntimeError):
        PcaReducer(3).transform(rows)
    y = np.array([r.v for r in PcaReducer(3).fit(rows.where("row_id < 150")).transform(rows).orderBy("row_id").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = lambda a: np.linalg.norm(a[150:, None] - a[None, :150], axis=2)
    assert y.shape == (200, 3) and np.abs(d(y) - d(u)).max() < 0.1


def test_manifold_values_and_caps():
    from topicloom.operators import tuning

    assert [tuning.manifold_neighbours(n) for n in (5, 100, 5000, 10**6)] == [4, 15, 27, 40]
    assert [tuning.manifold_width(n, 384) for n in (10, 2000, 10**6)] == [6, 14, 15] and tuning.manifold_width(2000, 6) == 6
    assert tuning.direct_caps(30_000, 0.2, [1, 2, 3, 4], [1, 2, 3]) == ([1, 2, 3], [1, 2], ("eom",))
    assert tuning.direct_caps(10_000, 0.6, [1, 2, 3, 4, 5], [1, 2, 3]) == ([1, 2, 3, 4], [1, 2, 3], ("eom", "leaf"))


def test_missing_ids_come_from_the_largest_cluster(spark):
    from topicloom.plans import fixed_k

    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(np.eye(4)[:2], [30, 20], axis=0) + 0.02 * rng.standard_normal((50, 4)), np.tile(np.eye(4)[3], (20, 1))])
    rows = spark.createDataFrame([(i, [float(a) for a in v], 0 if i < 50 else 3) for i, v in enumerate(x)], "row_id long, v array<double>, cluster_id int")
    report = fixed_k.Report()
    got = {r.row_id: r.cluster_id for r in fixed_k.repair(rows, 5, 0, report).collect()}
    assert len(got) == 70 and set(got.values()) == set(range(5)) and "empty-cluster-repaired" in report.warnings
    assert {i for i, c in got.items() if c == 1} == set(range(30, 50))


def test_terms_are_shuffled_once_and_by_term_alone(spark):
    rows = spark.createDataFrame([(0, "red blue red blue"), (1, "red blue"), (-1, "red"), (1, None)], "cluster_id int, clean_text string")
    counts = K.term_counts(rows)
    assert sorted(map(tuple, counts.collect())) == [(0, "blue", 2), (0, "blue red", 1), (0, "red", 2), (0, "red blue", 2), (1, "blue", 1), (1, "red", 1), (1, "red blue", 1)]
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" in plan
    scores = K.class_tf_idf(counts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [term" not in scores and "BroadcastHashJoin [term" not in scores


def test_label_scores_look_words_up_in_sets(spark):
    df = spark.createDataFrame([("red data",)], "t string").select(T.label_score(F.col("t"), F.lit(1.0)).alias("s"))
    assert "exists(" not in df._jdf.queryExecution().optimizedPlan().toString() and df.first().s == pytest.approx(1.55)


def test_nearest_two_hold_few_cosines_at_once(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(2000, 4)), rng.normal(size=(3000, 4))
    c[7] = c[3]
    want = np.argsort(-np.round(x @ c.T, 12), axis=1, kind="stable")[:, :2]
    monkeypatch.setattr(C, "CELLS", 30_000)
    tracemalloc.start()
    order, sim = C.top_two(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (order == want).all() and peak < 3_000_000  # all cosines at once take 48 million bytes
    assert sim[:, 0].tolist() == pytest.approx((x @ c.T).max(axis=1).tolist())
    assert C.top_two(x, c[:1])[0].shape == (2000, 1)
