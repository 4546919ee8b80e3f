import numpy as np
import pytest

from topicloom.functions import kernels as N
from topicloom.operators import tuning
from topicloom.plans import density, search


def blobs(k=4, n=40, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    c = N.unit_rows(rng.standard_normal((k, dim))) * 4
    x = np.concatenate([c[i] + 0.25 * rng.standard_normal((n, dim)) for i in range(k)])
    return N.unit_rows(x), np.repeat(np.arange(k), n)


def same(a, b):
    pairs = {(x, y) for x, y in zip(a, b, strict=True)}
    return len(pairs) == len(set(a)) == len(set(b))


def test_average_linkage_is_the_mean_distance():
    x = np.random.default_rng(1).standard_normal((12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    z = N.linkage(d, "average")
    members = {i: [i] for i in range(12)}
    for step, (a, b, h, n) in enumerate(z):
        rows = members[int(a)], members[int(b)]
        assert h == pytest.approx(np.mean([d[i, j] for i in rows[0] for j in rows[1]]))
        members[12 + step] = rows[0] + rows[1]
        assert n == len(members[12 + step])
    assert (np.diff(z[:, 2]) >= -1e-9).all()


def test_spanning_tree_weight_matches_kruskal():
    x = np.random.default_rng(2).standard_normal((30, 4))
    core = N.core_distances(x, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert core == pytest.approx(np.sort(d, axis=1)[:, 3])
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    parent = list(range(30))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for w, i, j in sorted((m[i, j], i, j) for i in range(30) for j in range(i)):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += w
    assert N.spanning_tree(x, core)[:, 2].sum() == pytest.approx(total)


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_density_tree_finds_planted_groups(method):
    x, truth = blobs()
    tree = N.single_linkage(N.spanning_tree(x, N.core_distances(x, 4)))
    labels = N.hdbscan(tree, 15, method)
    kept = labels >= 0
    assert kept.mean() > 0.8 and len(set(labels[kept])) == 4 and same(labels[kept], truth[kept])


def test_one_group_is_all_noise():
    x = np.random.default_rng(0).standard_normal((40, 2))
    tree = N.single_linkage(N.spanning_tree(x, N.core_distances(x, 4)))
    assert set(N.hdbscan(tree, 30)) == {-1}


@pytest.mark.parametrize("run", [N.bisecting, N.balanced, N.spectral])
def test_fixed_k_kernels_find_planted_groups(run):
    x, truth = blobs(k=3)
    found = run(x, 3, 0)
    assert len(set(found)) == 3
    assert max(np.mean(found[truth == t] == np.bincount(found[truth == t]).argmax()) for t in range(3)) > 0.9


def test_silhouette_matches_the_definition():
    x, truth = blobs(k=3, n=5)
    u = N.unit_rows(x)
    d = 1 - u @ u.T
    s = []
    for i in range(len(x)):
        own = [d[i, j] for j in range(len(x)) if j != i and truth[j] == truth[i]]
        rest = min(np.mean(d[i, truth == t]) for t in set(truth) - {truth[i]})
        s.append((rest - np.mean(own)) / max(rest, np.mean(own)))
    assert N.silhouette(x, truth) == pytest.approx(np.mean(s))


def test_repair_uses_every_id():
    x = np.random.default_rng(0).standard_normal((20, 3))
    labels, changed = N.repair(x, np.zeros(20, np.int32), 4, 0)
    assert changed and set(labels) == {0, 1, 2, 3}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_tier_handles_few_and_equal_rows(n):
    assert len(search.tiny(np.ones((n, 3)))[0]) == n


def test_tiny_tier_finds_planted_groups():
    x, truth = blobs(k=5, n=12)
    labels, how = search.tiny(x)
    assert same(labels, truth), how


def test_merge_and_compact():
    x = N.unit_rows(np.array([[1, 0.0], [1, 0.01], [0, 1.0], [0, 1.0]]))
    assert density.compact(density.merge(x, np.array([3, 5, 7, -1]), 0.9)).tolist() == [0, 0, 1, -1]


def test_routing():
    assert [tuning.tier(n) for n in (150, 151, 5000, 5001, 50000, 50001)] == ["tiny", "small", "small", "medium", "medium", "large"]
    assert tuning.adaptive_width(5000, 384) == 64 and tuning.adaptive_width(200_000, 3072) == 512
    assert tuning.k_algorithm("tiny", 10) == "balanced" and tuning.k_algorithm("small", 2) == "bisecting"
    with pytest.raises(ValueError):
        tuning.dim_band(0)
    with pytest.warns(UserWarning):
        assert tuning.dim_band(64) == "low"


def test_options_are_checked():
    assert tuning.Config.of({"quality": "best"}).quality == "best"
    for bad in ({"quality": "x"}, {"cluster_granularity": "x"}, {"random_state": -1}, {"batch_size": 0}, {"nope": 1}, {"min_cluster_size": 1}):
        with pytest.raises(ValueError):
            tuning.Config.of(bad)


def test_spectral_falls_back_on_k_means(monkeypatch):
    x, truth = blobs(k=3)

    def fails(*_):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(N, "_leading", fails)
    assert same(N.spectral(x, 3, 0), truth)


def test_a_cluster_of_two_groups_is_split():
    x, truth = blobs(k=4, n=40)
    labels = np.where(truth == 3, 2, truth)
    for got in (search.split_oversized(x, labels), search.split_oversized(x, labels, least=8, cohesive=0.88, gain=0.0)):
        assert len(set(got.tolist())) == 4 and same(got, truth)
    assert (search.split_oversized(x, truth) == truth).all()


def test_floors_lie_under_the_worst_run():
    run = lambda tier, score: {"tier": tier, "score": score, "ari": 0.5, "k": 4, "n": 10, "dataset": "d", "embedder": "e"}
    got = tuning.calibrate_floors([run("tiny", 0.8), run("tiny", 0.6)], {"small": {"floor": 0.1}})
    assert got["tiny"]["score"] == 0.7 and got["tiny"]["floor"] == pytest.approx(0.45) and got["tiny"]["runs"] == 2 and got["small"] == {"floor": 0.1}


def test_floors_of_numpy_scores_are_plain_floats():
    got = tuning.calibrate_floors([{"tier": "tiny", "score": np.float64(0.8), "ari": np.float64(0.5), "k": np.int64(4), "n": 10, "dataset": "d", "embedder": "e"}])["tiny"]
    assert {type(got[c]) for c in ("score", "ari", "floor", "least", "most")} == {float} and type(got["k"]) is int


def test_a_giant_cluster_is_refined():
    assert tuning.blob(0.9, 3, 0.1, 0.9) and tuning.blob(0.6, 1, 0.9, 0.2) and not tuning.blob(0.2, 10, 0.1, 0.1) and not tuning.blob(0.5, 2, 0.1, 0.1)
