"""Bounded numeric kernels on numpy arrays, called inside single tasks.

Linkage follows Lance and Williams; the density tree follows Campello, Moulavi
and Sander (2013); seeding follows Arthur and Vassilvitskii (2007); spectral
clustering follows Ng, Jordan and Weiss (2001).
"""

from __future__ import annotations

import numpy as np


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-10)


def linkage(dist: np.ndarray, method: str) -> np.ndarray:
    """``(n - 1, 4)`` merges ``a, b, height, size`` of a full distance matrix; ``average`` or ``ward``."""
    n = len(dist)
    d = np.array(dist, np.float64)
    if method == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    ids, size = np.arange(n), np.ones(n)
    alive = np.ones(n, bool)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        h = d[i, j]
        out[step] = (*sorted((ids[i], ids[j])), np.sqrt(max(h, 0.0)) if method == "ward" else h, size[i] + size[j])
        k = alive.copy()
        k[[i, j]] = False
        a, b = size[i], size[j]
        if method == "ward":
            new = ((a + size[k]) * d[i, k] + (b + size[k]) * d[j, k] - size[k] * h) / (a + b + size[k])
        else:
            new = (a * d[i, k] + b * d[j, k]) / (a + b)
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
        size[i], ids[i] = a + b, n + step
    return out


def cut_tree(merges: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` groups, numbered by their first row."""
    n = len(merges) + 1
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step in range(n - max(1, min(k, n))):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        parent[find(a)] = parent[find(b)] = n + step
    first: dict[int, int] = {}
    return np.array([first.setdefault(find(i), len(first)) for i in range(n)], np.int32)


def core_distances(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Distance to the ``k``-th other row."""
    n, sq = len(x), (x * x).sum(axis=1)
    k = min(k, n - 1)
    out = np.zeros(n)
    for at in range(0, n, block):
        d = np.maximum(sq[at : at + block, None] + sq[None] - 2 * x[at : at + block] @ x.T, 0)
        out[at : at + block] = np.sqrt(np.partition(d, k, axis=1)[:, k])
    return out


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges ``a, b, weight`` of the minimum spanning tree of mutual reachability, by Prim with one row of distances at a time."""
    n, sq = len(x), (x * x).sum(axis=1)
    near, by = np.full(n, np.inf), np.zeros(n, int)
    left = np.ones(n, bool)
    at, out = 0, np.zeros((max(n - 1, 0), 3))
    left[0] = False
    for step in range(n - 1):
        d = np.sqrt(np.maximum(sq[at] + sq - 2 * (x @ x[at]), 0))
        d = np.maximum(np.maximum(d, core[at]), core)
        closer = left & (d < near)
        near[closer], by[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        out[step] = by[at], at, near[at]
        left[at] = False
    return out[np.argsort(out[:, 2], kind="stable")]


def single_linkage(edges: np.ndarray) -> np.ndarray:
    n = len(edges) + 1
    parent, size = list(range(2 * n)), [1] * n + [0] * n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = np.zeros((n - 1, 4))
    for step, (a, b, w) in enumerate(edges):
        i, j = find(int(a)), find(int(b))
        size[n + step] = size[i] + size[j]
        parent[i] = parent[j] = n + step
        out[step] = i, j, w, size[n + step]
    return out


def condense(tree: np.ndarray, least: int) -> list[tuple[int, int, float, int]]:
    """``(parent, child, lambda, size)``: splits whose sides both have ``least`` rows make clusters, other rows fall out; clusters count from ``n``."""
    n = len(tree) + 1
    out: list[tuple[int, int, float, int]] = []
    count = lambda node: 1 if node < n else int(tree[node - n, 3])

    def rows(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo += [int(tree[x - n, 0]), int(tree[x - n, 1])]
        return found

    fresh, todo = n, [(2 * n - 2, n)] if n > 1 else []
    while todo:
        node, own = todo.pop()
        if node < n:
            continue
        a, b, w = int(tree[node - n, 0]), int(tree[node - n, 1]), tree[node - n, 2]
        lam = 1 / w if w > 0 else np.inf
        big = [c for c in (a, b) if count(c) >= least]
        for c in (a, b):
            if c not in big:
                out += [(own, r, lam, 1) for r in rows(c)]
        if len(big) == 2:
            for c in big:
                fresh += 1
                out.append((own, fresh, lam, count(c)))
                todo.append((c, fresh))
        elif big:
            todo.append((big[0], own))
    return out


def hdbscan(tree: np.ndarray, least: int, method: str = "eom") -> np.ndarray:
    """Labels from a single-linkage tree; ``-1`` is noise.  A tree that never splits is all noise."""
    n = len(tree) + 1
    labels = np.full(n, -1, np.int32)
    rows = condense(tree, max(2, least))
    if not rows:
        return labels
    birth, kids, stable = {n: 0.0}, {}, {}
    for parent, child, lam, _ in rows:
        if child > n:
            birth[child] = lam
            kids.setdefault(parent, []).append(child)
    top = max((lam for *_, lam, _ in rows if np.isfinite(lam)), default=1.0)
    for parent, _, lam, size in rows:
        stable[parent] = stable.get(parent, 0.0) + (min(lam, top) - min(birth[parent], top)) * size
    chosen: set[int] = set()
    for c in sorted(stable | dict.fromkeys(birth, 0.0), reverse=True):
        if c == n:
            continue
        own = kids.get(c, [])
        if method == "leaf":
            if not own:
                chosen.add(c)
            continue
        below = sum(stable.get(k, 0.0) for k in own)
        if not own or stable.get(c, 0.0) >= below:
            todo = list(own)
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += kids.get(k, [])
            chosen.add(c)
        else:
            stable[c] = below
    of = {child: parent for parent, child, *_ in rows}
    number = {c: i for i, c in enumerate(sorted(chosen))}
    for r in range(n):
        c = of.get(r)
        while c is not None and c not in number:
            c = of.get(c)
        if c is not None:
            labels[r] = number[c]
    return labels


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    own = [int(rng.integers(len(x)))]
    d = ((x - x[own[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = d.sum()
        own.append(int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[own[-1]]) ** 2).sum(axis=1))
    return x[own].copy()


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and inertia of Lloyd's algorithm; a centre that loses all rows stays."""
    c, at = seeds(x, k, np.random.default_rng(seed)), None
    for _ in range(rounds):
        new = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        if at is not None and (new == at).all():
            break
        at = new
        for i in range(k):
            if (own := at == i).any():
                c[i] = x[own].mean(axis=0)
    return at.astype(np.int32), float(((x - c[at]) ** 2).sum())


def bisecting(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Splits the largest cluster in two until there are ``k``."""
    labels = np.zeros(len(x), np.int32)
    for new in range(1, min(k, len(x))):
        sizes = np.bincount(labels, minlength=new)
        for c in np.argsort(-sizes, kind="stable"):
            own = np.flatnonzero(labels == c)
            if len(own) > 1:
                half = kmeans(x[own], 2, seed + new)[0]
                if len(set(half.tolist())) < 2:
                    half = (np.arange(len(own)) >= len(own) // 2).astype(np.int32)
                labels[own[half == 1]] = new
                break
    return labels


def balanced(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means, then up to three passes of assignment by cosine."""
    labels, u = kmeans(x, k, seed)[0], unit_rows(x)
    for _ in range(3):
        c = np.array([u[labels == i].mean(axis=0) if (labels == i).any() else np.zeros(x.shape[1]) for i in range(k)])
        like = u @ unit_rows(c).T
        like[:, ~np.isin(np.arange(k), labels)] = -np.inf
        new = like.argmax(axis=1).astype(np.int32)
        if (new == labels).all():
            break
        labels = new
    return labels


def best_kmeans(x: np.ndarray, k: int, seed: int, tries: int = 3) -> np.ndarray:
    """The labelling of least inertia over some seeds."""
    return min((kmeans(x, k, (seed + i) % 2**32) for i in range(tries)), key=lambda r: r[1])[0]


def spectral(x: np.ndarray, k: int, seed: int, clip: bool = False) -> np.ndarray:
    """Clusters of the leading eigenvectors of the normalised cosine affinity; plain k-means where these don't come about."""
    try:
        e = _leading(x, k, seed, clip)
        if np.isfinite(e).all():
            return kmeans(unit_rows(e), k, seed)[0]
    except np.linalg.LinAlgError:
        pass
    return best_kmeans(x, k, seed)


def _leading(x: np.ndarray, k: int, seed: int, clip: bool) -> np.ndarray:
    u = unit_rows(x)
    a = np.clip(u @ u.T, 0, 1) if clip else (np.clip(u @ u.T, -1, 1) + 1) / 2
    d = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    a = a * d[:, None] * d[None, :]
    if len(a) > 400:  # subspace iteration: only k vectors are needed
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(a), k + 8)))[0]
        for _ in range(60):
            q = np.linalg.qr(a @ q + q)[0]
        w, v = np.linalg.eigh(q.T @ a @ q)
        return (q @ v)[:, np.argsort(-w)[:k]]
    return np.linalg.eigh(a)[1][:, -k:]


def pca(x: np.ndarray, k: int) -> np.ndarray:
    """Centred projection on the leading axes, each signed so that its largest loading is positive."""
    c = x - x.mean(axis=0)
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, : min(k, *x.shape)]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return c @ axes


def silhouette(x: np.ndarray, labels: np.ndarray, block: int = 4096) -> float:
    """Mean cosine silhouette over all rows; rows alone in their cluster count as 0; -1 for fewer than two clusters.

    Sums of cosine distances to a cluster follow from the sum of its unit rows.
    """
    names, at = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(names) >= len(x):
        return -1.0
    u, n = unit_rows(x), np.bincount(at)
    sums = np.zeros((len(names), u.shape[1]))
    np.add.at(sums, at, u)
    total = 0.0
    for i in range(0, len(x), block):
        own = at[i : i + block]
        s = n - u[i : i + block] @ sums.T
        rows = np.arange(len(own))
        a = s[rows, own] / np.maximum(n[own] - 1, 1)
        s = s / n
        s[rows, own] = np.inf
        b = s.min(axis=1)
        total += np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).sum()
    return float(total / len(x))


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    if len(names) < 2:
        return np.inf
    c = np.array([x[labels == i].mean(axis=0) for i in names])
    s = np.array([np.sqrt(((x[labels == i] - c[k]) ** 2).sum(axis=1)).mean() for k, i in enumerate(names)])
    d = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s[None]) / np.maximum(d, 1e-12)).max(axis=1).mean())


def repair(x: np.ndarray, labels: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, bool]:
    """Fills missing ids in ``0..k-1``: the largest cluster is split and its smaller half takes the lowest missing id."""
    labels, changed = labels.copy(), False
    while missing := sorted(set(range(k)) - set(labels.tolist())):
        own = np.flatnonzero(labels == np.bincount(labels, minlength=k).argmax())
        half = kmeans(x[own], 2, seed)[0]
        if len(set(half.tolist())) < 2:
            half = (np.arange(len(own)) >= (len(own) + 1) // 2).astype(np.int32)
        small = 1 if (half == 1).sum() <= (half == 0).sum() else 0
        labels[own[half == small]] = missing[0]
        changed = True
    return labels, changed
