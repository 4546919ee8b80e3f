"""Candidate clusterings of a bounded matrix and how they are scored.

These run inside single Spark tasks, a task for each representation and each
neighbour count, on matrices of at most the medium tier's size.
"""

from __future__ import annotations

import numpy as np

from ..functions import kernels as N
from ..operators import tuning
from ..operators.metrics import WEIGHTS


def score(x: np.ndarray, labels: np.ndarray, boost: float = 0.0) -> dict[str, float]:
    """The composite score of a labelling, without ground truth; see ``metrics.composite_score``."""
    names, n, dim = np.unique(labels[labels >= 0]), len(labels), x.shape[1]
    if not len(names):
        return {"score": 0.0, "k": 0, "coverage": 0.0, "cohesion": 0.0, "separation": 0.0, "stability": 0.0, "fragmentation": 1.0, "largest": 1.0, "noise": 1.0}
    c, sizes, own = [], [], []
    for k in names:
        rows = x[labels == k]
        m = N.unit_rows(rows.mean(axis=0, keepdims=True))[0]
        c.append(m)
        sizes.append(len(rows))
        own.append(float(np.clip(rows @ m, -1, 1).mean()))
    c, sizes, own = np.array(c), np.array(sizes, float), np.array(own)
    k = len(names)
    sep = 0.0
    if k > 1:
        i, j = np.triu_indices(k, 1)
        sep = float((1 - np.clip((c @ c.T)[i, j], -1, 1)).mean())
    sep *= min(2.5, 1 + (dim - 512) / 1024) if dim >= 1024 else 1 + (dim - 512) / 2048 if dim >= 512 else 1.0
    middle, top = float(np.median(sizes)), sizes.max()
    if top > 2 * middle:
        sep *= (middle / top) ** 0.5
    base = max(2, min(22, int((n / 3) ** 0.5)))
    low = max(4, base // 2)
    if k <= 3 and n > 150:
        sep = 0.0
    elif k >= 4 and n > 500 and k < low:
        sep *= k / low
    frag = max(float((sizes <= max(3, int(0.25 * n / k))).mean()), min(1.0, max(0.0, (k - base) / base)))
    gains = {"coverage": float(sizes.sum() / n), "cohesion": (float((sizes * own).sum() / sizes.sum()) + 1) / 2, "separation": min(1.0, max(0.0, sep)), "stability": 0.5 if k == 1 else 1 - min(float(sizes.std() / sizes.mean()), 2) / 2}
    spread = 1 + WEIGHTS["density"] / sum(WEIGHTS[g] for g in gains)
    total = sum(WEIGHTS[g] * spread * v for g, v in gains.items()) - WEIGHTS["fragmentation"] * (1 + boost) * frag
    total -= WEIGHTS["largest"] * max(0.0, top / n - 0.10) + max(0.0, 0.15 - float(own.min()))
    return {"score": min(1.0, max(0.0, total)), "k": k, **gains, "fragmentation": frag, "largest": float(top / n), "noise": float((labels < 0).mean())}


def diverse(candidates: list[dict], n: int, most: int = 3) -> list[dict]:
    """The best, the one whose K is nearest to what the size suggests, the best separated; then by score."""
    if len(candidates) <= most:
        return candidates
    ranked = sorted(candidates, key=lambda c: -c["score"])
    want = max(2, int(0.35 * n**0.5))
    picked = [ranked[0]]
    for other in (min(ranked, key=lambda c: abs(c["k"] - want)), max(ranked, key=lambda c: c["separation"]), *ranked):
        if len(picked) < most and not any(other is p for p in picked):
            picked.append(other)
    return picked


def sweep(x: np.ndarray, full: np.ndarray, sizes: list[int], neighbours: int, boost: float, methods=tuning.METHODS) -> list[dict]:
    """All cuts of one minimum spanning tree; scored on the full vectors."""
    if len(x) < 3:
        return []
    tree = N.single_linkage(N.spanning_tree(x, N.core_distances(x, neighbours)))
    out = []
    for least in sizes:
        for method in methods:
            labels = N.hdbscan(tree, least, method)
            s = score(full, labels, boost)
            if not s["k"]:
                s["score"] = -1.0
            out.append({**s, "labels": labels, "mcs": least, "min_samples": neighbours, "method": method, "dim": x.shape[1]})
    return out


def split_oversized(x: np.ndarray, labels: np.ndarray, boost: float = 0.0, *, least: int | None = None, sizes: list[float] | None = None, share: float = 0.18, cohesive: float = 0.90, gain: float = 1e-3, most: int = 2) -> np.ndarray:
    """Splits large clusters that don't hold together, at most ``most``, where that makes the score better.

    With ``least``, the smallest cluster size of the solution, clusters of twice
    as many rows count as large and one split of each is tried, as the small
    tier does; else those with a ``share`` of the rows and twice the median.
    """
    labels = labels.copy()
    names, counts = np.unique(labels[labels >= 0], return_counts=True)
    if not len(names):
        return labels
    best, fresh, done = score(x, labels, boost)["score"], int(names.max()) + 1, 0
    large = max(12, 2 * least) if least else max(12, int(share * len(x)), int(2 * max(1.0, float(np.median(counts)))))
    for c in names[np.argsort(-counts, kind="stable")]:
        own = np.flatnonzero(labels == c)
        n = len(own)
        m = N.unit_rows(x[own].mean(axis=0, keepdims=True))[0]
        if done >= most or n < large or float(np.clip(x[own] @ m, -1, 1).mean()) >= cohesive:
            continue
        if least:
            tries = [(max(3, x.shape[1] - 1), max(3, min(least, n // 6)))]
        else:
            tries = [(dim, size) for dim in (6, 10) for size in (sorted({max(3, int(r * n)) for r in sizes}) if sizes else sorted({max(3, n // 10), max(5, n // 6)}))]
        for dim, size in tries:
            y = N.unit_rows(N.pca(x[own], dim)) if dim < x.shape[1] else x[own]
            sub = N.hdbscan(N.single_linkage(N.spanning_tree(y, N.core_distances(y, min(2, size - 1) if least else max(1, size // 2)))), size, "leaf")
            parts, held = np.unique(sub[sub >= 0], return_counts=True)
            if len(parts) < 2 or held.max() >= int(0.9 * n):
                continue
            new = labels.copy()
            others = [p for p in parts if p != parts[held.argmax()]]
            for i, p in enumerate(others):
                new[own[sub == p]] = fresh + i
            s = score(x, new, boost)["score"]
            if s > best + gain:
                labels, best, done = new, s, done + 1
                fresh += len(others)
                break
    return labels


def jumps(heights: np.ndarray, most: int, limit: int = 5) -> list[int]:
    """Numbers of clusters at the large jumps of merge heights, the largest jump first."""
    if len(heights) < 2 or most < 2:
        return []
    d = np.diff(heights)
    z = (d - d.mean()) / d.std() if d.std() >= 1e-12 else (d == d.max()).astype(float)
    at = np.flatnonzero(z >= 1.0)
    at = at if len(at) else np.argsort(d)[-3:]
    best: dict[int, float] = {}
    for j in at:
        k = min(max(len(heights) - int(j), 2), most)
        best[k] = max(best.get(k, -np.inf), float(z[j]))
    return sorted(best, key=lambda k: (-best[k], k))[:limit]


SOURCES = ("spectral", "jump", "silhouette", "grid")


def tiny(x: np.ndarray, preset: str = "balanced", seed: int = 42) -> tuple[np.ndarray, dict]:
    """Up to 150 rows: cuts of two linkages and spectral candidates, the best by score, then by fewer clusters, then by source."""
    n = len(x)
    if n < 3:
        same = n == 2 and float(N.unit_rows(x)[0] @ N.unit_rows(x)[1]) >= 0.95
        return np.zeros(n, np.int32) if n == 1 or same else np.arange(n, dtype=np.int32), {"source": "few rows"}
    if (np.abs(x - x[0]) <= 1e-9).all():
        return np.zeros(n, np.int32), {"source": "identical"}
    u = N.unit_rows(x)
    cosine = np.clip(1 - u @ u.T, 0, 2)
    ward, average = N.linkage(np.sqrt(2 * cosine), "ward"), N.linkage(cosine, "average")

    def cut(k: int) -> np.ndarray:
        return max((N.cut_tree(z, k) for z in (ward, average)), key=lambda a: score(x, a)["score"])

    most = max(2, n // 2)
    found = [("jump", k, cut(k)) for k in jumps(ward[:, 2], most)]
    grid = tuning.k_grid(n, preset)
    found += [("grid", k, cut(k)) for k in grid]
    sil = max(grid, key=lambda k: N.silhouette(x, N.cut_tree(average, k)))
    found.append(("silhouette", sil, cut(sil)))
    if n >= 8:
        found += [("spectral", k, N.spectral(x, k, seed, clip=True)) for k in grid[:6] if k < n]
    seen, ranked = set(), []
    for source, k, labels in found:
        if (key := (k, labels.tobytes())) not in seen:
            seen.add(key)
            s = score(x, labels)
            if np.isfinite(s["score"]):
                ranked.append((-s["score"], s["k"], SOURCES.index(source), source, labels))
    best = min(ranked, key=lambda r: r[:3])
    return best[4].astype(np.int32), {"source": best[3], "score": -best[0], "candidates": len(ranked)}
