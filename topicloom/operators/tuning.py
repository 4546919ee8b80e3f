"""Routing, presets and parameter derivation; plain numbers on the driver."""

from __future__ import annotations

import logging
import math
import warnings
from bisect import bisect_right
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("low", "mid", "high", "xhigh")
TIERS = ((150, "tiny"), (5_000, "small"), (50_000, "medium"))
CAP = 200_000

PCA_TARGETS = {
    "small": {"low": [384], "mid": [256, 384], "high": [128, 192, 256], "xhigh": [64, 96, 128]},
    "medium": {"low": [320, 384], "mid": [256, 320], "high": [192, 256], "xhigh": [96, 128]},
    "large": {"low": [192, 256], "mid": [128, 192], "high": [96, 128], "xhigh": [64, 96]},
}
SIZE_RATIOS = {
    "small": {"low": [0.02, 0.035, 0.06, 0.10, 0.15], "mid": [0.02, 0.04, 0.07, 0.11], "high": [0.02, 0.04, 0.07], "xhigh": [0.025, 0.05, 0.08]},
    "medium": {"low": [0.002, 0.004, 0.006], "mid": [0.002, 0.004, 0.006], "high": [0.0008, 0.0015, 0.003], "xhigh": [0.0008, 0.0015, 0.003]},
    "large": dict.fromkeys(BANDS, [0.001, 0.002]),
}
MIN_SAMPLES = {"tiny": [1, 2, 4], "small": [1, 2, 4], "medium": [1, 2], "large": [2, 4]}
METHODS = ("eom", "leaf")


@dataclass(frozen=True)
class Granularity:
    ratio: float
    least: int
    merge: float
    fragmentation: float
    root: float
    below: float


GRANULARITY = {
    "fine": {"low": Granularity(0.05, 5, 0.85, 0, 0.2, 0.4), "mid": Granularity(0.05, 5, 0.90, 0, 0.3, 0.4), "high": Granularity(0.05, 5, 0.96, 0, 0.3, 0.4), "xhigh": Granularity(0.05, 5, 0.97, 0, 0.3, 0.4)},
    "balanced": {"low": Granularity(0.10, 8, 0.72, 1, 0.35, 0.7), "mid": Granularity(0.10, 8, 0.78, 1, 0.5, 0.7), "high": Granularity(0.10, 8, 0.93, 1, 0.35, 0.7), "xhigh": Granularity(0.10, 8, 0.94, 1, 0.35, 0.7)},
    "coarse": {"low": Granularity(0.20, 15, 0.68, 3, 1.0, 0), "mid": Granularity(0.20, 15, 0.75, 3, 1.5, 0), "high": Granularity(0.20, 15, 0.88, 3, 1.5, 0), "xhigh": Granularity(0.20, 15, 0.90, 3, 1.5, 0)},
}
RESTARTS = {"fast": dict.fromkeys(("tiny", "small", "medium", "large"), 1), "balanced": {"tiny": 5, "small": 5, "medium": 3, "large": 2}, "best": {"tiny": 15, "small": 12, "medium": 10, "large": 5}}
FLOORS = {"tiny": 0.35, "small": 0.60, "medium": 0.60, "large": 0.60}


def dim_band(width: int) -> str:
    if width < 1:
        raise ValueError(f"vectors need a width of 1 at least, not {width}")
    if not 256 <= width <= 16384:
        warnings.warn(f"width {width} is outside 256..16384; the nearest band is used", UserWarning, stacklevel=2)
    return BANDS[bisect_right((512, 1024, 2048), width)]


def tier(n: int) -> str:
    return next((name for most, name in TIERS if n <= most), "large")


def tier_column(n: Column) -> Column:
    out = F
    for most, name in TIERS:
        out = out.when(n <= most, name)
    return out.otherwise("large")


def k_algorithm(tier: str, k: int) -> str:
    if tier == "large":
        return "minibatch"
    if tier == "medium":
        return "balanced"
    if k == 2:
        return "bisecting"
    if tier == "tiny" and k < 10:
        return "agglomerative"
    return "spectral" if tier == "small" and k <= 10 else "balanced"


def least_cluster_size(preset: str, band: str, n: int) -> int:
    g = GRANULARITY[preset][band]
    return int(max(g.least, min(g.ratio * n, g.root * math.sqrt(n))))


def cluster_size_spread(preset: str, band: str, n: int) -> list[int]:
    """Candidate smallest cluster sizes around the preset's floor."""
    g, f = GRANULARITY[preset][band], least_cluster_size(preset, band, n)
    raw = {f}
    if g.below > 0 and f > g.least:
        raw.add(round(f * g.below))
        if g.below < 0.5:
            raw |= {round(f * g.below / 2), round(f * (g.below + 0.2))}
    raw |= {round(1.5 * f), round(2.5 * f), round(4 * f)} if g.below > 0 else {round(2 * f), round(3.5 * f)}
    return sorted({max(g.least, min(v, max(f, n // 3))) for v in raw})


def size_candidates(values: list[float], upper: int) -> list[int]:
    """Distinct whole numbers within ``2..upper``."""
    return sorted({min(max(int(v), 2), max(2, upper)) for v in values})


def ratio_candidates(tier: str, band: str, n: int) -> list[int]:
    return size_candidates([max(5, int(r * n)) for r in SIZE_RATIOS[tier][band]], max(3, n - 1))


def k_grid(n: int, preset: str = "balanced") -> list[int]:
    """Numbers of clusters to try for few rows."""
    most = max(2, n // 2)
    grid = list(range(2, most + 1)) if n <= 30 else sorted({k for k in (*range(2, 11), *range(12, 21, 2), *range(24, 41, 4), *range(45, 76, 5)) if k <= most} | {most})
    if preset == "coarse":
        grid = [k for k in grid if k <= max(2, min(most, n // 15))] or [2]
    if preset == "fine":
        grid = sorted({*grid, *(k for k in range(15, max(2, n // 3) + 1, 5) if k <= n // 2)})
    return grid


def adaptive_width(n: int, width: int, least: int = 64, most: int = 512) -> int:
    """Reduced width between ``least`` (5 000 rows of 384) and ``most`` (200 000 of 3 072)."""
    score = lambda n, w: math.sqrt(w) * math.log10(n) ** 0.7
    low, high = score(5_000, 384), score(200_000, 3_072)
    share = (score(max(10, n), max(1, width)) - low) / (high - low)
    return min(max(1, width), round(least + min(1.0, max(0.0, share)) * (most - least)))


def medium_width(p) -> int:
    base = adaptive_width(p.n, p.width)
    if p.rank_ratio > 0.35 or p.concentration < 0.12:
        base = int(base * 1.20)
    if p.near_duplicates > 0.10 or p.rank_ratio < 0.12:
        base = int(base * 0.85)
    low, high = 96 if p.width <= 512 else 48, min(p.width, 384)
    return max(min(round(base / 8) * 8, high), min(low, high))


def large_width(p) -> int:
    base = adaptive_width(p.n, p.width)
    if p.rank_ratio > 0.35:
        base = int(base * 1.15)
    if p.memory > 0.5 or p.near_duplicates > 0.10:
        base = int(base * 0.80)
    high = min(p.width, 256)
    return max(min(round(base / 8) * 8, high), min(48, high))


def width_candidates(base: int, width: int) -> list[int]:
    high = min(width, 384)
    return sorted({max(min(round(int(base * s) / 8) * 8, high), min(48, high)) for s in (0.80, 1.0, 1.20)})


def shard_size(p) -> int:
    size = 1000 if p.width > 1536 or p.rank_ratio > 0.35 else 1500
    if p.near_duplicates > 0.10 or p.density_cv < 0.35:
        size = 2500
    return max(800, min(4000, min(size, 1200) if p.memory > 0.6 else size))


def coarse_partitions(p) -> int:
    return max(1, p.n) if p.n <= 1 else max(2, min(math.ceil(p.n / shard_size(p)), 256, p.n))


def large_min_samples(density_cv: float, size: int) -> list[int]:
    part = lambda least, share: max(least, size // share)
    return sorted({1, part(2, 4)} if density_cv < 0.35 else {part(2, 4), part(4, 2)} if density_cv > 0.80 else {part(1, 5), part(2, 3)})


def direct_caps(n: int, density_cv: float, sizes: list[int], neighbours: list[int]) -> tuple[list[int], list[int], tuple[str, ...]]:
    """What the medium tier tries at most: ``(sizes, neighbours, methods)``, fewer for more rows and even density."""
    return sizes[: 4 if n <= 20_000 else 3], neighbours if n <= 25_000 else neighbours[:2], METHODS if density_cv > 0.45 else METHODS[:1]


def manifold_neighbours(n: int) -> int:
    return int(min(max(round(2.2 * math.log2(n)), 10), min(40, n - 1)))


def manifold_width(n: int, width: int) -> int:
    """Grows with the logarithm of the number of clusters that the size suggests."""
    return int(min(max(4 + round(2.5 * math.log2(max(2.0, math.sqrt(n / 8)))), 5), min(15, width)))


def refine_column(score: Column, noise: Column) -> Column:
    """Whether a first solution is weak enough to be refined."""
    return (score < 0.38) | (noise > 0.35)


def blob(largest: float, k: int, separation: float, stability: float) -> bool:
    """Whether one cluster holds so much that a small solution should be refined whatever its score."""
    limit = min(max(1.5 / max(1, k), 0.25), 0.55)
    return largest > limit and (separation < 0.35 or stability < 0.45)


MARGIN = 0.75


def calibrate_floors(runs: list[dict], before: dict | None = None) -> dict[str, dict]:
    """By tier, from runs with ``tier, score, ari, k, n, dataset, embedder``: mean score and agreement, and a floor under the worst; tiers without runs keep what they had."""
    out = dict(before or {})
    for name in ("tiny", "small", "medium", "large"):
        own = [r for r in runs if r["tier"] == name]
        if own:
            worst, n = min(own, key=lambda r: r["score"]), len(own)
            scores = [float(r["score"]) for r in own]  # numpy's own floats don't fit rows
            out[name] = {
                "score": round(sum(scores) / n, 6),
                "ari": round(float(sum(r["ari"] for r in own)) / n, 6),
                "floor": round(min(scores) * MARGIN, 4),
                "k": int(worst["k"]),
                "fixture": f"{worst['dataset']}:{worst['n']}",
                "runs": n,
                "embedders": sorted({r["embedder"] for r in own}),
                "least": round(min(scores), 6),
                "most": round(max(scores), 6),
            }
    return out


def say(config: Config, text: str) -> None:
    """Progress: to the log, on a level that ``verbose`` decides; job groups show the rest in Spark's own pages."""
    logging.getLogger("topicloom").log(logging.INFO if config.verbose else logging.DEBUG, text)


@dataclass
class Config:
    """Options of both kinds of clustering; checked when made."""

    batch_size: int = 64
    normalize_embeddings: bool = True
    random_state: int = 42
    max_samples: int | None = CAP
    extract_keywords: bool = True
    keywords_top_n: int = 10
    cluster_granularity: str = "balanced"
    min_cluster_size: int | None = None
    min_samples: int | None = None
    quality: str = "balanced"
    verbose: bool = False
    allow_oversized: bool = False

    def __post_init__(self):
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        if not whole(self.batch_size) or self.batch_size < 1:
            raise ValueError("batch_size must be a whole number above 0")
        if not whole(self.random_state) or not 0 <= self.random_state < 2**32:
            raise ValueError("random_state must be a whole number in 0..2**32-1")
        for name, least in (("max_samples", 1), ("min_cluster_size", 2), ("min_samples", 1)):
            v = getattr(self, name)
            if v is not None and (not whole(v) or v < least):
                raise ValueError(f"{name} must be None or a whole number of {least} at least")
        if not whole(self.keywords_top_n) or self.keywords_top_n < 1:
            raise ValueError("keywords_top_n must be a whole number above 0")
        if self.cluster_granularity not in GRANULARITY:
            raise ValueError(f"cluster_granularity must be one of {', '.join(GRANULARITY)}")
        if self.quality not in RESTARTS:
            raise ValueError(f"quality must be one of {', '.join(RESTARTS)}")

    @classmethod
    def of(cls, options: dict | Config | None, **more) -> Config:
        if isinstance(options, Config):
            options = {f.name: getattr(options, f.name) for f in fields(options)}
        options = {**(options or {}), **more}
        if unknown := sorted(set(options) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**options)
