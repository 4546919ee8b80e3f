"""Language identification by family, then between the languages of a family.

Hierarchical discrimination: a one-versus-rest linear SVM picks the family and
one-versus-one linear SVMs separate the languages within it; the language with
most votes wins, margins break ties.  Features are hashed byte n-grams of the
whole lower-cased text, as shares of the text's n-grams, so a score is one sum
over positions and long texts need no feature vector.

The machines are fitted on about ``SAMPLE`` documents of each language outside
the held-out fold, and on ``MOST`` over all, a documented bound; prediction
reads nothing but the text.

Defined cases: a text that is null or has no letter gets ``und`` and score 0;
texts of any length are read whole, in pieces of 65 536 characters; rows without
a language teach nothing; a language that no family lists is a family of its
own; with no rows to learn from everything is ``und``; of languages with equally
many votes and margins the first in order is taken; repeated rows, also without
ids, each get a row; columns other than those named may have any name; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_texts, table

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn mr gu pa ur ne",
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}
WIDTH = 1 << 13
#: Training documents of each language, about.
SAMPLE = 400
MOST = 16_000
HELD_OUT = 5
LETTER = re.compile(r"[^\W\d_]")


def buckets(text: str) -> np.ndarray:
    """Bucket of every byte bigram, trigram and 4-gram of the text."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    four = three[:-1] << 8 | b[3:] if len(b) > 3 else three[:0]
    mix = lambda x, salt: (x * np.uint32(2654435761) + np.uint32(salt)) * np.uint32(2246822519) >> np.uint32(32 - 13)
    return np.concatenate([mix(two, 1), mix(three, 77), mix(four, 1234567)])


def shares(text: str) -> np.ndarray:
    h = buckets(text)
    return (np.bincount(h, minlength=WIDTH) / max(1, len(h))).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear SVM, by dual coordinate descent (Hsieh et al., 2008)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1], x.dtype), np.zeros(len(x))
    q = (x * x).sum(axis=1) + 1 / (2 * cost)
    order, rng = np.arange(len(x)), np.random.default_rng(0)
    for _ in range(rounds):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost)
            if (step := max(alpha[i] - g / q[i], 0.0) - alpha[i]) != 0.0:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                most = max(most, abs(step) * q[i])
        if most < 1e-2:
            break
    return w


class Model:
    """``family``: languages by family; ``machines``: weights by the pair that they separate, ``None`` being the rest."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(FAMILY.get(lang, lang), []).append(lang)
        # square roots would need the whole vector; a scale for each bucket keeps the sum over positions
        self.scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(WIDTH)
        x = (x * self.scale).astype(np.float32)
        of = np.array(langs)
        names: list[tuple] = []
        weights = []
        kin = np.array([FAMILY.get(a, a) for a in langs])
        if len(self.families) > 1:
            for name in sorted(self.families):
                names.append((name, None))
                weights.append(linear_svm(x, np.where(kin == name, 1.0, -1.0)))
        for own in self.families.values():
            for a, b in combinations(own, 2):
                k = (of == a) | (of == b)
                names.append((a, b))
                weights.append(linear_svm(x[k], np.where(of[k] == a, 1.0, -1.0)))
        w = np.array(weights).reshape(len(weights), x.shape[1] + 1)
        self.names = names
        self.bias = w[:, -1].copy() if len(weights) else np.zeros(0)
        self.weights = np.ascontiguousarray((w[:, :-1] * self.scale).T.astype(np.float32)) if len(weights) else np.zeros((WIDTH, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        if not self.names:
            return self.langs[0], 1.0
        total, n = np.zeros(len(self.names)), 0
        for at in range(0, len(text), 1 << 16):
            counts = np.bincount(h := buckets(text[at : at + (1 << 16)]), minlength=WIDTH)
            total += counts.astype(np.float32) @ self.weights
            n += len(h)
        margin = dict(zip(self.names, total / n + self.bias, strict=True))
        family = max(sorted(self.families), key=lambda f: margin.get((f, None), 0.0))
        own, sure = self.families[family], 1.0
        if len(self.families) > 1:
            sure = 1 / (1 + np.exp(-2 * margin[family, None]))
        votes = {a: 0.0 for a in own}
        for a, b in combinations(own, 2):
            m = float(margin[a, b])
            votes[a if m >= 0 else b] += 1
            votes[a] += np.tanh(m) / 1e3
            votes[b] -= np.tanh(m) / 1e3
        best = max(own, key=lambda a: votes[a])
        for a, b in combinations(own, 2):
            if best in (a, b):
                sure = min(sure, 1 / (1 + np.exp(-2 * abs(float(margin[a, b])))))
        return best, float(sure)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From ``text`` and ``lang`` of documents outside the held-out fold, about ``sample`` of each language."""
    known = docs.where((fold("doc_id", HELD_OUT) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model(np.zeros((0, WIDTH)), [])
    most, sample = 1 << 30, min(sample, MOST // len(counts))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, sample / n) * most)).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(most)) <= share)

    def make():
        def work(langs, texts):
            return pa.RecordBatch.from_arrays([langs, pa.array([shares(t).tobytes() for t in texts], pa.binary())], names=["lang", "x"])

        return work

    rows = sorted((r[0], bytes(r[1])) for r in map_texts(picked, make, "lang string, x binary", key="lang").collect())
    return Model(np.array([np.frombuffer(b, np.float32) for _, b in rows]), [a for a, _ in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def work(ids, texts):
            got = [predict(t) for t in texts]
            return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return work

    return map_texts(docs, make, "doc_id long, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (fold("doc_id", HELD_OUT) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
ORACLE_SQL: dict[str, str] = {}
