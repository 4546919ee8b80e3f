"""Toxicity scores of restored text.

Noisy channel: written characters are letters that were replaced by look-alike
signs, spread out with separators, or repeated.  A token that shows any of this
becomes a lattice of letters, and Viterbi decoding under a character trigram
model picks the likeliest restoration.  The trigram model counts all documents;
the score is a logistic regression over the words of the text and of its
restorations, and over their beginnings, fitted on a bounded sample of labelled
documents (``SAMPLE``) outside the held-out fold.

Before that, signs of no width are left out, and letters of other scripts that
look like Latin ones are read as those in words that mix scripts.  Letters may
be spread with up to three spaces, line breaks or separators between them.

The classifier has ``FEATURES`` features at most, those that tell the labels
apart best; of equals the first in order.

Defined cases: null and empty texts score as texts without words; texts,
tokens, runs and repeats of any length are decoded whole; unlabelled rows and
null labels teach nothing; several labels of a document count if they agree on
at least one 1; repeated rows, also without ids, each get a row; without
labelled rows of both kinds every score is the share of toxic rows (0 without
any); of restorations that are equally likely the first is taken; columns other
than those named may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, map_texts, table

HELD_OUT = 4
HELD_FOLD = 2
#: Labelled documents to fit on, about: this many toxic ones and twice as many others.
SAMPLE = 2500
FEATURES = 3000
THRESHOLD = 0.3

LOOKS = {"@": "a", "4": "a", "3": "e", "1": "il", "!": "i", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "*": "aeiou", "#": "h", "€": "e", "£": "l"}
SIGNS = "".join(re.escape(c) for c in LOOKS)
_SIGN = re.compile(f"[{SIGNS}]")
_SPREAD = re.compile(r"(?<!\w)[^\W_](?:[\s._*\-]{1,3}[^\W_](?!\w)){3,}")
_JOINT = re.compile(r"[-_./,;:=]+")
_LETTER = re.compile(r"[^\W_]")
_NO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_MIXED = re.compile("[a-z][\u0370-\u04ff]|[\u0370-\u04ff][a-z]")
LATIN = str.maketrans("авсеіјкмнорѕтухԁαβεικνορτυχ", "abceijkmhopstyxdabeiknoptux")
_REPEAT = re.compile(r"([^\W\d_])\1\1+")
_WORD = re.compile(r"[^\W\d_]+")
_EDGES = tuple(re.compile(x) for x in (f"^[{SIGNS}.,;:?]{{2,}}", f"[{SIGNS}.,;:?]{{2,}}$"))
_LONG_RUN = re.compile(r"(\S)\1{3,}")
#: Tokens of at most so many characters are remembered with what they decode to.
REMEMBERED = 40
#: Of a token with fewer than two letters, as numbers are, a restoration counts from this mean log probability of its letters on.
LIKELY = -3.0

ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
SIZE = 64
_CODE = np.full(0x10000, SIZE - 1, np.uint32)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
for _c in map(chr, range(0x180)):
    if not _c.isalpha():
        _CODE[ord(_c)] = 0
INDEX = {c: i for i, c in enumerate(ALPHABET)}


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, in one table of fixed size."""

    def run(batches):
        total, held, size = np.zeros(SIZE**3, np.int64), [], 0

        def flush():
            nonlocal total, size
            x = _CODE[np.minimum(np.concatenate(held), 0xFFFF)]
            total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
            held.clear()
            size = 0

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.append(np.frombuffer(f"  {t.lower()} ".encode("utf-32-le", "replace"), np.uint32))
                    size += len(held[-1])
                if size > 1 << 18:
                    flush()
        if held:
            flush()
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    for code, n in rows:
        out[code] = n
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log P(third | first two), interpolated with the lower orders (Witten-Bell)."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
    kinds = (c2 > 0).sum(axis=1, keepdims=True)
    p2 = (c2 + kinds * p) / np.maximum(c2.sum(axis=1, keepdims=True) + kinds, 1e-9)
    p2[kinds[:, 0] == 0] = p
    kinds = (c3 > 0).sum(axis=2, keepdims=True)
    total = c3.sum(axis=2, keepdims=True) + kinds
    p3 = np.where(total > 0, (c3 + kinds * p2[None]) / np.maximum(total, 1e-9), p2[None])
    return np.log(np.maximum(p3, 1e-12))


class Restorer:
    """Viterbi decoding of written tokens under a letter trigram model."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp
        self.flat: list[float] = logp.ravel().tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per position the strings that may have been meant, with log channel probabilities; the empty string is a separator or a repeat."""
        out: list[list[tuple[str, float]]] = []
        for i, c in enumerate(token):
            if c in LOOKS:
                out.append([(x, -1.0 - log(len(LOOKS[c]))) for x in LOOKS[c]] + [("", -3.0)])
            elif c in INDEX and c != " ":
                again = i and token[i - 1] == c
                out.append([(c, -1.2 if again else -0.05), *([("", -0.4)] if again else [])])
            elif c.isalpha():
                out.append([(c, 0.0)])
            else:
                out.append([("", -0.1)])
        return out

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest letters of a token of any length; with ``spaced``, words may begin at any letter."""
        token = _LONG_RUN.sub(r"\1\1\1", token)  # no word has more
        if (found := self.known.get((token, spaced))) is not None:
            return found
        flat = self.flat
        # a state is the last two letters; its path is a chain of (path before, letters), which states share
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for at, options in enumerate(self.lattice(token)):
            new: dict[int, tuple[float, tuple | None]] = {}
            steps = [(c, cost, INDEX.get(c, SIZE - 1)) for c, cost in options]
            for ab, (score, path) in states.items():
                row, b = ab * SIZE, ab % SIZE * SIZE
                for c, cost, k in steps:
                    if not c:
                        key, s = ab, score + cost
                    else:
                        key, s = b + k, score + cost + flat[row + k]
                        if spaced and at:
                            apart = score + cost + flat[row] + flat[b * SIZE + k]
                            if k not in new or apart > new[k][0]:
                                new[k] = (apart, (path, " " + c))
                    if key not in new or s > new[key][0]:
                        new[key] = (s, (path, c) if c else path)
            states = new
        path = max(((s + flat[ab * SIZE], -n, path) for n, (ab, (s, path)) in enumerate(states.items())), key=lambda x: x[:2])[2]
        letters: list[str] = []
        while path:
            path, c = path
            letters.append(c)
        best = "".join(reversed(letters))
        if len(token) <= REMEMBERED:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token, spaced] = best
        return best

    @staticmethod
    def forms(token: str) -> list[str]:
        """The token as written, where its outer signs may be letters, and without those of either end or both."""
        left, right = (x.sub("", token) for x in _EDGES)
        return list(dict.fromkeys((token, left, right, _EDGES[1].sub("", left))))

    def likely(self, word: str) -> bool:
        x = [0, 0, *(INDEX.get(c, SIZE - 1) for c in word), 0]
        return len(word) >= 3 and sum(self.logp[k] for k in zip(x, x[1:], x[2:], strict=False)) >= LIKELY * (len(x) - 2)

    def restored(self, text: str) -> list[str]:
        """Restorations of the tokens of a lower-cased text that look disguised."""
        out, done = [], 0
        for m in _SIGN.finditer(text):
            if (at := m.start()) < done:
                continue
            start = at
            while start > done and not text[start - 1].isspace():
                start -= 1
            end, n = at + 1, len(text)
            while end < n and not text[end].isspace():
                end += 1
            done = end
            whole = text[start:end].strip(".,;:?\"'()")
            parts = [x for x in _JOINT.split(whole) if len(x) >= 3 and _SIGN.search(x)]
            for token in dict.fromkeys(f for x in ([whole, *parts] if parts != [whole] else [whole]) for f in self.forms(x)):
                if len(token) >= 3 and _SIGN.search(token):
                    found = self.decode(token)
                    if sum(map(str.isalpha, token)) >= 2 or self.likely(found):
                        out.append(found)
        for m in _SPREAD.finditer(text):
            parts = "".join(_LETTER.findall(m[0]))
            if len(set(parts)) > 2:
                # one word, or several
                out.extend(dict.fromkeys((self.decode(parts), self.decode(parts, spaced=True))))
        done = 0
        for m in _REPEAT.finditer(text):
            start, end = m.span()
            if start < done:
                continue
            while start > done and text[start - 1].isalpha():
                start -= 1
            while end < len(text) and text[end].isalpha():
                end += 1
            done = end
            out.append(self.decode(text[start:end]))
        return out


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which name a family of words."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6, 7) if len(word) > k)]


def readable(text: str) -> str:
    """Lower case, without signs of no width and with look-alikes of Latin letters as those, in words that mix scripts."""
    low = text.lower()
    if low.isascii():
        return low
    low = _NO_WIDTH.sub("", low)
    return _WORD.sub(lambda m: m[0].translate(LATIN) if _MIXED.search(m[0]) else m[0], low) if _MIXED.search(low) else low


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    low = readable(text or "")
    found = set(_WORD.findall(low))
    for r in restorer.restored(low):
        found.update(_WORD.findall(r))
    return found


class Model:
    def __init__(self, logp: np.ndarray, weights: dict[str, float], bias: float):
        self.logp, self.weights, self.bias = logp.astype(np.float32), weights, bias
        self.restorer: Restorer | None = None
        self.of_word: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"restorer": None, "of_word": {}}

    def score(self, text: str | None) -> float:
        self.restorer = self.restorer or Restorer(self.logp)
        hit: set[str] = set()
        get, of_word = self.of_word.get, self.of_word
        for w in words_of(text, self.restorer):
            f = get(w)
            if f is None:
                f = tuple(x for x in features_of(w) if x in self.weights)
                if len(of_word) > 300_000:
                    of_word.clear()
                of_word[w] = f
            if f:
                hit.update(f)
        z = self.bias + sum(self.weights[x] for x in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], np.float32)
    v, prev = w.copy(), w.copy()
    u = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature bounds the step
        u = x.T @ (x @ u)
        top = float(np.sqrt((u * u).sum()))
        u /= max(top, 1e-9)
    size = 0.25 * 1.05 * top + ridge
    keep = np.ones(len(w), np.float32)
    keep[-1] = 0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        w = v - (x.T @ (p - y) + ridge * keep * v) / size
        v = w + (t / (t + 3)) * (w - prev)
        prev = w
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    logp = log_probabilities(trigram_counts(docs))
    known = labels.where((fold("doc_id", HELD_OUT) != HELD_FOLD) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total = sum(n.values())
    rate = n.get(1, 0) / total if total else 0.0
    if not n.get(1) or not n.get(0):
        return Model(logp, {}, 30.0 if rate else -30.0)
    most = 1 << 30
    share = {1: min(1.0, sample / n[1]), 0: min(1.0, 2 * sample / n[0])}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(most))
    picked = known.where(draw <= F.when(F.col("toxic") == 1, int(share[1] * most)).otherwise(int(share[0] * most)))
    # at most about 3 * sample ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))

    def make():
        restorer = Restorer(shared.value)

        def work(toxic, texts):
            return pa.RecordBatch.from_arrays([toxic, pa.array([sorted(words_of(t, restorer)) for t in texts], pa.list_(pa.string()))], names=["toxic", "words"])

        return work

    seen = cut(map_texts(rows, make, "toxic int, words array<string>", key="toxic"))
    prefix = lambda k: F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    wide = seen.select("toxic", F.array_distinct(F.concat("words", *(prefix(k) for k in (4, 5, 6, 7)))).alias("f"))
    size = {r[0]: r[1] for r in wide.groupBy("toxic").count().collect()}
    a, b = size.get(1, 0), size.get(0, 0)
    if not a or not b:
        return Model(logp, {}, log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    counts = wide.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    # signed evidence: log-odds of the shares, in units of its error
    odds = F.log((F.col("t") + 0.5) / (a + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (b + 1.0))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    best = [r[0] for r in counts.where("n >= 8").withColumn("z", F.abs(z)).where("z > 3.5").orderBy(F.desc("z"), "f").limit(features).collect()]
    at = {f: i for i, f in enumerate(best)}
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(best))

    def keep(batches):
        for batch in batches:
            rows = [sorted({f for w in ws for f in features_of(w) if f in chosen.value}) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "f"])

    data = sorted((r[0], list(r[1])) for r in seen.mapInArrow(keep, "toxic int, f array<string>").collect())
    x = np.zeros((len(data), len(best)), np.float32)
    for i, (_, f) in enumerate(data):
        x[i, [at[k] for k in f]] = 1
    y = np.array([t for t, _ in data], np.float32)
    w = logistic(x, y)
    # the sample holds toxic rows more often than the labels do
    bias = float(w[-1]) + log(share[0] / share[1])
    return Model(logp, {f: float(v) for f, v in zip(best, w, strict=False)}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = shared.value.score

        def work(ids, texts):
            return pa.RecordBatch.from_arrays([ids, pa.array([of(t) for t in texts], pa.float64())], names=["doc_id", "score"])

        return work

    return map_texts(docs, make, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", HELD_OUT) == HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
