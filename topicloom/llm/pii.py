"""Personal data by rules and by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Further candidates (secrets, national ids, loosely written phone and account
numbers) are voted on by three labelers, each of which looks at something else
and may abstain: a pattern labeler checks how the candidate is built (checksums,
ranges, mixture of signs), a gazetteer labeler looks up its parts (prefixes of
issued keys, country codes and lengths of accounts, area codes, numbers known
to be specimens, dates), and a context labeler reads the words around it.
Expectation-maximisation over the counts of all vote patterns in the corpus
estimates, for each kind of candidate, how reliable each labeler is (Dawid &
Skene, 1979); the posteriors then train a logistic span classifier that sees
shape and context but no votes, and a candidate is a span if the classifier
says so.

Votes and features fall into a fixed number of patterns, so the corpus sends
the driver their counts only, whatever its size.

Defined cases: a null text counts as empty; texts of any length are searched
whole; repeated rows, also without ids, each get a row; columns other than
``doc_id`` and ``text`` may have any name; an empty table gives an empty one
and accepts no pattern; a classifier that is undecided rejects; offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, table

KINDS = ("email", "ip", "card", "phone", "secret", "id", "contact", "account")
RANK = {k: i for i, k in enumerate(KINDS)}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits starts and takes whole runs, so a failing run is passed once
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(
    r"(?P<id>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<contact>(?<![0-9A-Za-z+(-])(?:\+[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<account>(?<![0-9A-Za-z-])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{9,19})(?![0-9A-Za-z_/+=-]))"
    r"|(?P<secret>(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}={0,2})"
)
_HINT = re.compile(r"[0-9]")
_CUE = re.compile(r"[\w]+")
_ASSIGN = re.compile(r"[=:]\s*[\"']?\Z")
#: Words that announce a kind, for the context labeler.
CUES = {
    "secret": frozenset("token secret password passwd pwd key apikey api_key auth bearer credential credentials passphrase passwort schlüssel clé clave contraseña mot".split()),
    "id": frozenset("ssn social security insurance tax taxpayer passport ausweis seguro".split()),
    "contact": frozenset("phone tel telephone telefon téléphone teléfono mobile cell fax call contact reach dial".split()),
    "account": frozenset("iban account acct bank konto kontonummer cuenta compte passport".split()),
}
#: Words that announce a number of another sort.
OTHER = frozenset("order invoice page version isbn issn serial build commit sha md5 checksum hash figure table section line total chapter volume".split())
#: How keys that are issued begin.
KEY_PREFIXES = ("sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "SG.", "npm_", "hf_")
#: Length of an account number by country.
IBAN = dict(zip("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK TR".split(), (24, 23, 20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 27, 21, 28, 22, 26, 27, 21, 20, 20, 21, 27, 31, 18, 15, 28, 25, 24, 22, 24, 19, 24, 26), strict=True))
#: Area codes that aren't those of a place or a service, codes of countries, and numbers that are printed as specimens.
NO_AREA = frozenset("000 111 123 200 211 222 311 333 411 444 511 555 611 666 711 777 811 911 999".split())
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 356 357 358 359 370 371 372 380 385 386 420 421 852 886 971 972".split())
SPECIMENS = frozenset("078-05-1120 219-09-9999 123-45-6789 111-11-1111".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then in the order of the kinds."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end(), "email"))
        # a start further right would need a later @, so the next @ decides
        at = text.find("@", max(at + 1, end))
    if _HINT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    out.sort(key=lambda s: (s[0], RANK[s[2]]))
    return out


def _mod97(t: str) -> bool:
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _pattern_vote(kind: str, t: str, digits: int) -> str:
    if kind == "secret":
        hexa = len(t) >= 32 and all(c in "0123456789abcdefABCDEF" for c in t)
        return "1" if hexa or 0.1 <= digits / len(t) <= 0.8 else "0"
    if kind == "id":
        return "1" if t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000" else "0"
    if kind == "contact":
        d = "".join(c for c in t if c.isdigit())[-10:]
        return "1" if d[0] > "1" and d[3] > "1" else "0"
    if t[0].isalpha():
        return "1" if _mod97(t) else "0"
    # longer numbers have a check digit; shorter ones can't be checked
    return "-" if len(t) < 14 else "1" if luhn(t) else "0"


def _gazetteer_vote(kind: str, t: str) -> str:
    if kind == "secret":
        return "1" if t.startswith(KEY_PREFIXES) else "-"
    if kind == "id":
        return "0" if t in SPECIMENS else "-"
    if kind == "contact":
        d = "".join(c for c in t if c.isdigit())
        return "0" if d[-10:-7] in NO_AREA else "1" if t[0] == "+" and d[:-10] in COUNTRIES else "-"
    if t[0].isalpha():
        return "1" if IBAN.get(t[:2]) == len(t) else "0"
    # a date, or seconds since 1970
    dated = t[:2] in ("19", "20") and "01" <= t[4:6] <= "12" and "01" <= t[6:8] <= "31"
    return "0" if dated or len(t) in (10, 13) and t[0] == "1" else "-"


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """Loose candidates that touch no base span, with their pattern: three votes (``-`` abstains) and the features."""
    if not _HINT.search(text):
        return []
    out, k = [], 0
    for m in _LOOSE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][1] <= s:
            k += 1
        if any(b[0] < e for b in base[k : k + 4]):
            continue
        kind, t = m.lastgroup, m[0]
        digits = sum(map(t.count, "0123456789"))
        before, after = text[max(0, s - 40) : s], text[e : e + 20]
        words = [w.lower() for w in _CUE.findall(before)[-3:]]
        near = [*words, *(w.lower() for w in _CUE.findall(after)[:2])]
        assigned, cues = bool(_ASSIGN.search(before)), CUES[kind]
        cued = next((i for i, w in enumerate(reversed(words)) if w in cues or any(x in cues for x in w.split("_"))), 3)
        context = "1" if cued < 3 or any(w in cues for w in near) else "0" if any(w in OTHER for w in words) or not assigned and near else "-"
        hexa = all(c in "0123456789abcdefABCDEF" for c in t)
        mixed = any(c.islower() for c in t) + any(c.isupper() for c in t)
        shape = f"{kind[0]}{min(3, len(t) // 12)}{min(3, digits * 4 // len(t))}{int(hexa)}{mixed}{int(before[-1:] in chr(34) + chr(39) and before != '')}{int(assigned)}{cued}"
        out.append((s, e, kind, _pattern_vote(kind, t, digits) + _gazetteer_vote(kind, t) + context + shape))
    return out


#: Pseudo-counts of a labeler's right and wrong votes, and of spans and others.
RIGHT, WRONG, EITHER = 8.0, 2.0, 1.0


def log_posterior(votes: list[str], count: np.ndarray, prior: float, rate: np.ndarray) -> float:
    """Of the vote patterns; ``rate[c, j]`` is how often labeler ``j``, when it votes, says span on class ``c`` (0 spans, 1 others)."""
    total = EITHER * (np.log(prior) + np.log(1 - prior)) + float((RIGHT * (np.log(rate[0]) + np.log(1 - rate[1])) + WRONG * (np.log(1 - rate[0]) + np.log(rate[1]))).sum())
    for v, n in zip(votes, count, strict=True):
        p = [prior, 1 - prior]
        for c in (0, 1):
            for j, x in enumerate(v):
                p[c] *= {"1": rate[c, j], "0": 1 - rate[c, j], "-": 1.0}[x]
        total += n * np.log(p[0] + p[1])
    return total


def dawid_skene(votes: list[str], count: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """``(posterior of each vote pattern, share of spans, rates)`` that maximise :func:`log_posterior`; who abstains says nothing."""
    said = np.array([[c == "1" for c in v] for v in votes], float).reshape(len(votes), -1)
    spoke = np.array([[c != "-" for c in v] for v in votes], float).reshape(len(votes), -1)
    prior, rate = 0.5, np.tile([[0.8], [0.2]], (1, said.shape[1]))
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        like = [np.log(p) + (spoke * (said * np.log(r) + (1 - said) * np.log(1 - r))).sum(axis=1) for p, r in ((prior, rate[0]), (1 - prior, rate[1]))]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
        weight = np.stack([new, 1 - new]) * count
        rate = (weight @ (spoke * said) + np.array([[RIGHT], [WRONG]])) / (weight @ spoke + RIGHT + WRONG)
        prior = float((weight[0].sum() + EITHER) / (count.sum() + 2 * EITHER))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, prior, rate


def _features(shape: str) -> list[float]:
    """Of a shape's signs; the lengths, shares of digits and so on of each kind have weights of their own."""
    kind = [float(shape[0] == k[0]) for k in KINDS[4:]]
    own = [*(float(shape[1] == d) for d in "0123"), *(float(shape[2] == d) for d in "0123"), float(shape[3]), *(float(shape[4] == d) for d in "012"), float(shape[5]), float(shape[6]), *(float(shape[7] == d) for d in "0123")]
    return [1.0, *kind, *own, *(k * x for k in kind for x in own)]


def train(counts: dict[str, int]) -> list[str]:
    """Accepted shapes, from the number of candidates of each pattern."""
    by_kind: dict[str, dict[str, int]] = {}
    for k, n in counts.items():
        own = by_kind.setdefault(k[3], {})
        own[k[:3]] = own.get(k[:3], 0) + n
    span: dict[tuple[str, str], float] = {}
    for kind, own in by_kind.items():
        votes = sorted(own)
        post, *_ = dawid_skene(votes, np.array([own[v] for v in votes], float))
        span |= {(kind, v): float(p) for v, p in zip(votes, post, strict=True)}
    # a shape's share of spans is what the classifier learns
    n: dict[str, float] = {}
    hit: dict[str, float] = {}
    for k, c in counts.items():
        n[k[3:]] = n.get(k[3:], 0.0) + c
        hit[k[3:]] = hit.get(k[3:], 0.0) + c * span[k[3], k[:3]]
    shapes = sorted(n)
    if not shapes:
        return []
    x, w = np.array([_features(k) for k in shapes]), None
    w = np.zeros(x.shape[1])
    weight, y = np.array([n[k] for k in shapes]), np.array([hit[k] / n[k] for k in shapes])
    for _ in range(100):  # Newton steps of a weighted, ridge-regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.1 * w)
        w += step * min(1.0, 4.0 / np.abs(step).max()) if step.any() else 0.0
        if np.abs(step).max() < 1e-8:
            break
    return [k for k, s in zip(shapes, x @ w, strict=True) if s > 0]


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base`` spans and candidate spans ``more`` as written, a row for each row."""

    def make():
        def work(ids, texts):
            n = {k: [] for k in KINDS[:4]}
            base, more = [], []
            for t in texts:
                b = base_spans(t or "")
                for k, v in n.items():
                    v.append(sum(s[2] == k for s in b))
                base.append([f"{k}:{s}:{e}" for s, e, k in b])
                more.append([f"{k}:{s}:{e}:{p}" for s, e, k, p in candidates(t or "", b)])
            strings = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in n.values()), pa.array(base, strings), pa.array(more, strings)], names=["doc_id", *(f"n_{k}" for k in n), "base", "more"])

        return work

    return map_texts(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, more array<string>")


def accepted_patterns(found: DataFrame) -> list[str]:
    """Shapes that the classifier accepts, trained on the candidates of :func:`extract` over all documents."""
    pattern = found.select(F.explode("more").alias("c")).select(F.substring_index("c", ":", -1).alias("pattern"))
    return train({r[0]: r[1] for r in pattern.groupBy("pattern").count().collect()})


def annotate(found: DataFrame, accepted: list[str]) -> DataFrame:
    """The rows of :func:`extract` with ``all``, base and accepted spans by start and kind."""
    good = F.array(*(F.lit(p) for p in accepted)).cast("array<string>")
    shape = lambda c: F.substring(F.substring_index(c, ":", -1), 4, 99)
    more = F.transform(F.filter("more", lambda c: F.array_contains(good, shape(c))), lambda c: F.substring_index(c, ":", 3))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(F.concat("base", more), lambda c: F.struct(F.split_part(c, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.array_position(kinds, F.split_part(c, F.lit(":"), F.lit(1))).alias("k"), c.alias("c")))
    return found.withColumn("all", F.transform(F.array_sort(keyed), lambda x: x["c"]))


def redact(docs: DataFrame, accepted: list[str]) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets, and ``n_chars`` set anew."""
    columns = docs.columns
    at, good = columns.index("text"), frozenset(accepted)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        b = base_spans(t)
        spans = sorted([*b, *((s, e, k) for s, e, k, p in candidates(t, b) if p[3:] in good)])
        out, done = [], 0
        for s, e, k in spans:
            if s >= done:
                out.append(t[done:s] + f"[{k.upper()}]")
            done = max(done, e)
        return "".join(out) + t[done:] if spans else t

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                cols = list(batch.columns)
                texts = [clean(t) for t in batch.column(at).to_pylist()]
                cols[at] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    cols[columns.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(extract(table(spark, sf_dir, "documents")))
    done = annotate(found, accepted_patterns(found))
    return done.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "all").alias("spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}
