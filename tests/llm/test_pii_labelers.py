"""Labelers, expectation-maximisation against its likelihood, and the spans that are found."""

import hashlib
import random

import numpy as np
import pytest

from topicloom.llm import pii

SCHEMA = "doc_id long, text string, lang string, base int, more string, n_chars long"
HEX = "0123456789abcdef" * 2
IBAN = "DE89370400440532013000"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "x", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def only(text):
    (found,) = pii.candidates(text, pii.base_spans(text))
    return text[found[0] : found[1]], found[2], found[3][:3]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"token={HEX}", (HEX, "secret", "1-1")),
        (f"api_key: '{'x' * 45}1234567890'", ("x" * 45 + "1234567890", "secret", "1-1")),
        ("run ghp_a1b2c3d4e5f6a1b2c3d4e5f6 now", ("ghp_a1b2c3d4e5f6a1b2c3d4e5f6", "secret", "110")),
        ("see the internationalisation1-of-everything", ("internationalisation1-of-everything", "secret", "0-0")),
        (f"iban {IBAN} please", (IBAN, "account", "111")),
        ("iban DE89370400440532013001", ("DE89370400440532013001", "account", "011")),
        ("on 20250101 we", None),
        ("on 202501010 we", ("202501010", "account", "-00")),
        ("made 9807915762804490 times", ("9807915762804490", "account", "0-0")),
        ("ssn 536-22-1234", ("536-22-1234", "id", "1-1")),
        ("ssn 078-05-1120", ("078-05-1120", "id", "101")),
        ("call (212) 234-5678", ("(212) 234-5678", "contact", "1-1")),
        ("Des +1 (826) 555-4081 190.137", ("+1 (826) 555-4081", "contact", "110")),
        ("order 555-234-5678 came", ("555-234-5678", "contact", "100")),
    ],
)
def test_votes(text, want):
    assert (only(text) if want else pii.candidates(text, [])) == (want or [])


def test_expectation_maximisation_reaches_a_maximum_of_the_posterior():
    rng = np.random.default_rng(0)
    votes = [a + b + c for a in "01-" for b in "01-" for c in "01-"]
    count = rng.integers(1, 60, len(votes)).astype(float)
    post, prior, rate = pii.dawid_skene(votes, count)
    best = pii.log_posterior(votes, count, prior, rate)
    for _ in range(300):
        p, r = np.clip(prior + rng.normal(0, 0.02), 0.01, 0.99), np.clip(rate + rng.normal(0, 0.02, rate.shape), 0.01, 0.99)
        assert pii.log_posterior(votes, count, p, r) <= best + 1e-6
    for v, got in zip(votes, post, strict=True):  # Bayes' rule, by hand
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            a *= {"1": rate[0, j], "0": 1 - rate[0, j], "-": 1}[x]
            b *= {"1": rate[1, j], "0": 1 - rate[1, j], "-": 1}[x]
        assert abs(got - a / (a + b)) < 1e-4


def test_reliabilities_are_those_that_made_the_votes():
    rng = random.Random(1)
    count = {}
    for _ in range(20_000):
        z = rng.random() < 0.4
        v = "".join("-" if rng.random() < 0.2 else "1" if rng.random() < (hit if z else miss) else "0" for hit, miss in ((0.9, 0.1), (0.8, 0.05), (0.7, 0.2)))
        count[v] = count.get(v, 0) + 1
    _, prior, rate = pii.dawid_skene(sorted(count), np.array([count[v] for v in sorted(count)], float))
    assert abs(prior - 0.4) < 0.03 and np.abs(rate - np.array([[0.9, 0.8, 0.7], [0.1, 0.05, 0.2]])).max() < 0.04


def corpus():
    rng = random.Random(2)
    code = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    yes = [f'w{i} token = "{code()}" w' for i in range(30)] + [f"secret={code()} w" for _ in range(20)] + [f"pay to iban {IBAN} now"] * 20
    no = ["made 9807915762804490 times in all"] * 30 + ["plain 20250101 words"] * 20
    return yes, no


def test_spans_of_odd_texts(spark):
    yes, no = corpus()
    d = documents(spark, [None, "", "é" * 50_000 + " mail a.b@c.de or +1 (555) 010-9999", *yes, *no])
    found = pii.extract(d)
    accepted = pii.accepted_patterns(found)
    rows = {r.doc_id: r for r in pii.annotate(found, accepted).collect()}
    assert rows[0].base == rows[1].base == [] and rows[2].n_email == 1 and rows[2].n_phone == 1
    assert rows[2].base[0] == "email:50006:50014"
    for i in range(3, 53):
        assert rows[i]["all"][0].startswith("secret:")
    assert all(rows[i]["all"] == ["account:12:34"] for i in range(53, 73))
    assert not any(rows[i]["all"] for i in range(73, 123))
    clean = {r.doc_id: r for r in pii.redact(d, accepted).collect()}
    assert "[EMAIL]" in clean[2].text and "[PHONE]" in clean[2].text and clean[2].n_chars == len(clean[2].text)
    assert clean[0].text is None and clean[80].text == no[7] and clean[60].text == "pay to iban [ACCOUNT] now"
    assert pii.accepted_patterns(pii.extract(documents(spark, []))) == [] and pii.redact(documents(spark, []), []).count() == 0


def test_query(spark):
    rows = pii.op2_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = pii.base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in pii.KINDS[:4]]
        at = [(int(x.split(":")[1]), pii.RANK[x.split(":")[0]]) for x in r.spans.split(",") if x]
        assert at == sorted(at)
