"""The machines against their objective and predictions against whole vectors; the query's contract."""

from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from topicloom.llm import language

COST = 10.0


def loss(w, x, y):
    """The primal problem of a squared-hinge machine whose bias is regularised like a weight."""
    return 0.5 * w @ w + COST * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()


def test_machines_minimise_their_objective():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 6)).astype(np.float32)
    y = np.where(x @ rng.standard_normal(6) + 0.7 * rng.standard_normal(120) > 0, 1.0, -1.0)
    w = language.linear_svm(x, y, COST, rounds=2000).astype(float)
    full = np.hstack([x, np.ones((120, 1))])
    least = loss(w, full, y)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.03, 7), full, y) >= least - 1e-2


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    words = {"en": "the house and weather through which shall", "de": "das haus und straße durch welche schön", "fr": "la maison et été par laquelle être", "es": "la casa su verano por cual mañana", "xx": "qua qui quo zzz"}
    texts = [(" ".join(rng.choice(w.split(), 30)), a) for a, w in words.items() for _ in range(20)]
    return language.Model(np.array([language.shares(t) for t, _ in texts]), [a for _, a in texts])


def brute(model, text):
    """Family by the largest one-versus-rest margin, then votes of every pair within it, from the whole vector."""
    x = language.shares(text) @ model.weights + model.bias
    margin = dict(zip(model.names, x, strict=True))
    family = max(sorted(model.families), key=lambda f: margin[f, None])
    own = model.families[family]
    votes = {a: sum((margin[p] >= 0) == (p[0] == a) for p in combinations(own, 2) if a in p) for a in own}
    return {a for a in own if votes[a] == max(votes.values())}


@pytest.mark.parametrize("text", ["the house which shall", "das schön", "été par la", "mañana por", "zzz", "mixed house und casa", "x", "the weather " * 9000])
def test_predictions_are_those_of_the_whole_vector(model, text):
    lang, score = model.predict(text)
    assert lang in brute(model, text) and 0 <= score <= 1


def test_query(spark):
    rows = language.op3_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    known = {r.lang for r in docs.values() if r.lang}
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not language.LETTER.search(docs[r.doc_id].text or "") else r.lang_pred in known
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert np.mean(held) > 0.95


def test_odd_columns_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, x binary, key int, score int")
    assert language.identify(none, language.fit(none)).count() == 0
