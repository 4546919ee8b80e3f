"""Restoration of words whose letters are disguised at an edge, or spread or stretched at any length."""

from itertools import product

import numpy as np
import pytest

from topicloom.llm import toxicity


def restorer(text):
    counts = np.zeros(toxicity.SIZE**3)
    x = [toxicity.INDEX[c] for c in "  " + text]
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        counts[(a * toxicity.SIZE + b) * toxicity.SIZE + c] += 1
    return toxicity.Restorer(toxicity.log_probabilities(counts))


EDGES = "you stupid idiot will kill an asshole and the ass and the slut said piss to the other people " * 50
PLAIN = str.maketrans("aeiost", "431057")


@pytest.mark.parametrize("word,written", [("stupid", "57up1d"), ("idiot", "1d107"), ("kill", "ki11"), ("piss", "pi$$"), ("ass", "a$$"), ("slut", "$1ut"), ("asshole", "455hole"), ("ass", "455"), ("idiot", "1d107!!!"), ("stupid", "***57up1d")])
def test_disguised_letters_at_an_edge(word, written):
    assert word in restorer(EDGES).restored(f"an {written} here"), written


@pytest.mark.parametrize("word", ["stupid", "idiot", "asshole", "slut", "kill"])
def test_the_plainest_map(word):
    assert word in restorer(EDGES).restored(word.translate(PLAIN)), word


def test_numbers_that_spell_no_word_give_nothing():
    assert restorer(EDGES).restored("on 2926 and 8080 at 999") == []


LONG = "you stupid worthless person went home and left the other quiet people behind the river " * 50


def words(found):
    return {w for x in found for w in x.split()}


def test_spread_sentences_of_any_length_are_segmented():
    r = restorer(LONG)
    sentence = "you stupid worthless person went home and left the other quiet people behind the river"
    for times in (1, 20):
        spread = " ".join("".join([sentence] * times).replace(" ", ""))
        assert set(sentence.split()) <= words(r.restored(spread))
    assert {"stupid", "worthless"} <= words(r.restored(" ".join("stupidworthless")))


@pytest.mark.parametrize("times", [2, 39, 60, 5000])
def test_letters_repeated_any_number_of_times(times):
    assert "stupid" in words(restorer(LONG).restored("a st" + "u" * (times + 1) + "pid one"))


def test_tokens_of_any_length():
    token = ".".join("stupid") + "_" + "-".join("w0rthl3ss") + "-" * 50 + "p30ple"
    got = restorer(LONG).restored(f"a {token} b")
    assert len(token) > 80 and any("stupidworthless" in x for x in got)
    assert len(restorer(LONG).restored("h0me" * 5000)[0]) >= 20_000


@pytest.mark.parametrize(
    "text",
    ["hello-there-my-friend-you-57up1d-and-others-too", "x/y_5tup1d=1", "s  t  u  p  i  d", "s\nt\nu\np\ni\nd", "s t u p i d", "s\u200bt\u200bu\u200bpid", "st\u00adupid", "s\u0442u\u0440\u0456d", "stup\u03b9d", "s. t. u. p. i. d"],
)
def test_joined_spread_and_look_alike_letters(text):
    low = toxicity.readable(f"the {text} here")
    assert "stupid" in words([low, *restorer(LONG).restored(low)]), text


def brute_decode(r, token):
    """The likeliest of all paths through the lattice."""
    best = (-np.inf, "")
    for path in product(*r.lattice(token)):
        word = "".join(c for c, _ in path)
        x = [0, 0, *(toxicity.INDEX.get(c, toxicity.SIZE - 1) for c in word), 0]
        best = max(best, (sum(cost for _, cost in path) + sum(r.logp[k] for k in zip(x, x[1:], x[2:], strict=False)), word), key=lambda y: y[0])
    return best


@pytest.mark.parametrize("token", ["57up1d", "1d107", "st00pid", "a$$", "p!!l|", "w*rth"])
def test_viterbi_finds_the_likeliest_of_all_paths(token):
    r = restorer(LONG)
    score, word = brute_decode(r, token)
    assert r.decode(token) == word and np.isfinite(score)


def test_query(spark):
    from zlib import crc32

    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    # the table has some forty toxic rows to learn from: what is flagged is toxic, and most that is toxic is flagged
    caught, flagged, toxic = sum(a and b for a, b in held), sum(b for _, b in held), sum(a for a, _ in held)
    print(f"{caught} caught of {toxic} toxic, {flagged} flagged, {len(held)} held out")
    assert caught >= 0.95 * flagged and caught >= 0.6 * toxic


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int, words string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
