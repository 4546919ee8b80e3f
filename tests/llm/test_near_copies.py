"""Near copies by shingle similarity, against all pairs and with planted edits."""

import random

import pytest

from topicloom.llm import components, hot_groups, near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    own, root = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(text, rng, edits):
    w = text.split()
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [1024, 3])
def test_planted_copies_are_linked_as_all_pairs_say(spark, block):
    rng = random.Random(3)
    make = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    texts = [make() for _ in range(30)]
    for k in range(12):
        texts += [edited(texts[k], rng, e) for e in (1, 2, 3, 4, 5, 7)]
    texts += [None, "", " ", "a b", "A  b", "a c", texts[0].upper()]
    root = brute_groups(texts)
    planted = [max(len(brute_set(t) & brute_set(b)) / len(brute_set(t) | brute_set(b)) for b in texts[:12]) for t in texts[30:102]]
    assert sum(0.8 <= x <= 0.95 for x in planted) > 30 and min(planted) < 0.8
    fp = [near_copies.bits_of(near_copies.shingle_hashes(t)) for t in texts]
    for i in range(len(texts)):  # and links within three bits
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents(spark, texts), block=block).collect()}
    assert [got[i] for i in range(len(texts))] == root


@pytest.mark.parametrize("cells", [1 << 24, 0])
def test_links_of_a_bucket(monkeypatch, cells):
    import numpy as np

    monkeypatch.setattr(near_copies, "CELLS", cells)
    rng = np.random.default_rng(0)
    base = [rng.choice(10**6, 60, replace=False).astype(np.uint64) for _ in range(4)]
    sets = []
    for b in base:
        for _ in range(12):
            own = b.copy()
            own[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(10**6, 10**7)
            sets.append(np.unique(own))
    got = near_copies.similar_links(sets, 0.8)
    root, want = list(range(48)), list(range(48))
    for i in range(48):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((want[i], want[j]))
                want = [a if r == b else r for r in want]
    for i, j in got:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    assert root == want and len(got) <= 47 and len(set(want)) > 4


def test_members_apart_from_the_leader_meet_every_block(spark):
    # nodes 0..39 in one group: 0..19 hang together, 20 and 39 do, 25..30 form a chain, the rest stand alone
    want = {(i, i + 1) for i in range(19)} | {(20, 39)} | {(i, i + 1) for i in range(25, 30)}
    rows = spark.createDataFrame([(7, i, None) for i in range(40)], "key long, node long, own binary")
    links = lambda ids, _: [(a, b) for a in ids for b in ids if (a, b) in want]
    got = {(r.u, r.v) for r in hot_groups.hot_links(rows, links, 6).collect()}
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(sorted(got), "u long, v long")).collect()}
    assert got <= want and roots == {**dict.fromkeys(range(20), 0), 20: 20, 39: 20, **dict.fromkeys(range(25, 31), 25)}


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    texts = base + [edited(t, rng, e) for t in base for e in (1, 2, 3, 4)]
    root = brute_groups(texts)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").collect()}
    assert kept == set(root) == set(range(20))


def test_empty_table(spark):
    assert near_copies.near_copies(documents(spark, [])).count() == 0
