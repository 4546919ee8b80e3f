"""Small cases and brute-force versions of the operators on texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

from topicloom.llm import components, decontaminate, language, lm_score, pii, quality, sentencepiece_bpe, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " ", "a", "A a", "😀 é ß", "x" * 5000, "\x00\n\t", "same text here", "same text here"]


# --- SimHash --------------------------------------------------------------
def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[ \t-\r]+", t) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(0)
    for _ in range(200):
        t = "".join(rng.choices(["ab ", "Ab ", "É ", "cd\n", "\x0b", "\x1c", " ", "z"], k=rng.randint(0, 30)))
        assert simhash.simhash(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c') h").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("block", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = np.random.default_rng(0)
    fp = [int(x) for x in rng.integers(0, 2**63, 40)]
    for x in list(fp)[:20]:
        for _ in range(6):
            y = x
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            fp.append(y)
    fp = sorted(set(fp))
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r[0]: r[1] for r in components.connected_components(simhash.near_links(df, block=block)).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa in zip(fp, signed, strict=True):
        for b, sb in zip(fp, signed, strict=True):
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(sa), find(sb)))
                parent[y] = x
    assert {x: find(x) for x in signed} == {x: got.get(x, x) for x in signed}


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_thresholds_of_parts_cover_the_radius(most):
    rng = np.random.default_rng(1)
    parts = simhash.plan_parts(rng.integers(0, 2**63, 200).astype(np.uint64), 10_000, 3, most)
    for _ in range(500):
        bits = set(rng.choice(64, 3, replace=False).tolist())
        assert any(len(bits & set(own)) <= t for own, t in parts)


def test_groups_of_odd_texts(spark):
    d = documents(spark, ODD)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: brute_fingerprint(t) for i, t in enumerate(ODD)}
    assert got[0][1] == got[1][1] == got[2][1] == 0 and got[9][1] == got[8][1] == 8
    kept = simhash.one_of_each(documents(spark, [*ODD, "other"], [*range(10), 9])).collect()
    assert len({r.doc_id for r in kept}) == len(kept)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- decontamination ------------------------------------------------------
def brute_hits(docs, items, n=13):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    win = {}
    for i, t in items:
        w = word(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if w else ():
            win.setdefault(tuple(w[s : s + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = word(t), set(), set()
        for k in {len(x) for x in win}:
            for s in range(len(w) - k + 1):
                if found := win.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    ids |= found
        ids = sorted(map(str, ids))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_contamination_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(["a", "b", "É", "é", "C"]) + rng.choice([" ", ". ", "\n", "-"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 13, 14, 20]) if seed else rng.choice([2, 13, 15]))) for i in range(12)] + [(3, None)]
    docs = [(i, make(rng.randint(0, 60))) for i in range(30)] + [(7, "é A é b"), (50, items[0][1] + " x " + items[1][1]), (51, None), (52, " ".join(t or "" for _, t in items) * 2)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) == brute_hits(docs, items)
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    full = {x[:2] for x in brute_hits(docs, [(i, t) for i, t in items if len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t or "")) >= 13]) if x[2]}
    assert sorted(r[0] for r in kept.collect()) == sorted(x[0] for x in brute_hits(docs, items) if not x[5] and x[:2] not in full)


def test_shuffled_probes_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_contamination_matches_brute_force(spark, 1)


def test_a_full_window_in_a_long_document_goes(spark):
    item = " ".join(f"q{k}" for k in range(20))
    long = " ".join(f"w{k % 97}" for k in range(3000))
    docs = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long), (3, long + " short item"), (4, "a short item")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, item)], "item_id long, text string")
    assert {r[0] for r in decontaminate.clean(docs, items).collect()} == {2, 3}
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (20, 2, False) and got[4].contaminated


def test_empty_tables_have_no_hits(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(documents(spark, ["a b"]), none).collect()] == [0]
    assert decontaminate.contamination(documents(spark, []), none).count() == 0


# --- SentencePiece --------------------------------------------------------
def test_pieces_match_the_library():
    path = sentencepiece_bpe.default_model()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.coder(path)
    rng = random.Random(0)
    parts = ["a", "the", "ing", " ", "  ", " " * 20, "\n", "\t", "日本", "é", "▁", "<s>", "<0x41>", "10", ".", "\x00", "😀", "ß", "Aer", "aaaa", "---", "́"]
    for t in [*(x or "" for x in ODD), *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500))]:
        ids = [int(i) for x, *_ in own.encode(t) for i in x.split(",")]
        assert ids == lib.encode(t)
        assert "".join(x[2] for x in own.encode(t))[1:] == lib.decode(ids)


def test_digests(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    got = {r.doc_id: r for r in sentencepiece_bpe.token_digests(documents(spark, ODD), sentencepiece_bpe.default_model()).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    full = sentencepiece_bpe.encode_decode(documents(spark, ODD), sentencepiece_bpe.default_model()).collect()
    assert all(list(r.ids) == lib.encode(ODD[r.doc_id] or "") for r in full)


# --- PII ------------------------------------------------------------------
def brute_spans(t):
    out = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, p in kinds.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], pii.RANK[s[2]]))


def test_base_spans_match_the_patterns():
    rng = random.Random(0)
    parts = ["a", "b.", "@", "@x", ".com", "-", "1", "23", "255", ".", "4111111111111111", "+1", "+", "(0", ") ", " ", "555", "é", "\n", "000255", "256"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


# --- language, toxicity, quality, LM scores -------------------------------
def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def corpus(spark):
    rng = random.Random(0)
    words = {"en": "the house and their weather through which shall", "de": "das haus und ihre straße durch welche schön", "fr": "la maison et leur été par laquelle être", "es": "la casa y su verano por cual mañana niño"}
    rows = []
    for i in range(400):
        lang = list(words)[i % 4]
        rows.append((i, " ".join(rng.choices(words[lang].split(), k=40)), lang, "s", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_of_held_out_texts(spark):
    d = corpus(spark)
    model = language.fit(d)
    truth = {r.doc_id: r.lang for r in d.collect()}
    got = {r.doc_id: r for r in language.identify(d, model).collect()}
    held = [i for i in got if fold(i, 5) == 0]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    odd = {r.doc_id: r for r in language.identify(documents(spark, [None, "", "123 !", "x"]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred in truth.values()
    assert all(0 <= r.score <= 1 for r in [*got.values(), *odd.values()])
    assert language.identify(documents(spark, ["a"]), language.fit(documents(spark, []))).first().lang_pred == "und"


def test_restoration():
    text = "you idiot went home and the idiot said hello to the other people " * 50
    counts = np.zeros(toxicity.SIZE**3)
    x = [toxicity.INDEX[c] for c in "  " + text]
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        counts[(a * toxicity.SIZE + b) * toxicity.SIZE + c] += 1
    r = toxicity.Restorer(toxicity.log_probabilities(counts))
    for written in ("1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "idiiiot", "!d!0t"):
        assert "idiot" in r.restored(f"an {written} here"), written


def test_toxic_texts_are_found(spark):
    rng = random.Random(1)
    plain = "river stone window garden letter morning summer winter quiet road".split()
    rows, labels = [], []
    for i in range(600):
        w, bad = rng.choices(plain, k=30), i % 6 == 0
        if bad:
            w[7] = rng.choice(["scumbag", "5cumbag", "s c u m b a g", "scuuumbag"]) if i > 60 else "scumbag"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    held = [i for i in range(600) if fold(i, 4) == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held]) > 0.95
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert set(r.score for r in toxicity.score(d, none).collect()) == {none.score("")}


def test_quality_rejects_noise(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        t = " ".join(rng.choices("the small house stood near a wide river under old trees".split(), k=40)) if good else "".join(rng.choices("xq#|$KZ%9", k=200))
        rows.append((i, t, "en" if i % 2 else "fr", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, "s", 0), (901, "", "en", "s", 0), (902, "the river under trees", None, "s", 0)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, lab).collect()}
    assert np.mean([got[i].keep == (i % 5 != 0) for i in range(300)]) > 0.97
    assert not got[900].keep and not got[901].keep and got[902].keep
    assert {r.doc_id for r in quality.keep_good(d, lab).collect()} == {i for i, r in got.items() if r.keep}


def test_compression_prefers_the_domain(spark):
    good = " ".join(["contract clause party agreement shall"] * 10)
    d = documents(spark, [None, "", *[good] * 5, *["zebra quagga okapi tapir lemur " * 10] * 20])
    lab = spark.createDataFrame([(i, int(i < 7), 0) for i in range(27)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.compressed_scores(d, *lm_score.dictionaries(d, lab)).collect()}
    assert got[0].score == got[1].score == 0.0 and got[3].score > got[20].score
    lm_score.dictionaries(d, lab.limit(0))
