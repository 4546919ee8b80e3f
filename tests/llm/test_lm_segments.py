"""Segments of the dictionaries: every word pair, every trusted document, and a last bin in part."""

import random
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from topicloom.llm import lm_score


def test_every_word_pair_counts(spark):
    d = spark.createDataFrame([("a b c", True), ("b c", None), ("x", True), ("", True), (None, None)], "text string, own boolean")
    assert {tuple(r) for r in lm_score.segment_counts(d).collect()} == {("a b", 1, 1), ("b c", 2, 1), ("x", 1, 1)}


@pytest.mark.parametrize("marked", [1_000_000, 0])
def test_in_domain_counts_all_trusted_documents(spark, monkeypatch, marked):
    monkeypatch.setattr(lm_score, "MARKED", marked)
    rare = (F.col("doc_id") % 1000).between(1, 2)
    d = spark.range(60_000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(rare, F.concat(F.lit("rare"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit(" segment"))))
    lab = d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    own, general = lm_score.dictionaries(d, lab)
    assert all(f"rare{k} segment ".encode() in own for k in range(60)) and own == general


def test_the_last_bin_is_taken_in_part(spark):
    rows = [("very common", 1000, 0)] + [(f"word{k:04d} pair", 50, 0) for k in range(1000)]
    c = spark.createDataFrame(rows, "segment string, n long, own long")
    got = lm_score.dictionary(c, 500)
    assert 480 < len(got) <= 500 and got.endswith(b"word0000 pair very common ")
    assert lm_score.dictionary(c, 500, of="own") == b""


@pytest.mark.parametrize("size", [200, 2000])
def test_the_best_counts_fill_the_same_dictionaries(spark, size):
    rng = random.Random(size)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(60)) for _ in range(400)] + ["q" * 70_000 + " again"] * 3 + [None, "", "one"]
    d = spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(texts)], "text string, own boolean")
    best, whole = lm_score.best_counts(d, size), lm_score.segment_counts(d)
    assert best.count() < whole.count()
    for of in ("n", "own"):
        assert lm_score.dictionary(best, size, of) == lm_score.dictionary(whole, size, of) == brute(texts, size, of) != b""


def brute(texts, size, of):
    count = Counter()
    for i, t in enumerate(texts):
        w = (t or "").split()
        if of == "n" or i % 3 == 0:
            count.update([" ".join(x) for x in zip(w, w[1:], strict=False)] if len(w) > 1 else w)
    kept = sorted((-(n - 1) * len(s.encode()), s) for s, n in count.items() if n > 1 and len(s.encode()) < size)
    out, left, held = [], size, 0
    for k, (saves, s) in enumerate(kept):
        if held >= 2 * size and kept[k - 1][0] != saves:
            break
        held += len(s) + 1
        if len(s) + 1 <= left:
            out.append(f"{s} ")
            left -= len(s) + 1
    return "".join(reversed(out)).encode()


def test_buckets_hold_every_segment(spark):
    texts = ["a b c a b", "", None, "x", "a b"]
    d = spark.createDataFrame([(t, t == "a b") for t in texts], "text string, own boolean")
    got, of = lm_score.bucket_counts(d), lm_score.Words()
    assert got.sum(axis=1).tolist() == [6, 1] and got[0][of.segments(["a", "b"])[0][0]] >= 3


def test_scores_are_those_of_the_library(spark):
    texts = [None, "", "aa bb cc dd", "aa bb " * 3000, "é ß"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    in_domain, general = b"aa bb cc dd ee", b"zz yy xx"
    size = lambda raw, own: len(zstandard.ZstdCompressor(level=lm_score.LEVEL, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(raw))
    for r in lm_score.compressed_scores(d, in_domain, general).collect():
        raw = (texts[r.doc_id] or "").encode()
        a, b = (size(raw, in_domain), size(raw, general)) if raw else (0, 0)
        assert (r.n_bytes, r.in_domain, r.general, r.score) == (len(raw), a, b, (b - a) / b if b else 0.0)
