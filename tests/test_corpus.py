import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from topicloom.functions import embed as E
from topicloom.functions import text as T
from topicloom.operators import corpus as P
from topicloom.plans.model import DensityClusterer, FittedModel, FixedClusterer


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cleaning_and_projection(spark):
    d = docs(spark, ["Hello,  WORLD!", None, "", "hello world", "...", "Über½ çà"])
    rows = P.cleaned(d)
    assert [r[1] for r in rows.orderBy("row_id").collect()] == ["hello world", None, None, "hello world", None, "über1 2 çà"]
    u = P.unique_texts(rows)
    assert sorted(map(tuple, u.collect())) == [(0, "hello world", 0), (1, "über1 2 çà", 5)]
    out = P.project_labels(rows, u.select("clean_text", u.proc_id.cast("int").alias("cluster_id")))
    assert [r[1] for r in out.orderBy("row_id").collect()] == [0, -1, -1, 0, -1, 1]


def test_numbering_over_blocks(spark):
    keys = [i * 7 for i in range(50)] + [2**61 + i * 2**40 for i in range(50)] + [-(3**k) for k in range(20)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for blocks in (1, 7, 1024):
        assert [r[0] for r in P.dense_index(df, "k", "i", blocks).orderBy("k").select("i").collect()] == list(range(120))


def test_hashed_ids_fill_a_bounded_number_of_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    out = P.dense_index(df, "k", "i", 64)
    assert out.agg(F.count_distinct("i"), F.min("i"), F.max("i")).first() == (20_000, 0, 19_999)
    wrong = out.select("k", "i").join(df.withColumn("own", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("k")) - 1), "k").where("i <> own")
    assert wrong.isEmpty()


def test_text_column_must_be_a_string(spark):
    with pytest.raises(TypeError):
        P.cleaned(spark.createDataFrame([(1, 2)], "doc_id long, text int"))


def test_nfkc(spark):
    from pyspark.sql import functions as F

    texts = ["ﬁne", "plain", None, "", "①②", "Å", "e\u0301", "ｶﾞ", "ﷺ", "x²", "\u00a0a\u2003b", "한글", "ﬀ½", "😀"]
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [r[0] for r in docs(spark, texts).orderBy("doc_id").select(T.nfkc(F.col("text"))).collect()] == want
    bare = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts if t]
    assert [r[0] for r in docs(spark, [t for t in texts if t]).orderBy("doc_id").select(T.strip_accents(F.col("text"))).collect()] == bare


def test_full_cleaning_is_that_of_python(spark):
    from pyspark.sql import functions as F

    texts = ["  ﬁne—Ｗｏｒｄｓ,  here! ", "Ünï_code\t①", "…", "a\u2028b", "Straße №5"]

    def plain(t):
        t = re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).lower())
        return re.sub(r"\s+", " ", t).strip()

    assert [r[0] for r in docs(spark, texts).orderBy("doc_id").select(T.clean(F.col("text"))).collect()] == list(map(plain, texts))


def test_embedder_adapters():
    class Encode:
        def encode(self, texts):
            return [[1.0, 2.0]] * len(texts)

    assert E.checked(E.adapt(Encode())(["a", "b"], 1), 2).shape == (2, 2)
    assert E.adapt(lambda t: [[float(len(x))] for x in t])(["a", "bb", "ccc"], 2).tolist() == [[1.0], [2.0], [3.0]]
    for bad in ("x", [1], {}, None, 3):
        with pytest.raises(TypeError):
            E.adapt(bad)
    for bad in ([[float("nan")]], [1.0], [["a"]]):
        with pytest.raises(ValueError):
            E.checked(bad, 1)


WORDS = [["engine", "wheel", "brake", "road", "driver"], ["flour", "oven", "butter", "sugar", "dough"], ["planet", "orbit", "comet", "star", "galaxy"]]


def topics():
    return [" ".join(w[(i * k + j) % 5] for j in range(4)) for k, w in enumerate(WORDS, 1) for i in range(8)]


def test_fixed_k_lifecycle(spark, tmp_path):
    texts = [*topics(), None, "!!!"]
    d = docs(spark, texts)
    c = FixedClusterer(3)
    with pytest.raises(RuntimeError):
        c.predict(d)
    out = {r[0]: r[1] for r in c.fit_predict(d).collect()}
    assert set(out.values()) == {-1, 0, 1, 2} and out[24] == out[25] == -1
    assert all(len({out[k * 8 + i] for i in range(8)}) == 1 for k in range(3))
    c.model.save(str(tmp_path / "m"))
    m = FittedModel.load(spark, str(tmp_path / "m"), "fixed")
    assert {r[0]: r[1] for r in m.predict(d, threshold=None).collect()} == out
    with pytest.raises(ValueError):
        FittedModel.load(spark, str(tmp_path / "m"), "density")
    with pytest.raises(FileNotFoundError):
        FittedModel.load(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError):
        m.topic_labels(99)
    words = {r["term"] for r in m.topic_keywords(out[0]).collect()}
    assert words & set(WORDS[0])


def test_density_on_texts(spark):
    out, report = DensityClusterer().labels_with_report(docs(spark, topics()))
    got = [r[1] for r in out.orderBy("row_id").collect()]
    assert len(got) == 24 and report.tier == "tiny" and report.to_dict()["n"] <= 24
    assert len(set(got)) >= 2


def test_limits(spark):
    d = docs(spark, ["a b", "c d", "e f"])
    with pytest.raises(ValueError):
        FixedClusterer(9).labels(d)
    with pytest.raises(ValueError):
        FixedClusterer(1)
    with pytest.raises(ValueError):
        DensityClusterer(max_samples=2).labels(d)


def test_more_rows_than_max_samples_are_assigned_to_what_a_sample_gives(spark):
    d = docs(spark, topics())
    with pytest.warns(UserWarning):
        out, report = DensityClusterer(max_samples=10, allow_oversized=True).labels_with_report(d)
    assert "oversized-subsampled" in report.warnings and out.count() == 24 and out.select("cluster_id").distinct().count() >= 2


def test_embedder_counts_features_like_one_by_one(monkeypatch):
    import math
    import pickle

    texts = ["ab ab abc", "", "ÄÖ naïve 漢字 ab", "x " * 30, "abc"]
    monkeypatch.setattr(E.HashingEmbedder, "AT_ONCE", 7)
    own = E.HashingEmbedder(16)
    for got, t in zip(own.embed(texts), texts, strict=True):
        sums = [0.0] * 16
        for w in re.findall(r"\w+", t.lower()):
            for at, sign in own.features(w):
                sums[at] += sign
        v = [math.copysign(math.log1p(abs(x)), x) for x in sums]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got.tolist() == pytest.approx([x / norm for x in v], abs=1e-6)
    a, b = (pickle.loads(pickle.dumps(own)) for _ in range(2))
    a.embed(["word"])
    assert "word" in b.known  # tasks of a worker look a word up once


def test_large_samples_are_the_first_by_hash_and_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "GATHERED", 4, raising=False)
    df = spark.range(3000).repartition(5).withColumnRenamed("id", "k")
    for n in (5, 700, 2999, 3000, 4000):
        want = df.orderBy(F.xxhash64(F.col("k").cast("string"), F.lit("42")), "k").limit(n)
        got = P.subsample(df, "k", n)
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
    assert P.subsample(df, "k", 700).rdd.getNumPartitions() > 1  # one task doesn't gather the sample
