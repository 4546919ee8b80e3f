import random

import pytest
import sentencepiece

from topicloom.llm import sentencepiece_bpe, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(0)
    words = "the small house stood near a wide river under old trees while quiet people walked home from their long work".split()
    text = lambda n=60: " ".join(rng.choices(words, k=n))
    item = text(20)
    docs = [(i, text(), "en", "s") for i in range(80)]
    docs += [(100, docs[5][1], "en", "t"), (101, docs[5][1], "en", "t"), (102, item, "en", "s"), (103, text() + " mail a@b.cd now", "en", "s"), (104, None, None, None), (105, "", "en", "s")]
    docs += [(200 + i, "".join(rng.choices("xq#|$KZ%9", k=300)), "en", "s") for i in range(30)]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, item_id int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in docs if i != 104], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_do_what_they_say(spark, tables):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables).cache()
        seen.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    quality, dedup, decon, pii, encoded = seen
    assert not {i for i in quality if i >= 200} and 104 not in quality and len({i for i in quality if i < 100}) > 75
    group = {}
    for i in sorted(quality):
        group.setdefault(simhash.simhash(quality[i].text), i)
    assert set(dedup) <= set(group.values()) and 100 not in dedup and 101 not in dedup
    assert 102 not in decon and set(decon) == set(dedup) - {102}
    assert set(pii) == set(decon) and ("[EMAIL]" in pii[103].text) == (103 in decon)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    assert all(encoded[i].n_tokens == len(lib.encode(pii[i].text)) for i in pii)


def test_run_gives_the_last_stage(spark, tables):
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
