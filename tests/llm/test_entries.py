"""Every ``opN_`` query and the pipeline: contract columns on small tables, and tables that hold odd rows."""

import hashlib

import duckdb
import pytest
import sentencepiece

from topicloom.llm import registry, sentencepiece_bpe, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_op4_is_the_library(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    rows = registry.QUERIES["op4_sentencepiece"](spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_op5_is_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    names = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    got = registry.QUERIES["op5_decontaminate"](spark, DIR).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select {', '.join(names)} from ({registry.ORACLE_SQL['op5_decontaminate']})").fetchall())


def test_op9_links_what_all_pairs_link(spark, texts):
    rows = {r.doc_id: r for r in registry.QUERIES["op9_simhash"](spark, DIR).collect()}
    fp = {i: simhash.simhash(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fp and all(len(r.fingerprint) == 16 for r in rows.values())
    root = {i: i for i in fp}
    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((root[a], root[b]))
                if x != y:
                    root = {i: x if r == y else r for i, r in root.items()}
    assert {i: r.component_id for i, r in rows.items()} == root


def test_op10_columns(spark, texts):
    rows = registry.QUERIES["op10_lm_score"](spark, DIR).collect()
    assert len(rows) == len(texts) and all(r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = ", key long, w long, h long, len long, fp long, node long, own long, v long, id long, n long, leaf long, bin long, wid long, size long, shard long, trained long, cluster_id long"
N_EXTRA = EXTRA.count(" long")


def write(spark, top, docs, labels, bench, vectors):
    extra = [1] * N_EXTRA
    spark.createDataFrame([(*r, *extra) for r in docs], COLUMNS + EXTRA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string, doc_id long").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, id long, v long, leaf long, bin long").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    words = "the small house stood near a wide river under old trees while quiet people walked home".split()
    text = lambda i: " ".join(words[(i * k + k * k) % 16] for k in range(1, 40))
    docs = [(i, text(i), "en" if i % 2 else "de", "s", 5) for i in range(30)]
    docs += [(None, None, None, None, None), (None, text(3), None, None, None), (None, text(3), None, None, None), (5, "again", "en", None, 1), (40, "", "en", "s", 0), (41, "x" * 200_000, "en", "s", 9), (42, "$1@ " * 20_000, None, "s", 9), (43, "word " * 60_000, "en", "s", 9), (44, "\x00\n​😀", "en", "s", 9), (45, "1" * 100_000, "en", "s", 9)]
    labels = [(i, i % 2, int(i % 7 == 0), "t") for i in range(30)] + [(None, 1, 1, None), (3, None, None, None), (3, 0, 1, "u"), (99, 1, 0, None)]
    bench = [(1, text(2), 7), (2, text(2), 7), (None, text(4), 7), (3, None, 7), (4, "", 7), (5, "again", 7)]
    vectors = [(i, [float(i % 5), 1.0, float(i % 3)], 1, 1, 1, 1, 1) for i in range(60)] + [(None, [1.0, 1.0, 1.0], 1, 1, 1, 1, 1), (100, None, 1, 1, 1, 1, 1), (150, [], 1, 1, 1, 1, 1), (200, [1.0, None, 1.0], 1, 1, 1, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, bench, vectors), len(docs)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, name):
    rows = registry.QUERIES[name](spark, odd[0]).collect()
    if name == "op6_ann":
        assert {r.query_id for r in rows} == {0, 50} and all(sum(x.query_id == q for x in rows) == 5 for q in (0, 50))
    else:
        assert len(rows) == odd[1]
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, odd[0]).collect()]
    assert 40 not in ids and len(ids) < odd[1] and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert corpus_pipeline.run(spark, empty).count() == 0
