"""Language-model scores by compression.

A document is compressed with zstandard under two raw-content dictionaries, one
of in-domain text and one of text in general.  Compressed sizes approximate
cross-entropies, so their normalised difference,
``(general - in_domain) / general``, tells how much closer the document is to
the domain, as cross-entropy difference selection does (Moore & Lewis, 2010).

Dictionaries hold the segments that save most: runs of ``SEGMENT`` words,
one from each word on, are counted over all documents for the general one, and
over all trusted documents for the other; a segment saves its length each time
it comes again.  Dictionaries have ``DICTIONARY`` bytes at most.

Most segments are rare, and shuffling them all would take twice the input.  So
a first pass adds up, for every segment, one of ``BUCKETS`` hash buckets, and a
second one counts only segments whose bucket holds enough for them to save what
the dictionaries ask for (Park, Chen & Yu, 1995).  A bucket holds no less than
any of its segments, so what is counted is counted in full; if it doesn't fill
the dictionaries the second pass is repeated with less asked for.  The result is
that of counting everything.

Defined cases: a null text counts as empty, and an empty text scores 0; without
trusted rows both dictionaries are the general one and every score is 0; of
segments that save the same the first in order are taken; texts of any length
are read whole; repeated rows, also without ids, each get a row; columns other
than ``doc_id`` and ``text`` may have any name; an empty table gives an empty
one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, table

DICTIONARY = 110 << 10
#: Words of a segment; a text of fewer is one segment.
SEGMENT = 2
LEVEL = 3
HOLD = 100_000
#: Ids of trusted documents that are broadcast; more are met by a shuffle of the texts.
MARKED = 1_000_000
BUCKETS, CHUNK = 1 << 21, 1 << 13


class Words(dict):
    """Words to 64-bit numbers: a hash, and in the lowest 16 bits the word's bytes, or 65535 for more; filled as words are met."""

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        value = xxhash.xxh64_intdigest(raw) & ~0xFFFF | min(len(raw), 0xFFFF)
        if len(self) >= 2 * HOLD:
            self.clear()
        if len(raw) <= 40:
            self[word] = value
        return value

    def segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and bytes of the segment from each word on."""
        code = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = (code & np.uint64(0xFFFF)).astype(np.float64)
        size[size == 0xFFFF] = np.inf
        n = max(1, len(words) - SEGMENT + 1)
        at, bytes_ = np.zeros(n, np.uint64), np.zeros(n)
        for k in range(min(SEGMENT, len(words))):
            at = at * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n]
            bytes_ += size[k : k + n] + (k > 0)
        return ((at * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64), bytes_


def segments_of(words: list[str]) -> list[str]:
    """Runs of ``SEGMENT`` words, one from each word on; of fewer words, the one run."""
    return list(map(" ".join, zip(*(words[i:] for i in range(SEGMENT)), strict=False))) if len(words) >= SEGMENT else [" ".join(words)] if words else []


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Segments of all texts, and of those marked ``own``, by bucket; tables of fixed size are added up in pieces."""

    def run(batches):
        total, of = np.zeros((2, BUCKETS), np.int64), Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for kind, keep in ((0, None), (1, True)):
                    held = [of.segments(w)[0] for t, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (keep is None or own) and (w := (t or "").split())]
                    if held:
                        np.add.at(total[kind], np.concatenate(held), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        pieces = total.reshape(2, -1, CHUNK).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS // CHUNK, dtype=np.int32)), *(pa.array([pack(x.tobytes()) for x in k], pa.binary()) for k in pieces)], names=["chunk", "a", "b"])

    def add(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, *both in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.stack([np.frombuffer(unpack(y), np.float32) for y in both]).astype(np.float64)
                total[chunk] = total[chunk] + x if chunk in total else x
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["chunk", "total"])

    out = np.zeros((2, BUCKETS // CHUNK, CHUNK), np.float32)
    parts = texts.select("text", "own").mapInArrow(run, "chunk int, a binary, b binary").repartition("chunk").mapInArrow(add, "chunk int, total binary")
    for chunk, raw in parts.collect():
        out[:, chunk] = np.frombuffer(raw, np.float32).reshape(2, CHUNK)
    return out.reshape(2, BUCKETS)


def segment_counts(texts: DataFrame, buckets: np.ndarray | None = None, asked: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``segment, n, own`` over ``text, own``: counts in all texts and in those marked, combined within tasks.

    With ``buckets``, only of segments that may save as much as ``asked``, in all texts or in those marked.
    """
    shared = texts.sparkSession.sparkContext.broadcast(buckets)

    def run(batches):
        held: dict[str, int] = {}
        marked: dict[str, int] = {}
        of, limit = Words(), shared.value

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64()), pa.array([marked.get(s, 0) for s in held], pa.int64())], names=["segment", "n", "own"])

        for batch in batches:
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or "").split()
                if not words:
                    continue
                if limit is None:
                    found = segments_of(words)
                else:
                    at, size = of.segments(words)
                    # single precision: a millionth on the safe side
                    enough = np.logical_or.reduce([(limit[k][at] * 1.000001 - 1) * size >= asked[k] for k in (0, 1)])
                    found = [" ".join(words[i : i + SEGMENT]) for i in np.flatnonzero(enough).tolist()]
                for s in found:
                    held[s] = held.get(s, 0) + 1
                if own:
                    for s in found:
                        marked[s] = marked.get(s, 0) + 1
                if len(held) > HOLD:
                    yield from out()
                    held.clear()
                    marked.clear()
        yield from out()

    return texts.select("text", "own").mapInArrow(run, "segment string, n long, own long").groupBy("segment").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def _filled(histogram: list, most: int) -> tuple[int | None, int]:
    """Of ``value, bytes``, the largest value from which on there are ``most`` bytes (none if there are fewer), and the bytes above it."""
    held = 0
    for value, bytes_ in sorted(histogram, reverse=True):
        if held + bytes_ >= most:
            return value, held
        held += bytes_
    return None, held


def best_counts(texts: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """``segment, n, own`` of all segments that dictionaries of ``size`` bytes are filled from, and of some more; materialised."""
    buckets = bucket_counts(texts)
    typical, asked = 12, []
    for of in buckets:
        k = min(BUCKETS - 1, 2 * size // typical)
        asked.append(max(0.0, 0.5 * typical * (float(np.partition(of, -k)[-k]) - float(np.median(of)) - 1)))
    while True:
        counts = segment_counts(texts, buckets, tuple(asked))
        counts = cut(counts.where((F.col("n") > 1) & (F.octet_length("segment") < size)))
        held = [F.sum(F.when((F.col(of) > 1) & ((F.col(of) - 1) * F.octet_length("segment") >= least), F.octet_length("segment") + 1)) for of, least in zip(("n", "own"), asked, strict=True)]
        short = [least > 0 and (bytes_ or 0) < 2 * size for bytes_, least in zip(counts.agg(*held).first(), asked, strict=True)]
        if not any(short):
            return counts
        asked = [(least / 4 if least >= 4 else 0.0) if again else least for least, again in zip(asked, short, strict=True)]


def dictionary(counts: DataFrame, size: int = DICTIONARY, of: str = "n") -> bytes:
    """The segments that save most by the counts in ``of``, the best last, where references to them are shortest.

    Histograms of savings, coarse ones and then those within a bin, tell from
    where on segments fill twice the dictionary, so the driver gets those
    alone, whatever the number of tasks; of equal savings the first are taken.
    """
    saves = (F.col(of) - 1) * F.octet_length("segment")
    bytes_ = F.octet_length("segment") + 1
    again = counts.where((F.col(of) > 1) & (bytes_ <= size)).select("segment", saves.alias("saves"), F.floor(16 * F.log2(saves)).cast("int").alias("bin"))
    least, held = _filled(again.groupBy("bin").agg(F.sum(bytes_)).collect(), 2 * size)
    if least is None:
        rows = again.select("segment", "saves").collect()
    else:
        within = again.where(F.col("bin") == least)
        tie, more = _filled(within.groupBy("saves").agg(F.sum(bytes_)).collect(), 2 * size - held)
        ties = again.where(F.col("saves") == tie)
        shortest = ties.agg(F.min(bytes_)).first()[0]
        rows = again.where(F.col("saves") > tie).select("segment", "saves").collect()
        rows += ties.select("segment", "saves").orderBy("segment").limit((2 * size - held - more) // shortest + 1).collect()
    out, left = [], size
    for segment, _ in sorted(rows, key=lambda r: (-r.saves, r.segment)):
        piece = (segment + " ").encode()
        if len(piece) <= left:
            out.append(piece)
            left -= len(piece)
    return b"".join(reversed(out))


def dictionaries(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes]:
    good = cut(labels.where("quality = 1").select("doc_id", F.lit(True).alias("own")).distinct())
    if good.count() <= MARKED:  # texts then stay where they are
        good = F.broadcast(good)
    counts = best_counts(docs.select("doc_id", "text").join(good, "doc_id", "left"))
    general = dictionary(counts)
    return dictionary(counts, of="own") or general, general


def compressed_scores(docs: DataFrame, in_domain: bytes, general: bytes) -> DataFrame:
    """``doc_id, n_bytes, in_domain, general, score`` for each row."""

    def make():
        # raw contents, also where the bytes happen to look like a trained dictionary
        both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False) for d in (in_domain, general)]

        def work(ids, texts):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            a, b = ([len(c.compress(r)) if r else 0 for r in raw] for c in both)
            score = [(y - x) / y if y else 0.0 for x, y in zip(a, b, strict=True)]
            return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, raw)), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_bytes", "in_domain", "general", "score"])

        return work

    return map_texts(docs, make, "doc_id long, n_bytes long, in_domain long, general long, score double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compressed_scores(docs, *dictionaries(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLE_SQL: dict[str, str] = {}
