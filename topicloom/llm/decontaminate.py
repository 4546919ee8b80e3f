"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A document is searched for every item window: ``window`` consecutive item
words, or the whole item if it has fewer.  Containment must be exact, so of a
window's two-word shingles, ordered by how rare they are in the documents, a
prefix of one is enough to find every occurrence.  That one shingle is joined
with the document positions, the position and length bounds leave one possible
start, and the words there are compared in full.

Cost: two scans of the documents (rarity, then probing), whose word positions
are exploded and filtered by a hash join inside one generated stage; only
matches are shuffled.  Equal windows of several items are probed once.  The
probed table is broadcast while it has at most ``BROADCAST_ROWS`` windows;
beyond that ``(text, position, shingle)`` is shuffled by shingle, and the texts
of what matches meet it afterwards.

Defined cases: null texts have no words; items without words have no windows;
items of one word are found by that word; repeated or null ``doc_id`` rows each
get a row with the result of their own text; equal windows of several items
count for each item; null ``item_id`` counts in ``n_hit`` but not in
``n_items``; texts of any length are searched whole; empty tables give no
hits; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 13
BROADCAST_ROWS = 500_000
#: What parts words; letters of either case are part of them, the case is folded word by word.
BREAK = r"[\x00-/:-@\[-`{-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The text's words, with an empty string at either end where a break stands there; splitting takes a third of the time of matching words."""
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def count_words(w: Column) -> Column:
    """Words of what :func:`words` gives."""
    edge = lambda c: (c == "").cast("int")
    return F.greatest(F.size(w) - edge(F.get(w, F.lit(0))) - edge(F.get(w, F.size(w) - 1)), F.lit(0)).cast("long")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, size, win`` with the window's words in lower case."""
    w = items.select("item_id", F.transform(F.filter(words(F.col("text")), lambda x: x != ""), lower_ascii).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    return w.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("win")).distinct()


def _positions(docs: DataFrame, single: bool) -> DataFrame:
    """``key`` of the shingle at every word position, beside the columns of ``docs``; ``w`` are the document's words."""
    at = docs.select("*", F.posexplode("w").alias("pos", "w1"))
    pair = F.xxhash64(lower_ascii(F.col("w1")), lower_ascii(F.get("w", F.col("pos") + 1)))
    if single:  # one-word items exist: look every word up by itself as well
        return at.select("*", F.explode(F.array(pair, F.xxhash64(lower_ascii(F.col("w1"))))).alias("key"))
    return at.withColumn("key", pair)


def rarest_shingles(docs: DataFrame, windows: DataFrame, small: bool, single: bool) -> DataFrame:
    """Distinct windows ``wid, size, win``, as ``first`` word and ``whole`` text, with ``key`` and ``off``, their rarest shingle that occurs in the documents; windows with a shingle that never occurs are left out."""
    hint = F.broadcast if small else (lambda x: x)
    at = F.sequence(F.lit(1), F.greatest(F.size("win") - 1, F.lit(1)))
    each = cut(windows.select("wid", F.posexplode(F.transform(at, lambda i: F.xxhash64(F.get("win", i - 1), F.get("win", i)))).alias("off", "key")))
    keys = each.select("key").distinct()
    seen = _positions(docs.select("w"), single).select("key").join(hint(keys), "key", "left_semi").groupBy("key").count()
    ranked = each.join(seen, "key", "left")
    best = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key", "off")).alias("b")).where("b.count > 0")
    return windows.join(best, "wid").select("wid", "size", F.get("win", F.lit(0)).alias("first"), F.array_join("win", " ").alias("whole"), "b.key", "b.off")


def word_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, what tells texts of one id apart, and the words ``w``."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("len"), words(F.col("text")).alias("w"))


KEY = ["doc_id", "h", "len"]


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.h == b.h) & (a.len == b.len)


def matches(text: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, h, len, n_words, start, end, wid`` for each place where one of the distinct ``windows`` stands; materialised."""
    count, shortest = windows.agg(F.count("*"), F.min("size")).first()
    small, single = count <= BROADCAST_ROWS, shortest == 1
    probes = cut(rarest_shingles(text, windows, small, single))
    start = F.col("pos") - F.col("off")
    at = _positions(text, single)
    if small:
        met = at.join(F.broadcast(probes), "key")
    else:
        # positions travel without their document's words, which meet the few that match afterwards
        met = at.select(*KEY, "pos", "key").join(probes, "key").where(start >= 0)
        met = met.select(*(F.col(c).alias(f"_{c}") for c in KEY), "pos", *probes.columns).join(text, F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")) & (F.col("_len") == F.col("len")))
    # No higher-order function here: it would end the generated stage, and every position would carry a copy of the document's words.
    found = (
        met.where((start >= 0) & (start + F.col("size") <= F.size("w")))
        .where(lower_ascii(F.get("w", F.greatest(start, F.lit(0)))) == F.col("first"))
        .where(lower_ascii(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ")) == F.col("whole"))
        .select(*KEY, count_words(F.col("w")).alias("n_words"), start.alias("start"), (start + F.col("size")).alias("end"), "wid")
    )
    return cut(found.distinct())


def hits(found: DataFrame) -> DataFrame:
    """``doc_id, h, len, n_words, n_hit, longest`` of the texts in which a window occurs; ``longest`` is the size of the longest one."""
    spans = found.select(*KEY, "n_words", F.struct("start", "end").alias("s")).distinct().groupBy(*KEY, "n_words").agg(F.array_sort(F.collect_list("s")).alias("s"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"))
    return spans.select(*KEY, "n_words", F.aggregate("s", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), F.array_max(F.transform("s", lambda s: s["end"] - s["start"])).alias("longest"))


def distinct_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(wid, size, win)``, each window once, and ``(item_id, wid)``; both materialised."""
    each = cut(item_windows(items, window))
    own = cut(each.select("size", "win").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return own, each.join(own.select("wid", "win"), "win").select("item_id", "wid")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    text = word_table(docs)
    windows, of_items = distinct_windows(items, window)
    found = matches(text, windows)
    named = found.select(*KEY, "wid").distinct().join(of_items.where("item_id is not null"), "wid").select(*KEY, F.col("item_id").cast("string").alias("i")).distinct()
    ids = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("i")).alias("ids"))
    hit = hits(found)
    hit = hit.join(ids, _same_text(hit, ids), "left").select(*(hit[c] for c in KEY), "n_hit", "ids")
    rows = text.select(*KEY, count_words(F.col("w")).alias("n_words"))
    joined = rows.join(hit, _same_text(rows, hit), "left")
    n_hit, got = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        rows.doc_id,
        rows.n_words,
        n_hit.cast("long").alias("n_hit"),
        F.size(got).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", got), 256).alias("items_sha256"),
        is_contaminated(n_hit, rows.n_words).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without benchmark text, all columns.

    A document goes if a full window of ``window`` words occurs in it, however
    long the document is, or if windows of shorter items make up a twentieth of
    its words.  Only ids and digests of such texts are joined back, so texts
    move only if those are too many to broadcast.
    """
    found = hits(matches(word_table(docs), distinct_windows(items, window)[0]))
    bad = found.where((F.col("longest") >= window) | is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = cut(bad.select(*KEY)).withColumnsRenamed({"doc_id": "bad_id", "h": "bad_h", "len": "bad_len"})
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_h")) & (F.length("text") == F.col("bad_len")), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {
    "op5_decontaminate": r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as win from b where len(w) > 0),
sizes as (select distinct size from bw),
dw as (select r, size, unnest(range(1, len(w) - size + 2)) as p0, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as win from d, sizes where len(w) >= size),
hit as (select r, p0, dw.size, item_id from dw join bw on dw.win = bw.win and dw.size = bw.size),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(p0, p0 + size)) as p from hit) group by r),
ids as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hit group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w)) as contaminated
from d left join pos using (r) left join ids using (r)"""
}
