"""All queries of the library by name, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import corpus as P
from ..operators import metrics as M
from ..operators import topics as K
from ..operators import profile as R
from ..operators import tuning
from ..operators.quantiles import percentiles
from ..shared import cut, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("v"))


def rows_of(spark: SparkSession, sf_dir: str, min_length: int = 0) -> DataFrame:
    return P.cleaned(read(spark, sf_dir, "documents"), min_length=min_length)


def by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language, numbered in order, as a cluster; -1 without one."""
    docs = read(spark, sf_dir, "documents")
    number = P.compact_labels(docs.where("lang is not null").select("lang").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("lang")))).select("lang", "compact")  # a row for each language
    named = docs.select("lang", T.clean(F.col("text")).alias("clean_text")).join(F.broadcast(number), "lang", "left")
    return named.select(F.coalesce("compact", F.lit(-1)).alias("cluster_id"), "clean_text")


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, and no negative zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in (names or [c for c, t in df.dtypes if t == "double"])})


# --- text -----------------------------------------------------------------
CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
ROWS = f"with rows as (select doc_id as row_id, case when {CLEAN} <> '' then {CLEAN} end as clean_text from documents), "
UNIQ = ROWS + "uniq as (select clean_text, min(row_id) as first_row_id from rows where clean_text is not null group by clean_text), num as (select row_number() over (order by first_row_id) - 1 as proc_id, clean_text, first_row_id from uniq) "


@query(f"select doc_id, {CLEAN} as clean_text from documents")
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("clean_text"))


@query("select doc_id, lower(text) as text from documents")
def lowercase(spark, d):
    return read(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


@query(r"select doc_id, regexp_replace(text, '[^\pL\pN_\s]', ' ', 'g') as text from documents")
def strip_punctuation(spark, d):
    return read(spark, d, "documents").select("doc_id", F.regexp_replace("text", T.PUNCTUATION, " ").alias("text"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def collapse_whitespace(spark, d):
    return read(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query()
def nfkc_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", T.nfkc(F.col("text")).alias("text"))


@query("select doc_id, text from documents")
def corpus_scan(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


@query("select source, count(*) as rows, count(*) filter (where text is not null and trim(text) <> '') as real_rows from documents group by source")
def missing_filter(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(T.is_real(F.col("text"))).alias("real_rows"))


@query(f"select doc_id as row_id, case when length({CLEAN}) >= 400 then {CLEAN} end as clean_text from documents")
def min_length_filter(spark, d):
    return rows_of(spark, d, 400)


@query(UNIQ + "select * from num")
def dedupe_texts(spark, d):
    return P.unique_texts(rows_of(spark, d))


@query(UNIQ + "select row_id, proc_id from rows left join num using (clean_text)")
def index_map(spark, d):
    return P.index_map(rows_of(spark, d))


@query(ROWS + "k as (select row_id, row_number() over (order by row_id) - 1 as proc_id from rows where clean_text is not null) select row_id, proc_id from rows left join k using (row_id)")
def index_map_all_rows(spark, d):
    return P.index_map(rows_of(spark, d), deduplicate=False)


@query(UNIQ + "select row_id, coalesce(proc_id % 5, -1)::int as cluster_id from rows left join num using (clean_text)")
def label_projection(spark, d):
    rows = rows_of(spark, d)
    return P.project_labels(rows, P.unique_texts(rows).select("clean_text", (F.col("proc_id") % 5).cast("int").alias("cluster_id")))


@query("with ln as (select lang, (row_number() over (order by lang) - 1)::int as cluster_id from (select distinct lang from documents where lang is not null)) select cluster_id, list(source order by doc_id) as items from documents join ln using (lang) group by cluster_id")
def group_items(spark, d):
    docs = read(spark, d, "documents")
    number = docs.where("lang is not null").select("lang").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("lang")) - 1)  # a row for each language
    return P.groups(docs.join(F.broadcast(number), "lang").select(F.col("doc_id").alias("row_id"), F.col("source").alias("text"), "cluster_id"))


@query("select doc_id, ((row_number() over (order by doc_id) - 1) % 7)::int as cluster_id from documents")
def round_robin(spark, d):
    return P.round_robin(read(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query("with s as (select lang, count(*) as n from documents group by lang), w as (select lang, greatest(1, round(n::double * 200.0 / (select count(*) from documents)::double)::int) as want from s), r as (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) as i from documents) select doc_id, lang from r join w using (lang) where i <= want")
def stratified_subsample(spark, d):
    return P.stratified(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 200)


@query()
def deterministic_subsample(spark, d):
    return P.subsample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("select vec_id as row_id, label, (dense_rank() over (order by label) - 1)::int as compact from embeddings where label % 3 <> 1")
def compact_labels(spark, d):
    return P.compact_labels(read(spark, d, "embeddings").where("label % 3 <> 1").select(F.col("vec_id").alias("row_id"), "label"))


# --- vectors --------------------------------------------------------------
E = "e as (select vec_id as row_id, label as cluster_id, embedding::double[] as v from embeddings), u as (select row_id, cluster_id, v, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-10)) as u from e), "
CENT = E + "m as (select cluster_id, i, avg(x) as m from (select cluster_id, unnest(u) as x, generate_subscripts(u, 1) as i from u) group by cluster_id, i), m2 as (select cluster_id, list(m order by i) as m from m group by cluster_id), c as (select cluster_id, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-10)) as c from m2), "
SIMS = CENT + "s as (select row_id, cluster_id, list_dot_product(u, c) as sim from u join c using (cluster_id)), "
PAIRS = "pr as (select x.cluster_id as a, y.cluster_id as b, list_dot_product(x.c, y.c) as sim from c x, c y where x.cluster_id < y.cluster_id), "
CAL = "cal as (select cluster_id, count(*) as size, min(sim) as min_sim, avg(sim) as mean_sim, quantile_cont(sim, 0.1) as p10_sim, quantile_cont(sim, 0.5) as median_sim, stddev_pop(sim) as std_sim, quantile_cont(sim, 0.25) as p25_sim, quantile_cont(1 - sim, 0.95) as radius_95 from s group by cluster_id), "
GLOBAL = "g as (select greatest(0.05, (select quantile_cont(sim, 0.05) from s) * 0.9 - 0.05 * greatest(0.0, (select coalesce(max(sim), 0.0) from pr))) as threshold), "
ADAPT = (
    "close as (select i as cluster_id, sum(n) as close from (select a as i, (sim > 0.7)::int as n from pr union all select b, (sim > 0.7)::int from pr) group by i), t as (select sum(size) as total, max(size) as largest from cal), "
    "ad as (select cal.cluster_id, size::double as n, total < 200 or largest < 30 as small, case when size >= 50 then p10_sim when size >= 10 then p25_sim * (1 - (size - 10) / 40.0) + p10_sim * ((size - 10) / 40.0) else p25_sim end as base, greatest(0.0, mean_sim - 0.5) * 0.1 as bonus, coalesce(close, 0) as close, (select coalesce(max(sim), 0.0) from pr) as inter from cal cross join t left join close using (cluster_id)), "
    "ad2 as (select cluster_id, small, greatest(0.05, base * (case when small then 0.45 + 0.10 * least(1.0, n / 50.0) else 0.70 + 0.15 * least(1.0, n / 50.0) end) - 0.03 * close + (case when small then least(bonus, 0.02) else bonus end) - 0.02 * greatest(0.0, inter)) as theta from ad), "
    "th as (select cluster_id, case when small then least(theta, (select threshold from g)) else theta end as threshold from ad2), "
)
NEAR = "n as (select row_id, u.cluster_id as label, c.cluster_id, list_dot_product(u, c) as sim, row_number() over (partition by row_id order by round(list_dot_product(u, c), 12) desc, c.cluster_id) as k from u, c), "
TWO = NEAR + "two as (select a.row_id, a.cluster_id as best, a.sim as best_sim, b.cluster_id as second, b.sim as second_sim from (select * from n where k = 1) a left join (select * from n where k = 2) b using (row_id)) "


@query("with " + E + "x as (select 1) select row_id, list_transform(u, lambda x: round(x, 6) + 0.0) as unit from u")
def l2_normalize(spark, d):
    return vectors(spark, d).select("row_id", F.transform(V.unit(F.col("v")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("with " + E + "x as (select 1) select p.row_id as a, q.row_id as b, round(list_dot_product(p.u, q.u), 6) + 0.0 as sim, round(1 - list_dot_product(p.u, q.u), 6) + 0.0 as distance from u p, u q where p.row_id % 100 = 0")
def pairwise_cosine(spark, d):
    """A query set, the vectors whose id is divisible by 100, against all vectors."""
    rows = vectors(spark, d).select("row_id", "v")
    pairs = C.block_similarities(rows.where("row_id % 100 = 0"), rows)
    return r6(pairs.select("a", "b", "sim", (1 - F.col("sim")).alias("distance")))


@query("select count(*) as rows, count(*) filter (where len(embedding) <> 64) as wrong_width, count(*) filter (where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0) as not_finite from embeddings")
def validate_embeddings(spark, d):
    from ..functions.embed import faults

    return faults(read(spark, d, "embeddings"), F.col("embedding"), 64)


@query("with f as (select embedding as f from embeddings order by vec_id limit 1), x as (select max(list_max(list_transform(list_zip(embedding, f), lambda p: abs(p[1]::double - p[2]::double)))) as spread from embeddings, f) select spread <= 1e-9 as identical from x")
def all_identical(spark, d):
    return C.all_identical(vectors(spark, d))


@query("with " + CENT + "x as (select 1) select cluster_id, count(*) as size, any_value(list_transform(c, lambda x: round(x, 6) + 0.0)) as centroid from u join c using (cluster_id) group by cluster_id")
def centroids(spark, d):
    return C.centroids(vectors(spark, d)).select("cluster_id", "size", F.transform("c", lambda x: F.round(x, 6) + F.lit(0.0)).alias("centroid"))


def _sims(spark, d):
    rows = vectors(spark, d)
    cents = C.centroids(rows)
    return rows, cents, C.similarities(rows, cents)


@query("with " + SIMS + "x as (select 1) select cluster_id, count(*) as size, round(avg(sim), 6) as cohesion, round(greatest(0.05, least(0.35, quantile_cont(1 - sim, 0.9) + 0.03)), 6) as threshold from s group by cluster_id")
def cluster_stats(spark, d):
    return r6(C.cluster_stats(_sims(spark, d)[2]))


@query("with " + SIMS + CAL + "x as (select 1) select cluster_id, size, round(min_sim, 6) + 0.0 as min_sim, round(mean_sim, 6) as mean_sim, round(p10_sim, 6) + 0.0 as p10_sim, round(median_sim, 6) as median_sim, round(std_sim, 6) as std_sim, round(p25_sim, 6) as p25_sim, round(radius_95, 6) as radius_95 from cal")
def calibration_stats(spark, d):
    return r6(C.calibration(_sims(spark, d)[2]))


@query("with " + SIMS + PAIRS + GLOBAL + "x as (select 1) select round(threshold, 6) as threshold from g")
def global_threshold(spark, d):
    _, cents, sims = _sims(spark, d)
    return r6(C.global_threshold(sims, cents))


def _adaptive(spark, d):
    rows, cents, sims = _sims(spark, d)
    return rows, cents, sims, C.adaptive_thresholds(C.calibration(sims), cents, C.global_threshold(sims, cents))


@query("with " + SIMS + PAIRS + CAL + GLOBAL + ADAPT + "x as (select 1) select cluster_id, round(threshold, 6) as threshold from th")
def adaptive_threshold(spark, d):
    return r6(_adaptive(spark, d)[3])


@query("with " + E + "rm as (select cluster_id, i, avg(x) as m from (select cluster_id, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by cluster_id, i), rc as (select cluster_id, list(m order by i) as m from rm group by cluster_id) select cluster_id, round(greatest(0, least(1, avg(list_dot_product(u, m) / sqrt(list_dot_product(m, m))))), 4) as confidence from u join rc using (cluster_id) group by cluster_id")
def confidence(spark, d):
    return C.confidence(vectors(spark, d))


@query("with " + SIMS + "x as (select 1) select cluster_id, arg_max(row_id, (round(sim, 9), -row_id)) as row_id from s group by cluster_id")
def representative(spark, d):
    return C.representatives(_sims(spark, d)[2])


@query("select avg((label = 0)::int::double) as noise_ratio from embeddings")
def noise_ratio(spark, d):
    return C.noise_ratio(vectors(spark, d).withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id"))))


@query("with " + CENT + TWO + "select row_id, best::int as cluster_id, round(best_sim, 6) as sim from two")
def nearest_centroid(spark, d):
    rows = vectors(spark, d)
    return r6(C.nearest_two(rows.select("row_id", "v"), C.centroids(rows)).select("row_id", F.col("best").cast("int").alias("cluster_id"), F.col("best_sim").alias("sim")))


@query("with " + CENT + TWO + "select row_id, best::int as best, second::int as second, round(best_sim, 6) + 0.0 as best_sim, round(second_sim, 6) + 0.0 as second_sim, (case when best_sim - second_sim < 0.015 and second % 5 > best % 5 + 2 then second else best end)::int as chosen from two")
def assign_top2_margin(spark, d):
    rows = vectors(spark, d)
    cents = C.centroids(rows)
    found = C.with_margin(C.nearest_two(rows.select("row_id", "v"), cents), cents.select("cluster_id", (F.col("cluster_id") % 5).alias("n")))
    return r6(found.select("row_id", *(F.col(c).cast("int").alias(c) for c in ("best", "second", "chosen")), "best_sim", "second_sim"))


@query("with " + SIMS + PAIRS + CAL + GLOBAL + ADAPT + TWO + "select row_id, (case when best_sim < threshold then -1 else best end)::int as cluster_id, round(best_sim, 6) as sim from two join th on th.cluster_id = two.best")
def predict_ood(spark, d):
    rows, cents, _, limits = _adaptive(spark, d)
    return r6(C.reject_outliers(C.nearest_two(rows.select("row_id", "v"), cents), limits))


@query("with " + SIMS + PAIRS + GLOBAL + TWO + "select row_id, (case when best_sim < (select threshold from g) then -1 else best end)::int as cluster_id from two")
def predict_global(spark, d):
    rows, cents, sims = _sims(spark, d)
    limit = C.global_threshold(sims, cents).first()[0]
    return C.reject_outliers(C.nearest_two(rows.select("row_id", "v"), cents), None, limit).select("row_id", "cluster_id")


NOISY = "e as (select vec_id as row_id, case when label = 0 then -1 else label end as cluster_id, embedding::double[] as v from embeddings), "


def _noisy(sql: str) -> str:
    return sql.replace(E.split(", u as")[0] + ", ", NOISY).replace("from u) group by cluster_id, i), m2", "from u where cluster_id >= 0) group by cluster_id, i), m2")


def noisy(spark, d):
    return vectors(spark, d).withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id")))


@query("with " + _noisy(SIMS) + "reach as (select cluster_id, greatest(1.5 * max(1 - sim), 0.4) as reach from s group by cluster_id), " + TWO + "select two.row_id, best::int as cluster_id from two join u using (row_id) join reach on reach.cluster_id = best where u.cluster_id = -1 and 1 - best_sim <= reach and (second_sim is null or best_sim - second_sim > 0.01)")
def noise_recovery(spark, d):
    rows = noisy(spark, d)
    cents = C.centroids(rows)
    return C.recover_noise(rows, cents, C.similarities(rows, cents))


@query("with " + _noisy(CENT) + TWO + "select row_id, (case when cluster_id = -1 then best else cluster_id end)::int as cluster_id from u join two using (row_id)")
def centroid_fallback(spark, d):
    rows = noisy(spark, d)
    return C.assign_noise(rows, C.centroids(rows)).select("row_id", "cluster_id")


# --- graph of clusters ----------------------------------------------------
@query("with " + CENT + PAIRS + "x as (select 1) select a, b, round(sim, 6) + 0.0 as sim from pr")
def centroid_similarity(spark, d):
    return r6(C.centroid_pairs(C.centroids(vectors(spark, d))))


CLOSURE = "w(a, b) as (select cluster_id, cluster_id from c union select w.a, case when pr.a = w.b then pr.b else pr.a end from w join pr on (pr.a = w.b or pr.b = w.b) and pr.sim >= {limit}), root as (select a as cluster_id, min(b) as root from w group by a) "


@query("with recursive " + CENT + PAIRS + CLOSURE.format(limit="(select greatest(0.88, avg(sim) + 0.03) from pr)") + "select row_id, root as cluster_id from u join root using (cluster_id)")
def near_duplicate_merge(spark, d):
    return C.merge_near_duplicates(vectors(spark, d)).select("row_id", "cluster_id")


@query("with recursive " + CENT + PAIRS + CLOSURE.format(limit="0.2") + "select cluster_id, root from root")
def union_find_closure(spark, d):
    cents = C.centroids(vectors(spark, d))
    roots = C.merge_roots(C.close_pairs(cents, 0.2), [r[0] for r in cents.select("cluster_id").collect()])
    return spark.createDataFrame(sorted(roots.items()), "cluster_id int, root int")


@query()
def granularity_merge(spark, d):
    return C.merge_by_similarity(vectors(spark, d), 0.2)[0].select("row_id", "cluster_id")


@query(
    "with " + SIMS + "w as (select cluster_id, quantile_cont(1 - sim, 0.9) as radius from s group by cluster_id), k as (select cluster_id, c, cluster_id % 3 as shard, radius from c join w using (cluster_id)), p as (select x.cluster_id as a, y.cluster_id as b, x.shard as sa, y.shard as sb, list_dot_product(x.c, y.c) as sim, greatest(x.radius, y.radius) as wide, row_number() over (partition by x.cluster_id order by round(list_dot_product(x.c, y.c), 9) desc, y.cluster_id) as r from k x, k y where x.cluster_id <> y.cluster_id) "
    "select p.a, p.b, round(p.sim, 6) + 0.0 as sim from p join p q on p.a = q.b and p.b = q.a where p.r <= 3 and q.r <= 3 and p.a < p.b and p.sa <> p.sb and p.sim >= 0.05 and 1 - p.sim <= greatest(0.08, p.wide + 0.03)"
)
def cross_shard_stitch(spark, d):
    rows, cents, sims = _sims(spark, d)
    radius = percentiles(sims, ["cluster_id"], "sim", [0.1]).select("cluster_id", (1 - F.col("p")[0]).alias("radius"))
    return r6(C.mutual_pairs(cents.join(radius, "cluster_id").withColumn("shard", F.col("cluster_id") % 3), 0.05))


# --- scores ---------------------------------------------------------------
@query("with t as (select l.toxic as t, l.quality as p, count(*)::double as n from labels l group by 1, 2), s as (select sum(n) as total, sum(n * (n - 1) / 2) as dd from t), a as (select t, sum(n) as a from t group by t), b as (select p, sum(n) as b from t group by p), x as (select total, dd, (select sum(a * (a - 1) / 2) from a) as pa, (select sum(b * (b - 1) / 2) from b) as pb, (select -sum(a / total * ln(a / total)) from a) as ht, (select -sum(b / total * ln(b / total)) from b) as hp, (select sum(n / total * ln(n * total / (a * b))) from t join a using (t) join b using (p)) as mi from s) select round((dd - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)), 6) + 0.0 as ari, round(mi / ((ht + hp) / 2), 6) as nmi, round(mi / ht, 6) as homogeneity, round(mi / hp, 6) as completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) as v_measure from x")
def external_metrics(spark, d):
    return r6(M.external_metrics(M.contingency(read(spark, d, "labels"), "toxic", "quality")))


BYSRC = "t as (select lang as t, substr(source, 4)::int as p, count(*)::double as n from documents group by 1, 2) "


def _by_source(spark, d):
    return M.contingency(read(spark, d, "documents").withColumn("p", F.substring("source", 4, 9).cast("int")), "lang", "p")


@query("with " + BYSRC + "select p as cluster_id, sum(n)::bigint as size, arg_min(t, (-n, t)) as dominant, round(max(n) / sum(n), 6) as purity from t group by p")
def purity(spark, d):
    return r6(M.purity(_by_source(spark, d)))


@query("with " + BYSRC + "select t as class, sum(n)::bigint as size, count(*) as clusters, round(max(n) / sum(n), 6) as recovered from t group by t")
def class_recovery(spark, d):
    return r6(M.class_recovery(_by_source(spark, d)))


@query("select avg((label > 2)::int::double) as coverage from embeddings")
def coverage(spark, d):
    return M.coverage(read(spark, d, "embeddings").withColumn("p", F.col("label") - 3), "p")


ALL = "q as (select * from u), dd as (select x.row_id as a, x.cluster_id as la, y.row_id as b, y.cluster_id as lb, 1 - list_dot_product(x.u, y.u) as d from q x, q y where x.row_id <> y.row_id), "
# the reference profiles as many rows as this says
DIST = ALL.replace("(select * from u)", "(select * from u order by md5(row_id::varchar), row_id limit (select least(count(*), greatest(1024, least(4096, 16 * sqrt(count(*)))))::bigint from u))")


def _nearest(spark, d, k):
    """``a, kth`` over the sample, whose rows meet in blocks."""
    rows = vectors(spark, d)
    own = cut(rows.orderBy(F.md5(F.col("row_id").cast("string")), "row_id").limit(R.sample_size(rows.count())))
    met = C.block_similarities(own, own, keep=k, others=True)
    return M.nearest_distances(met.select(F.col("b").alias("a"), (1 - F.col("sim")).alias("d")), k)


@query("with " + E + ALL + "m as (select a, la, lb, avg(d) as d from dd group by all), p as (select a, max(case when la = lb then d end) as own, min(case when la <> lb then d end) as other from m group by a) select round(avg(case when own is null or other is null then 0 else (other - own) / greatest(own, other, 1e-12) end), 6) as silhouette from p")
def silhouette(spark, d):
    return r6(M.silhouette(vectors(spark, d)))


@query("with " + E + "c as (select cluster_id, i, avg(x) as m from (select cluster_id, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by cluster_id, i), m as (select cluster_id, list(m order by i) as m from c group by cluster_id), s as (select cluster_id, avg(list_distance(v, m)) as s from e join m using (cluster_id) group by cluster_id), r as (select x.cluster_id, max((a.s + b.s) / greatest(list_distance(x.m, y.m), 1e-12)) as r from m x join m y on x.cluster_id <> y.cluster_id join s a on a.cluster_id = x.cluster_id join s b on b.cluster_id = y.cluster_id group by x.cluster_id) select round(avg(r), 6) as davies_bouldin from r")
def davies_bouldin(spark, d):
    return r6(M.davies_bouldin(vectors(spark, d)))


@query("with " + E + DIST + "m as (select a, list_sort(list(d))[20] as kth from dd group by a) select round(avg(kth), 6) as density_mean, round(stddev_pop(kth) / avg(kth), 6) as density_cv from m")
def local_density(spark, d):
    return r6(_nearest(spark, d, 20).agg(F.avg("kth").alias("density_mean"), (F.stddev_pop("kth") / F.avg("kth")).alias("density_cv")))


@query("with " + E + DIST + "m as (select a, min(d) as d from dd group by a) select avg((d < 1e-4)::int::double) as duplicate_ratio, avg((d < 1e-2)::int::double) as near_duplicate_ratio from m")
def duplicate_ratio(spark, d):
    return _nearest(spark, d, 1).agg(F.avg((F.col("kth") < 1e-4).cast("double")).alias("duplicate_ratio"), F.avg((F.col("kth") < 1e-2).cast("double")).alias("near_duplicate_ratio"))


@query(
    "with " + SIMS + PAIRS + "st as (select cluster_id, count(*)::double as size, avg(sim) as cohesion from s group by cluster_id), n as (select count(*)::double as n from s), a as (select count(*)::double as k, sum(size) as held, sum(size * cohesion) / sum(size) as mc, min(cohesion) as lc, max(size) as largest, quantile_cont(size, 0.5) as med, avg(size) as ms, stddev_pop(size) as ss from st), "
    "b as (select *, greatest(2, least(22, floor(sqrt(n / 3)))) as base, (select avg((size <= greatest(3, floor(0.25 * n / k)))::int::double) from st) as tiny, (select avg(1 - greatest(-1.0, least(1.0, sim))) from pr) as sep from a, n), "
    "c2 as (select *, sep * case when largest > 2 * med then sqrt(med / largest) else 1 end as sep1, greatest(4, floor(base / 2)) as low from b), "
    "p as (select k, held / n as coverage, (mc + 1) / 2 as cohesion, greatest(0, least(1, case when k <= 3 and n > 150 then 0 when k >= 4 and n > 500 and k < low then sep1 * k / low else sep1 end)) as separation, case when k <= 1 then 0.5 else 1 - least(ss / ms, 2) / 2 end as stability, greatest(tiny, greatest(0, least(1, (k - base) / base))) as fragmentation, greatest(0, largest / n - 0.1) as largest, greatest(0, 0.15 - lc) as blob from c2) "
    "select k::bigint as k, round(coverage, 6) as coverage, round(cohesion, 6) as cohesion, round(separation, 6) as separation, round(stability, 6) as stability, round(fragmentation, 6) as fragmentation, round(largest, 6) as largest, round(greatest(0, least(1, (1 + 0.15 / 0.67) * (0.15 * coverage + 0.20 * cohesion + 0.22 * separation + 0.10 * stability) - 0.10 * fragmentation - 0.10 * largest - blob)), 6) as score from p"
)
def composite_score(spark, d):
    rows, cents, sims = _sims(spark, d)
    return r6(M.composite_score(C.cluster_stats(sims), C.centroid_pairs(cents), rows.count(), 64))


# --- routing and parameters ----------------------------------------------
GRID = "(select unnest([1, 10, 150, 151, 5000, 5001, 50000, 50001, 1000000]) as n)"


def _sizes(spark):
    return spark.createDataFrame([(n,) for n in (1, 10, 150, 151, 5000, 5001, 50000, 50001, 1000000)], "n int")


@query(f"select n, case when n <= 150 then 'tiny' when n <= 5000 then 'small' when n <= 50000 then 'medium' else 'large' end as tier from {GRID}")
def tier_routing(spark, d):
    return _sizes(spark).select("n", tuning.tier_column(F.col("n")).alias("tier"))


@query("select d, case when d <= 511 then 'low' when d <= 1023 then 'mid' when d <= 2047 then 'high' else 'xhigh' end as band from (select unnest([256, 384, 511, 512, 768, 1023, 1024, 1536, 2047, 2048, 3072, 16384]) as d)")
def dim_band(spark, d):
    return spark.createDataFrame([(n, tuning.dim_band(n)) for n in (256, 384, 511, 512, 768, 1023, 1024, 1536, 2047, 2048, 3072, 16384)], "d int, band string")


@query("select tier, k, case when tier = 'large' then 'minibatch' when tier = 'medium' then 'balanced' when k = 2 then 'bisecting' when tier = 'tiny' and k < 10 then 'agglomerative' when tier = 'small' and k <= 10 then 'spectral' else 'balanced' end as algorithm from (select unnest(['tiny', 'small', 'medium', 'large']) as tier), (select unnest([2, 3, 9, 10, 11, 50]) as k)")
def algorithm_matrix(spark, d):
    return spark.createDataFrame([(t, k, tuning.k_algorithm(t, k)) for t in ("tiny", "small", "medium", "large") for k in (2, 3, 9, 10, 11, 50)], "tier string, k int, algorithm string")


@query(f"select n, floor(greatest(8, least(0.10 * n, 0.35 * sqrt(n))))::int as floor from (select n::double as n from {GRID}) where n >= 100".replace("::int as floor", "::int as least_size").replace("n, floor(", "n::int as n, floor("))
def mcs_floor(spark, d):
    return spark.createDataFrame([(n, tuning.least_cluster_size("balanced", "low", n)) for n in (150, 151, 5000, 5001, 50000, 50001, 1000000)], "n int, least_size int")


@query("select i, score < 0.38 or noise > 0.35 as refine from (select vec_id as i, abs(embedding[1]::double) as score, abs(embedding[2]::double) as noise from embeddings)")
def refine_gate(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), tuning.refine_column(F.abs(F.get("embedding", F.lit(0)).cast("double")), F.abs(F.get("embedding", F.lit(1)).cast("double"))).alias("refine"))


# --- topics ---------------------------------------------------------------
STOPS = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"
LANGS = f"with ln as (select lang, (row_number() over (order by lang) - 1)::int as cluster_id from (select distinct lang from documents where lang is not null)), docs as (select cluster_id, strip_accents({CLEAN}) as t from documents join ln using (lang)), st as (select {STOPS} as st), w as (select cluster_id, list_filter(string_split(t, ' '), lambda x: length(x) >= 2 and not list_contains(st, x)) as w from docs, st), tm as (select cluster_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), n as (select cluster_id, term, count(*) as n from tm group by all), "
SCORE = "sz as (select cluster_id, sum(n)::double as size from n group by cluster_id), tot as (select term, sum(n)::double as overall from n group by term), sc as (select cluster_id, term, n, (n::double / size) * 2.5 / (n::double / size + 1.5) * ln(1.0 + (select greatest(avg(size), 1.0) from sz) / (overall + 1e-10)) as score from n join sz using (cluster_id) join tot using (term)), "


def _counts(spark, d):
    return cut(K.term_counts(by_lang(spark, d)))


@query(LANGS + "x as (select 1) select cluster_id, term, n from n")
def term_counts(spark, d):
    return K.term_counts(by_lang(spark, d))


@query(LANGS + SCORE + "x as (select 1) select cluster_id, term, n, round(score, 8) as score from sc")
def ctfidf(spark, d):
    return K.class_tf_idf(_counts(spark, d)).withColumn("score", F.round("score", 8))


@query(LANGS + SCORE + "r as (select *, row_number() over (partition by cluster_id order by round(score, 10) desc, term) as rank from sc where score > 0) select cluster_id, rank, term, round(score, 8) as score from r where rank <= 10")
def top_keywords(spark, d):
    return K.top_keywords(K.class_tf_idf(_counts(spark, d))).withColumn("score", F.round("score", 8))


@query(LANGS + SCORE + "sh as (select term, count(*)::double as held, stddev_pop(score) as sd, avg(score) as mean from sc where score > 0 group by term) select term from sh where held >= 2 and held / (select count(distinct cluster_id) from sc) >= 0.8 and sd / (mean + 1e-10) < 0.5")
def corpus_stopwords(spark, d):
    return K.corpus_stop_words(K.class_tf_idf(_counts(spark, d)))


@query(
    LANGS
    + SCORE
    + "v as (select list_value({v}) as v, list_value({a}) as a) select cluster_id, term, round(case when list_has_any(string_split(term, ' '), v) or len(list_filter(string_split(term, ' '), lambda w: not list_contains(a, w))) = 0 or len(string_split(term, ' ')) > 2 then 0 else score * (case when len(string_split(term, ' ')) = 2 then 1.55 else 1 end) * (case when regexp_matches(string_split(term, ' ')[-1], '...({e})$') then 1.35 else 1 end) * (case when list_has_any(string_split(term, ' '), a) then 0.3 else 1 end) end, 8) as fit from sc, v".format(
        v=", ".join(f"'{w}'" for w in T.VERBS), a=", ".join(f"'{w}'" for w in T.ADJECTIVES), e="|".join(T.NOUN_ENDINGS)
    )
)
def label_suitability(spark, d):
    scored = K.class_tf_idf(_counts(spark, d))
    return scored.select("cluster_id", "term", F.round(T.label_score(F.col("term"), F.col("score")), 8).alias("fit"))


TRI = "list_distinct(case when length({0}) < 3 then [{0}] else list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: substr({0}, i, 3)) end)"


@query("with w as (select distinct unnest(string_split(lower(name), ' ')) as w from (select n_name as name from nation union all select r_name from region)), p as (select x.w as a, y.w as b, " + TRI.format("x.w") + " as ta, " + TRI.format("y.w") + " as tb from w x, w y where x.w < y.w) select a, b, round(len(list_intersect(ta, tb))::double / len(list_distinct(list_concat(ta, tb)))::double, 6) as jaccard from p")
def trigram_jaccard(spark, d):
    names = read(spark, d, "nation").select(F.col("n_name").alias("name")).unionAll(read(spark, d, "region").select("r_name"))
    w = names.select(F.explode(F.split(F.lower("name"), " ")).alias("w")).distinct()
    pairs = w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), F.col("a") < F.col("b"))
    return r6(pairs.select("a", "b", T.trigram_jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query()
def topic_label(spark, d):
    return K.topic_labels(K.top_keywords(K.class_tf_idf(_counts(spark, d)), 20))


# --- flagship -------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit from labelled vectors, calibrate, predict with rejection, and summarise the clusters."""
    rows, cents, _, limits = _adaptive(spark, sf_dir)
    found = C.reject_outliers(C.nearest_two(rows.select("row_id", "v"), cents), limits)
    return r6(found.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("sim").alias("mean_sim"), F.max_by("row_id", F.struct(F.round("sim", 9), -F.col("row_id"))).alias("representative")))


@query("with " + SIMS + PAIRS + CAL + GLOBAL + ADAPT + TWO + ", f as (select row_id, (case when best_sim < threshold then -1 else best end)::int as cluster_id, best_sim as sim from two join th on th.cluster_id = two.best) select cluster_id, count(*) as size, round(avg(sim), 6) as mean_sim, arg_max(row_id, (round(sim, 9), -row_id)) as representative from f group by cluster_id")
def fit_predict_summary(spark, d):
    return flagship(spark, d)


# --- kernels and whole clusterings ---------------------------------------
def _k_query(name: str, k: int, n: int | None = None):
    def run(spark, d):
        from . import fixed_k

        rows = vectors(spark, d).select("row_id", "v")
        return fixed_k.split_vectors(rows if n is None else P.subsample(rows, "row_id", n), k)[0].select("row_id", "cluster_id")

    run.__name__ = name
    QUERIES[name] = run


# a tier is defined by its size, so the tiny tier's queries take a sample of that size
_k_query("fixed_k_bisecting", 2)
_k_query("fixed_k_spectral", 8)
_k_query("fixed_k_balanced", 20)
_k_query("fixed_k_agglomerative", 5, 120)


@query()
def fixed_k_minibatch(spark, d):
    from . import fixed_k

    rows = vectors(spark, d).select("row_id", "v")
    report = fixed_k.Report(n=rows.count(), k=10)
    return fixed_k._large(rows, 10, tuning.Config(), report).select("row_id", "cluster_id")


@query()
def fixed_k_report(spark, d):
    from . import fixed_k

    out, _ = fixed_k.split_vectors(vectors(spark, d).select("row_id", "v"), 10)
    return r6(fixed_k.per_cluster(out, 10))


@query()
def cluster_tiny(spark, d):
    from . import density

    return density.cluster_vectors(P.subsample(vectors(spark, d).select("row_id", "v"), "row_id", 120))[0].select("row_id", "cluster_id")


@query()
def cluster_small(spark, d):
    from . import density

    return density.cluster_vectors(vectors(spark, d).select("row_id", "v"))[0].select("row_id", "cluster_id")


@query()
def cluster_large(spark, d):
    from ..operators.profile import dataset_profile
    from . import density

    rows = vectors(spark, d).select("row_id", "v")
    return density.cluster_large(rows, tuning.Config(), "low", dataset_profile(rows), density.Report()).select("row_id", "cluster_id")


@query()
def cluster_documents(spark, d):
    """Texts to clusters, end to end, with the built-in embedder."""
    from .model import DensityClusterer

    return DensityClusterer(max_samples=None).labels(read(spark, d, "documents"))  # whatever their number, none is left to a sample


@query()
def dataset_profile(spark, d):
    from ..operators.profile import dataset_profile as profile

    p = profile(vectors(spark, d)).__dict__
    return spark.createDataFrame([tuple(float(v) for v in p.values())], list(p))


@query()
def model_round_trip(spark, d):
    """Fit, save, load, and predict the texts fitted on."""
    from uuid import uuid4

    from .model import FixedClusterer, FittedModel

    docs = read(spark, d, "documents")
    path = f"{shared_folder(spark)}/models/{uuid4().hex}"
    FixedClusterer(6).fit(docs).save(path)
    return FittedModel.load(spark, path, "fixed").predict(docs)


@query()
def report(spark, d):
    from ..sources.store import report_row
    from . import density

    _, rep = density.cluster_vectors(vectors(spark, d).select("row_id", "v"))
    return report_row(spark, rep.to_dict() | {"timings": {}})


@query()
def stream_predict(spark, d):
    """The embeddings as a stream, assigned to clusters fitted on their labels."""
    from uuid import uuid4

    from ..streaming.predict import assign_stream, write_available
    from .model import fitted

    rows = vectors(spark, d)
    model = fitted(rows, None, "density", tuning.Config(extract_keywords=False))
    top = f"{shared_folder(spark)}/streams/{uuid4().hex}"
    source = read(spark, d, "embeddings")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/embeddings.parque[t]")  # a pattern may name one file or a folder of them; a plain path must be a folder
    write_available(assign_stream(stream.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), model), f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out")


@query()
def embed_texts(spark, d):
    from ..functions.embed import embed

    return embed(read(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("t")).where("t <> ''"), "t").select("doc_id", F.round(F.element_at("v", 1).cast("double"), 5).alias("first"), F.size("v").alias("width"))


@query("select toxic as t, quality as p, count(*)::double as n from labels where quality >= 0 group by all")
def contingency(spark, d):
    return M.contingency(read(spark, d, "labels"), "toxic", "quality")


@query()
def floor_calibration(spark, d):
    """Quality floors from the reports of some runs."""
    from . import density

    rows = vectors(spark, d).select("row_id", "v")
    runs = []
    for n in (40, 60, 80):
        own = P.subsample(rows, "row_id", n)
        labelled, rep = density.cluster_vectors(own)
        runs.append({"tier": rep.tier, "score": rep.metrics["score"], "ari": 0.0, "k": rep.k, "n": rep.n, "dataset": "embeddings", "embedder": "given"})
    floors = tuning.calibrate_floors(runs)
    return spark.createDataFrame([(t, f["score"], f["floor"], f["k"], f["runs"]) for t, f in sorted(floors.items())], "tier string, score double, floor double, k int, runs int")


@query("with c as (select distinct trim(lower(text)) as t from documents) select doc_id, case when t is not null then [length(t)::double, ascii(t)::double] end as v from documents left join c on trim(lower(text)) = t")
def lookup_embedding(spark, d):
    """Vectors from a cache of distinct texts; here their length and first sign."""
    from ..functions.embed import lookup

    t = read(spark, d, "documents").select("doc_id", F.trim(F.lower("text")).alias("t"))
    cache = t.where("t is not null").select(F.col("t").alias("clean_text")).distinct().withColumn("embedding", F.array(F.length("clean_text").cast("double"), F.ascii("clean_text").cast("double")))
    return lookup(t, "t", cache, "v").select("doc_id", "v")


@query()
def height_jumps(spark, d):
    """Numbers of clusters at the large jumps of Ward's merge heights, of a tiny tier's rows."""
    from ..functions import kernels
    from . import search
    from .density import _matrix

    u = kernels.unit_rows(_matrix(P.subsample(vectors(spark, d).select("row_id", "v"), "row_id", 120))[1])
    heights = kernels.linkage((2 * (1 - u @ u.T).clip(0, 2)) ** 0.5, "ward")[:, 2]
    return spark.createDataFrame([(i, k) for i, k in enumerate(search.jumps(heights, len(u) // 2), 1)], "rank int, k int")


# --- further operators ----------------------------------------------------
@query("select doc_id, array_to_string(list_transform(string_split(lower(lang || ' ' || source), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as label from documents")
def title_case(spark, d):
    return read(spark, d, "documents").select("doc_id", T.label_word(F.concat_ws(" ", "lang", "source")).alias("label"))


@query("select n_nationkey as id, list_sort(" + TRI.format("lower(n_name)") + ") as trigrams from nation")
def char_trigrams(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array_sort(T.char_trigrams(F.lower("n_name"))).alias("trigrams"))


@query("select vec_id as row_id, round(greatest(0, least(1, embedding[1]::double * 4)), 6) + 0.0 as clipped from embeddings")
def clip_to_unit(spark, d):
    return r6(read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), V.clip01(F.get("embedding", F.lit(0)).cast("double") * 4).alias("clipped")))


@query("with " + E + "m as (select cluster_id, i, avg(x) as m from (select cluster_id, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by cluster_id, i) select cluster_id, list(round(m, 6) + 0.0 order by i) as mean from m group by cluster_id")
def mean_vectors(spark, d):
    out = vectors(spark, d).groupBy("cluster_id").agg(V.mean(F.col("v")).alias("m"))
    return out.select("cluster_id", F.transform("m", lambda x: F.round(x, 6) + F.lit(0.0)).alias("mean"))


@query("with " + CENT + "x as (select 1) select a.cluster_id as a, b.cluster_id as b, round(list_dot_product(a.c, b.c), 6) + 0.0 as sim from c a, c b where a.cluster_id <> b.cluster_id")
def centroid_matrix(spark, d):
    return r6(C.centroid_pairs(C.centroids(vectors(spark, d)), both_ways=True))


@query("select r::bigint as missing from range(12) t(r) where r not in (select distinct label from embeddings where label % 4 <> 1)")
def missing_labels(spark, d):
    return P.missing_labels(read(spark, d, "embeddings").where("label % 4 <> 1"), "label", 12)


@query("select n, w, least(w, round_even(64 + least(1.0, greatest(0.0, (sqrt(w) * pow(log10(n), 0.7) - sqrt(384) * pow(log10(5000), 0.7)) / (sqrt(3072) * pow(log10(200000), 0.7) - sqrt(384) * pow(log10(5000), 0.7)))) * 448, 0))::int as width from (select unnest([5000, 20000, 100000, 200000, 1000000])::int as n), (select unnest([384, 768, 1536, 3072])::int as w)")
def reduced_width(spark, d):
    return spark.createDataFrame([(n, w, tuning.adaptive_width(n, w)) for n in (5000, 20000, 100000, 200000, 1000000) for w in (384, 768, 1536, 3072)], "n int, w int, width int")


@query("select q as preset, t as tier, case q when 'fast' then 1 when 'balanced' then case t when 'tiny' then 5 when 'small' then 5 when 'medium' then 3 else 2 end else case t when 'tiny' then 15 when 'small' then 12 when 'medium' then 10 else 5 end end as restarts from (select unnest(['fast', 'balanced', 'best']) as q), (select unnest(['tiny', 'small', 'medium', 'large']) as t)")
def restart_presets(spark, d):
    return spark.createDataFrame([(q, t, n) for q, own in tuning.RESTARTS.items() for t, n in own.items()], "preset string, tier string, restarts int")


@query("select n, w, least(1.0, n::double * w * 4 / 8e9) as pressure from (select unnest([1000, 1000000]) as n), (select unnest([64, 1536]) as w)")
def memory_pressure(spark, d):
    return spark.createDataFrame([(n, w, R.memory_pressure(n, w)) for n in (1000, 1000000) for w in (64, 1536)], "n int, w int, pressure double")


@query()
def candidate_ranking(spark, d):
    """The diverse best candidates of a sweep over a bounded sample, in order."""
    from ..functions import kernels
    from . import search
    from .density import _matrix

    u = kernels.unit_rows(_matrix(P.subsample(vectors(spark, d).select("row_id", "v"), "row_id", 400))[1])
    found = [c for m in (2, 5) for c in search.sweep(u, u, [5, 10, 20], m, 0.0)]
    rows = [(i, c["mcs"], c["min_samples"], c["method"], int(c["k"]), float(c["score"])) for i, c in enumerate(search.diverse(found, len(u)), 1)]
    return r6(spark.createDataFrame(rows, "rank int, mcs int, min_samples int, method string, k int, score double"))


@query()
def cluster_medium(spark, d):
    """The medium tier's plan, on vectors of any number."""
    from ..operators.profile import dataset_profile
    from . import density

    rows = vectors(spark, d).select("row_id", "v")
    rep = density.Report(n=rows.count())
    return density._bounded(rows, tuning.Config(min_cluster_size=10, min_samples=2), "medium", "low", dataset_profile(rows), rep).select("row_id", "cluster_id")


@query()
def fixed_k_oversized(spark, d):
    """More rows than ``max_samples``: a sample is fitted, all rows are assigned."""
    from . import fixed_k

    return fixed_k.split_vectors(vectors(spark, d).select("row_id", "v"), 6, {"max_samples": 200})[0].select("row_id", "cluster_id")
