"""Corpus, relational and split queries over documents, events, pages and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import counts, filters, joins, splits
from glossa.plans.common import Registry, load

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as directory entries: category Top/<source>/<lang>."""
    return load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "source", "lang", F.concat_ws("/", F.lit("Top"), "source", "lang").alias("category"))


@_R.query(
    """
WITH d AS (
  SELECT source || '/' || lang AS category,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words
  FROM documents),
c AS (SELECT category, count(*) AS n, sum(n_words) AS words FROM d GROUP BY category)
SELECT sum(n)::BIGINT AS n_entries, count(*)::BIGINT AS n_categories, round(sum(n) / count(*), 6) AS mean_entries,
       round(sum(words) / sum(n), 6) AS mean_words,
       count(*) FILTER (n >= 5)::BIGINT AS n_ge_5, count(*) FILTER (n >= 10)::BIGINT AS n_ge_10,
       count(*) FILTER (n >= 50)::BIGINT AS n_ge_50, count(*) FILTER (n >= 100)::BIGINT AS n_ge_100
FROM c"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, categories, mean sizes, and how many categories reach a size."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda x: x != ""))
    docs = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("category"), words.alias("n_words"))
    per = docs.groupBy("category").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    reach = [F.count_if(F.col("n") >= k).alias(f"n_ge_{k}") for k in (5, 10, 50, 100)]
    return per.agg(
        F.sum("n").alias("n_entries"),
        F.count("*").alias("n_categories"),
        F.round(F.sum("n") / F.count("*"), 6).alias("mean_entries"),
        F.round(F.sum("words") / F.sum("n"), 6).alias("mean_words"),
        *reach,
    )


@_R.query(
    """SELECT 'Top/' || source || '/' || lang AS category, count(*) AS n, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS items
FROM documents GROUP BY ALL"""
)
def category_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.category_listing(categories(spark, sf_dir), "category", "doc_id")
    return out


_RECORD = """
WITH r AS (SELECT url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title, html AS content, page_id FROM pages),
v AS (SELECT *, CASE WHEN url IS NULL OR NOT starts_with(url, 'http') THEN 'scheme' WHEN contains(url, '?') THEN 'query'
  WHEN regexp_matches(url, '\\s') THEN 'space' WHEN coalesce(title, '') = '' THEN 'title' WHEN coalesce(content, '') = '' THEN 'content'
  WHEN length(content) > 500000 THEN 'length' END AS reason FROM r)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    r = load(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), title.alias("description"), F.col("html").alias("content"))
    return r.withColumn("reason", filters.reject_reason("url", "title", "description", "content"))


@_R.query(_RECORD + " SELECT page_id, url, title FROM v WHERE reason IS NULL")
def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter("reason is null").select("page_id", "url", "title")


@_R.query(_RECORD + " SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM v GROUP BY ALL")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@_R.query("SELECT doc_id, lang FROM documents WHERE NOT regexp_matches('Top/' || CASE WHEN lang = 'en' THEN 'Arts' ELSE 'World' END || '/' || lang, '^/?Top/World/')")
def not_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("Top"), F.when(F.col("lang") == "en", "Arts").otherwise("World"), "lang")
    return load(spark, sf_dir, "documents").filter(filters.not_foreign(path)).select("doc_id", "lang")


@_R.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def column_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return filters.in_list(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", good)


@_R.query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.not_in(load(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], load(spark, sf_dir, "labels"))


@_R.query(
    """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([a-z]+)', 1) AS category FROM pages),
h AS (SELECT category, host, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT category FROM h GROUP BY category HAVING max(n) <= 10 AND sum(n) <= 200)
SELECT page_id, category, host FROM p WHERE category IN (SELECT category FROM k)"""
)
def outlier_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", T.url_host("url").alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([a-z]+)", 1).alias("category"))
    return filters.outlier_categories(p, "category", "host").select("page_id", "category", "host")


@_R.query(
    """SELECT 'Top/' || source || '/' || lang AS category, count(*) AS n, round(avg(CASE WHEN length(text) >= 1000 THEN 1.0 ELSE 0.0 END), 6) AS share
FROM documents GROUP BY ALL HAVING avg(CASE WHEN length(text) >= 1000 THEN 1.0 ELSE 0.0 END) >= 0.7"""
)
def category_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.category_check(categories(spark, sf_dir), "category", {"text": (1000, 0.7)}).select("category", "n", F.round("_share_text", 6).alias("share"))


@_R.query("SELECT event_type, user_id, sum(1)::BIGINT AS n, count(*) AS n_rows FROM events GROUP BY ALL")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.merge_counts(load(spark, sf_dir, "events").select("event_type", "user_id", F.lit(1).alias("one")), ["event_type", "user_id"], "one")


@_R.query(
    """
WITH g AS (SELECT event_type AS token, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL)
SELECT token, row_number() OVER (ORDER BY token) - 1 AS id, total, mean, n FROM g"""
)
def sigil_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("token"), F.col("value").alias("+total"), F.col("value").alias("/mean"), F.col("user_id").alias("@user"))
    out = counts.sigil_aggregate(e, "token")
    j = F.from_json("json", "total double, mean double, `total::list` array<double>")
    return out.select("token", "id", F.round(j["total"], 4).alias("total"), F.round(j["mean"], 6).alias("mean"), F.size(j["total::list"]).cast("long").alias("n"))


@_R.query("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM events GROUP BY ALL")
def entry_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.group_values(load(spark, sf_dir, "events"), "event_type", "user_id")
    return out.select("event_type", F.array_join(F.col("values").cast("array<string>"), ",").alias("users"))


@_R.query("SELECT user_id, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.id_lists(load(spark, sf_dir, "events"), "user_id", "event_id")


@_R.query("SELECT user_id, event_type AS term FROM events WHERE value > 50")
def label_exploder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_type", (F.col("value") > 50).cast("int").alias("f"))).alias("x"))
    return counts.explode_parallel(e.select("user_id", F.col("x.event_type").alias("terms"), F.col("x.f").alias("flags")), "user_id", "terms", "flags")


@_R.query("SELECT format('{:.4f} & {:.4f} & {:.4f}', floor(avg(l_quantity) * 10000 + 0.5) / 10000, floor(avg(l_extendedprice) * 10000 + 0.5) / 10000, floor(avg(l_discount) * 10000 + 0.5) / 10000) AS line FROM lineitem")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.column_means(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


_PIECES = "len(list_filter(regexp_split_to_array(text, '[\\s[:punct:]]+'), lambda x: x <> ''))"


@_R.query(f"SELECT 'Top/' || source AS parent, {_PIECES}::BIGINT AS pieces, count(*) AS n FROM documents GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of each length a parent category has (A18, T35), as rows rather than one JSON map."""
    c = categories(spark, sf_dir).select(T.category_parent("category", 2).alias("parent"), T.piece_count("text").cast("long").alias("pieces"))
    return c.groupBy("parent", "pieces").agg(F.count("*").alias("n"))


@_R.query(
    f"""SELECT prefix, mode, count(*) AS n FROM (SELECT 'Top/' || source || '/' || lang AS category, {_PIECES} AS k FROM documents),
  (VALUES ('Top'), ('Top/src1'), ('Top/src3/en')) p(prefix), (VALUES ('long'), ('short')) m(mode)
WHERE (prefix = 'Top' OR category = prefix OR starts_with(lower(category), lower(prefix) || '/')) AND CASE WHEN mode = 'long' THEN k >= 100 ELSE k <= 100 END GROUP BY ALL"""
)
def instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries under a category or prefix, by length mode."""
    per = categories(spark, sf_dir).select("category", T.piece_count("text").alias("k"))
    per = per.groupBy("category").agg(F.count_if(F.col("k") >= 100).alias("long"), F.count_if(F.col("k") <= 100).alias("short"))
    prefixes = spark.createDataFrame([("Top",), ("Top/src1",), ("Top/src3/en",)], "prefix string")
    hit = (F.col("prefix") == "Top") | (F.col("category") == F.col("prefix")) | F.startswith(F.lower("category"), F.concat(F.lower("prefix"), F.lit("/")))
    wide = per.join(F.broadcast(prefixes), hit).groupBy("prefix").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))
    return wide.unpivot("prefix", ["long", "short"], "mode", "n").filter("n > 0")


@_R.query(
    """SELECT len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))::INT AS depth, count(*) AS n
FROM pages GROUP BY ALL"""
)
def url_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(T.url_depth("url").alias("depth")).agg(F.count("*").alias("n"))


@_R.query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY ALL")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(T.url_host("url").alias("host")).agg(F.count("*").alias("n"))


@_R.query(
    """SELECT page_id, k FROM (SELECT page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) ORDER BY page_id)::INT AS k
FROM pages WHERE regexp_matches(url, '^https?://') AND NOT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) LIKE '%example.org') WHERE k <= 3"""
)
def host_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.host_cap(load(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"], 3, ("example.org",)).select("page_id", "k")


@_R.query(
    """
WITH d AS (SELECT 'Top' AS a, 'Top/' || source AS b, 'Top/' || source || '/' || lang AS c, n_chars FROM documents),
u AS (SELECT a AS category, n_chars FROM d UNION ALL SELECT b, n_chars FROM d UNION ALL SELECT c, n_chars FROM d)
SELECT category, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM u GROUP BY ALL"""
)
def category_rollup_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every node of the category tree."""
    return counts.rollup_paths(categories(spark, sf_dir), F.col("category"), {"n": F.lit(1), "chars": F.col("n_chars")})


@_R.query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd, grouping(source)::INT + grouping(lang)::INT AS level FROM documents GROUP BY ROLLUP (source, lang)")
def template_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by level of the tree."""
    level = (F.grouping("source") + F.grouping("lang")).cast("int")
    return load(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("sd"), level.alias("level"))


@_R.query(
    """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord, count(*) OVER () AS n FROM documents),
t AS (SELECT *, least(floor(n * 98 / 100), n - 2) AS tr FROM o)
SELECT doc_id, ord, CASE WHEN ord <= floor((n - tr) * 1 / 2) THEN 'test' WHEN ord <= n - tr THEN 'dev' ELSE 'train' END AS split FROM t"""
)
def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_corpus(load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 98, 1, 1).select("doc_id", "ord", "split")


@_R.query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / greatest(floor(7 * count(*) OVER () / 100), 1))::BIGINT AS fold FROM documents")
def leave_p_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "p", 7).select("doc_id", "fold")


@_R.query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 25")
def label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_cap(load(spark, sf_dir, "labels"), "quality", ["doc_id"], 25).select("doc_id", "quality")


@_R.query(
    """SELECT o.ord, o.o_orderkey, c.c_name FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders) o
JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS ord FROM customer) c ON c.ord = o.ord"""
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.positional_zip([(o, ["o_orderkey"]), (c, ["c_custkey"])]).select("ord", "o_orderkey", "c_name")


@_R.query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner equi-joins (J1); Catalyst and AQE choose the strategy by size."""
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@_R.query("SELECT DISTINCT source, lang FROM documents")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("source", "lang").distinct()


@_R.query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key (A33), as an aggregate, which combines before the shuffle."""
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("doc_id"))


@_R.query("SELECT user_id, event_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id)::INT AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return splits.top_per_group(n, ["event_type"], [F.desc("n"), F.asc("user_id")], 5)


@_R.query("SELECT source, doc_id, count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS coordinate FROM documents")
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rank_score(load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", F.col("coordinate").cast("long").alias("coordinate"))


@_R.query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS en, concat_ws('/', 'Top', 'src1', 'en', 'x', md5('Top##src1##en##x##y')) AS path")
def repository_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a category's file lies."""
    n = load(spark, sf_dir, "documents").filter("lang = 'en'").agg(F.count("*").alias("en"))
    return n.select("en", T.repository_path(F.lit("Top/src1/en/x/y")).alias("path"))


@_R.query(
    """SELECT doc_id, (array_to_string(list_transform([a, b], lambda x: x::VARCHAR), '.')) AS path_id FROM (
SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS a, dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1 AS b FROM documents)"""
)
def category_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids level by level along the tree (X39), ranked on the distinct nodes only."""
    from pyspark.sql import Window as W

    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    nodes = d.select("source", "lang").distinct()
    first = joins.with_ordinal(nodes.select("source").distinct(), ["source"], "a").select(F.col("source").alias("s"), "a")
    ids = nodes.join(first, F.col("source") == F.col("s")).select("source", "lang", F.concat_ws(".", F.col("a") - 1, F.dense_rank().over(W.partitionBy("source").orderBy("lang")) - 1).alias("path_id"))
    return d.join(ids, ["source", "lang"]).select("doc_id", "path_id")
