"""Further queries: one for each operator that the other modules leave without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import sequences as Q
from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators import clustering, counts, evaluation, models, retrieval, secondary, similarity, splits, stats, summarize
from glossa.operators.joins import with_ordinal
from glossa.plans.additions import translation_sql
from glossa.plans.common import Registry, load
from glossa.plans.textual import doc_tokens, items

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_WORDS = r"regexp_extract_all(lower(text), '[^\s[:punct:]]+')"


@_R.query(
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents), d AS (SELECT t.doc_id, w, quality FROM t JOIN labels USING (doc_id)), n AS (SELECT count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (quality = 0) AS b FROM d),
c AS (SELECT w, count(*) FILTER (quality = 0)::DOUBLE AS n11, count(*)::DOUBLE AS nw FROM d GROUP BY w HAVING count(*) > 20),
x AS (SELECT w, n11, nw - n11 AS n10, b - n11 AS n01, n - nw - b + n11 AS n00, n::DOUBLE AS n FROM c, n)
SELECT w AS word, round(n * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 4) AS chi_square FROM x
WHERE n11 * n10 * n01 * n00 <> 0 AND n * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)) > 3.8414588"""
)
def significant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent terms whose chi-square has a tail below 0.05."""
    t = doc_tokens(spark, sf_dir).distinct()
    lab = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("flag"))
    x = stats.contingency(t.join(lab, "doc_id"), "doc_id", "word", "flag", 21).withColumn("x", stats.chi_square())
    return x.filter(F.col("x").isNotNull() & (stats.chi_square_p(F.col("x")) < 0.05)).select("word", F.round("x", 4).alias("chi_square"))


@_R.query("SELECT count(*) AS n, '{\"instances\":' || count(*) || '}' AS json FROM events WHERE event_type = 'view'")
def instance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of marked rows as JSON."""
    n = load(spark, sf_dir, "events").filter("event_type = 'view'").agg(F.count("*").alias("n"))
    return n.select("n", F.to_json(F.struct(F.col("n").alias("instances"))).alias("json"))


@_R.query(f"SELECT ngram, md5(ngram) AS md5, row_number() OVER (ORDER BY ngram) - 1 AS id, n FROM (SELECT w AS ngram, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w)")
def ngram_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids and digests of n-grams."""
    g = items(spark, sf_dir).select(F.explode("w").alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
    return with_ordinal(g, ["ngram"], "id").select("ngram", T.ngram_key("ngram").alias("md5"), (F.col("id") - 1).alias("id"), "n")


@_R.query(
    f"""WITH d AS (SELECT DISTINCT source, unnest({_WORDS}) AS w FROM documents), n AS (SELECT source, count(*) AS n FROM d GROUP BY source)
SELECT a.source AS a, b.source AS b, count(*) AS shared, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM d a JOIN d b ON a.w = b.w AND a.source < b.source JOIN n na ON na.source = a.source JOIN n nb ON nb.source = b.source GROUP BY ALL"""
)
def category_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that pairs of categories share (X18); there are as many pairs as a word has categories, squared."""
    d = load(spark, sf_dir, "documents").select("source", F.explode(T.tokens("text")).alias("w")).distinct()
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    s = counts.pair_counts(d, "w", "source").withColumnRenamed("n", "shared")
    x = s.join(n.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return x.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


@_R.query()
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that don't give a reference away."""
    s = summarize.extract_sentences(load(spark, sf_dir, "documents"), "doc_id", {"content": "text"}).select("doc_id", "ord", T.tokens("sentence").alias("w"))
    return clustering.leaked_any(s, items(spark, sf_dir), "w", "w").select("doc_id", "ord")


@_R.query()
def adaptation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of edits between neighbours by the words they change."""
    i = items(spark, sf_dir)
    d = i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id").select(F.explode(Q.diff_operations("w", "other")).alias("x"))
    return d.groupBy("x.op", "x.from").agg(F.count("*").alias("n")).filter("n >= 2")


@_R.query(
    r"""WITH p AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)), '[^\s[:punct:]]+') AS title, regexp_extract_all(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) || ' ' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^\s[:punct:]]+') AS url FROM pages),
m AS (SELECT page_id, 'title' AS modality, unnest(title) AS ngram FROM p UNION ALL SELECT page_id, 'url', unnest(url) FROM p)
SELECT modality, ngram, count(*) AS n, count(DISTINCT page_id) AS df FROM m GROUP BY ALL"""
)
def modality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-gram features of modalities."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    m = F.explode(F.array(F.struct(F.lit("title").alias("modality"), T.tokens(title).alias("w")), F.struct(F.lit("url").alias("modality"), T.url_words("url").alias("w"))))
    x = load(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", "m.modality", F.explode("m.w").alias("ngram"))
    return x.groupBy("modality", "ngram").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("df"))


@_R.query("SELECT *, row_number() OVER (ORDER BY accuracy DESC, informativeness DESC, system)::INT AS place FROM (SELECT l_returnflag AS system, round(avg(l_discount), 5) AS accuracy, round(avg(l_tax), 5) AS informativeness FROM lineitem GROUP BY l_returnflag)")
def crowd_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of mean ratings merged and ordered by several keys."""
    li = load(spark, sf_dir, "lineitem")
    a, b = (li.groupBy(F.col("l_returnflag").alias("system")).agg(F.round(F.avg(c), 5).alias(n)) for c, n in (("l_discount", "accuracy"), ("l_tax", "informativeness")))
    # there is one row a system
    return a.join(b, "system").withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), F.desc("informativeness"), "system")))


@_R.query(f"WITH v AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w) SELECT w AS word, n, row_number() OVER (ORDER BY n DESC, w) AS id FROM v")
def vocabulary_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vocabulary by falling occurrences."""
    return counts.whole_vocabulary(items(spark, sf_dir).select(F.explode("w").alias("word")), "word")


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), p AS (SELECT a.item_id, a.w AS s, b.w AS t FROM i a JOIN i b ON b.item_id = a.item_id + 1),
x AS (SELECT item_id, k, s[k] AS w FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM p)), y AS (SELECT item_id, k, t[k] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM p)),
vx AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM x GROUP BY w), vy AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM y GROUP BY w),
lx AS (SELECT item_id, string_agg(id::VARCHAR, ' ' ORDER BY k) AS source FROM x JOIN vx USING (w) GROUP BY item_id), ly AS (SELECT item_id, string_agg(id::VARCHAR, ' ' ORDER BY k) AS target FROM y JOIN vy USING (w) GROUP BY item_id)
SELECT item_id, 1 AS n, coalesce(source, '') AS source, coalesce(target, '') AS target FROM p LEFT JOIN lx USING (item_id) LEFT JOIN ly USING (item_id)"""
)
def mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item and the next as lines of vocabulary ids, with their count."""
    i = items(spark, sf_dir).select("item_id", F.col("w").alias("source"))
    return counts.mapped_pairs(i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("source").alias("target")), "item_id"), "item_id", "source", "target")


@_R.query("SELECT l_orderkey, sum(n_small)::BIGINT AS n_small, max(reason) AS reason FROM (SELECT l_orderkey, CASE WHEN length(l_returnflag || l_linestatus) < 3 THEN 1 ELSE 0 END AS n_small, 'content' AS reason FROM lineitem) GROUP BY ALL")
def length_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records too short to summarise."""
    from glossa.operators.filters import length_reject

    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("c"), F.lit("d").alias("d"))
    r = li.withColumn("reason", length_reject("c", "d", 3, 1))
    return r.groupBy("l_orderkey").agg(F.count("reason").alias("n_small"), F.max("reason").alias("reason"))


@_R.query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda k: array_to_string(w[k:k + 1], ' '))) AS g FROM w), r AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w)), lambda k: array_to_string(w[k:k + 1], ' '))) AS g FROM i),
n AS (SELECT item_id, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT doc_id, item_id, round(sum(1 / n), 6) AS coverage FROM d JOIN r USING (g) JOIN n USING (item_id) GROUP BY ALL)
SELECT doc_id, item_id, coverage FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, item_id) = 1"""
)
def bigram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the reference whose bigrams it covers best, and their share."""
    pairs = lambda df, key: df.select(key, F.explode(F.array_distinct(T.ngrams("w", 2))).alias("gram"))
    d = load(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", T.tokens("text").alias("w"))
    best = similarity.supported_references(pairs(d, "doc_id"), pairs(items(spark, sf_dir), "item_id"), "doc_id", "item_id", "gram", 1)
    return best.select("doc_id", "item_id", F.col("score").alias("coverage"))


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), p AS (SELECT a.item_id, a.w[1:greatest(len(b.w), 1)] AS c, b.w AS r FROM i a JOIN i b ON b.item_id IN (a.item_id + 1, a.item_id + 2)),
q AS (SELECT row_number() OVER () AS k, * FROM p), c AS (SELECT k, any_value(item_id) AS item_id, x, count(*)::DOUBLE AS n FROM (SELECT k, item_id, unnest(c) AS x FROM q) GROUP BY k, x), r AS (SELECT k, x, count(*)::DOUBLE AS n FROM (SELECT k, unnest(r) AS x FROM q) GROUP BY k, x),
l AS (SELECT k, any_value(item_id) AS item_id, sqrt(sum(n * n)) AS l FROM c GROUP BY k), m AS (SELECT k, sqrt(sum(n * n)) AS m FROM r GROUP BY k), d AS (SELECT c.k, sum(c.n * r.n) AS d FROM c JOIN r ON c.k = r.k AND c.x = r.x GROUP BY c.k)
SELECT item_id, max(round(coalesce(d, 0) / (l * m), 6)) AS cosine FROM l JOIN m USING (k) LEFT JOIN d USING (k) GROUP BY item_id"""
)
def multi_ref_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cosine with two references, each against as many words."""
    i = items(spark, sf_dir)
    refs = i.select(F.explode(F.array(F.col("item_id") - 1, F.col("item_id") - 2)).alias("item_id"), F.col("w").alias("ref"))
    return evaluation.multi_reference_cosine(i.join(refs, "item_id"), "item_id", "w", "ref")


@_R.query(
    """WITH s AS (SELECT s_nationkey AS g, s_suppkey AS i, s_acctbal AS a, length(s_name) AS l FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l DESC, i) - 1 AS r1, row_number() OVER (PARTITION BY g ORDER BY a, i) - 1 AS r2 FROM s) SELECT g, i, round(r1 * sqrt(r2), 6) AS f FROM r"""
)
def two_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rank times the root of another."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("a"), F.length("s_name").alias("l"))
    return retrieval.two_rank(s, ["g"], F.col("l"), F.col("a"), "i").select("g", "i", F.round("f", 6).alias("f"))


@_R.query("SELECT o_orderkey AS url, o_orderdate::DATE::VARCHAR AS base, 'Top/' || o_orderstatus AS annotation FROM orders")
def category_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two parts of a category as annotation."""
    path = F.concat_ws("/", F.lit("Top"), "o_orderstatus", "o_orderpriority")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("base"), secondary.annotations(path).alias("annotation"))


@_R.query(
    f"""WITH t AS (SELECT doc_id % 5 AS m, unnest({_WORDS}) AS w FROM documents), c AS (SELECT m, '' AS ngram, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT m, w, count(*) FROM t GROUP BY ALL)
SELECT m AS model, q AS ngram, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT m FROM t), (SELECT unnest(['', 'the', 'nowhere at all']) AS q) LEFT JOIN (SELECT m AS k, ngram, n FROM c) ON k = m AND ngram = q"""
)
def sequence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a model is asked for."""
    from glossa.sources.readers import sequence_counts as asked_counts

    t = load(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("model"), F.explode(T.tokens("text")).alias("ngram"))
    asked = spark.range(5).select(F.col("id").alias("model"), F.explode(F.array(F.lit(""), F.lit("the"), F.lit("nowhere at all"))).alias("ngram"))
    return asked_counts(t.groupBy("model", "ngram").agg(F.count("*").alias("n")), asked)


@_R.query(
    f"""WITH {translation_sql(3)}, m AS (SELECT * FROM p2 WHERE p >= 1e-6), tf AS (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL), z AS (SELECT item_id, sum(n) AS z FROM tf GROUP BY ALL),
g AS (SELECT item_id, t, round(sum(n * p) / any_value(z), 9) AS score FROM tf JOIN m ON s = x JOIN z USING (item_id) GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, t) AS place FROM g)
SELECT item_id, string_agg(t, ' ' ORDER BY place) AS gist FROM best WHERE place <= 8 GROUP BY item_id"""
)
def noisy_channel_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words gists of the items by a translation table (M5)."""
    i = items(spark, sf_dir)
    pairs = i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id")
    return models.gist(i.select("item_id", F.explode("w").alias("word")), models.translation_model(pairs, "item_id", "w", "other", 3), "item_id", "word")


@_R.query()
def per_term_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier for each word of five items or more: does an item with these other words have it."""
    i = items(spark, sf_dir)
    terms = i.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter("n >= 5").select("term")
    rows = i.crossJoin(terms).select("term", "item_id", F.array_contains("w", F.col("term")).cast("int").alias("label"), V.from_tokens(F.array_remove("w", F.col("term")), binary=True).alias("features"))
    return models.per_term_models(rows, "term", "features", "label", "item_id").select("term", "n", F.size("weights").alias("n_weights"))


@_R.query(
    "SELECT item_id FROM benchmark ORDER BY md5('7/' || item_id) LIMIT 3"
)
def random_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random reference as a baseline summary (O5, O6, M4, S17); seeded."""
    return splits.random_pick(load(spark, sf_dir, "benchmark").select("item_id"), 3, seed=7)


@_R.query(
    f"""WITH a AS (SELECT item_id AS i, unnest({_WORDS}) AS w FROM benchmark), u AS (SELECT i, w, count(*) AS n FROM a GROUP BY ALL), d AS (SELECT w, count(*) AS c FROM u GROUP BY w), l AS (SELECT i, sum(n) AS l FROM u GROUP BY i)
SELECT i AS item_id, w AS word, round(1 / (1 + c), 9) AS tfidf, round((1 / length(w)) / (1 + c), 9) AS tfidf_length, round(least(1, c / 1173510) * (length(w) / l), 12) AS utterance FROM u JOIN d USING (w) JOIN l USING (i)"""
)
def token_rankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three token weights."""
    u = items(spark, sf_dir).select("item_id", F.explode("w").alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("n"))
    c = u.groupBy("word").agg(F.count("*").alias("c"))
    n = u.groupBy("item_id").agg(F.sum("n").alias("l"))
    w = V.token_weights(F.col("c"), F.length("word"), V.term_prior(F.col("c")), F.col("l"))
    return u.join(c, "word").join(n, "item_id").select("item_id", "word", F.round(w["tfidf"], 9).alias("tfidf"), F.round(w["tfidf_length"], 9).alias("tfidf_length"), F.round(w["utterance"], 12).alias("utterance"))


_COLLECT = f"""i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), t AS (SELECT item_id, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL), g AS (SELECT x, count(*) AS df, sum(n) AS c FROM t GROUP BY x),
l AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM t GROUP BY ALL), sim AS (SELECT a.item_id AS q, b.item_id AS doc, round(sum(a.n * b.n) / (any_value(la.l) * any_value(lb.l)), 6) AS score FROM t a JOIN t b USING (x) JOIN l la ON la.item_id = a.item_id JOIN l lb ON lb.item_id = b.item_id GROUP BY ALL),
r AS (SELECT * FROM (SELECT item_id AS q, x, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, x) AS rank FROM t JOIN g USING (x) WHERE c >= 2) WHERE rank <= 10), m AS (SELECT q, max(rank) AS n FROM r GROUP BY q),
h AS (SELECT q, t.item_id AS doc, unnest(range(rank, m.n + 1)) AS n_terms FROM r JOIN m USING (q) JOIN t USING (x) WHERE t.item_id <> q), p AS (SELECT q, n_terms, doc, count(*) AS k FROM h GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, n_terms ORDER BY k DESC, doc) AS z FROM p) WHERE z <= 5),
c AS (SELECT b.q, n_terms, round(avg(coalesce(score, 0)), 6) AS score, string_agg(b.doc::VARCHAR, ',' ORDER BY b.doc) AS docs FROM b LEFT JOIN sim ON sim.q = b.q AND sim.doc = b.doc GROUP BY ALL)"""


@_R.query(f"WITH {_COLLECT} SELECT q, n_terms, score, docs FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n_terms) AS z FROM c) WHERE z = 1")
def iterative_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the first terms that bring the nearest ones."""
    t = items(spark, sf_dir).select(F.col("item_id").alias("q"), F.explode("w").alias("word")).groupBy("q", "word").agg(F.count("*").cast("double").alias("w"))
    g = t.groupBy("word").agg(F.sum("w").alias("c")).filter("c >= 2")
    ranked = splits.top_per_group(t.join(g, "word"), ["q"], [F.desc("c"), F.asc("word")], 10).select("q", "word", F.col("rank").cast("long").alias("rank"))
    docs = t.withColumnRenamed("q", "doc")
    sim = retrieval.field_ranker(t, docs, "q", "doc", "word", "w").withColumn("score", F.round("score", 6))
    x = retrieval.iterative_query(ranked, docs, sim, "q", "word", "rank", "doc", 5)
    return x.select("q", "n_terms", "score", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@_R.query(
    """WITH r AS (SELECT a.s_suppkey AS q, b.s_suppkey AS doc, b.s_nationkey AS category FROM supplier a JOIN supplier b ON b.s_suppkey BETWEEN a.s_suppkey + 1 AND a.s_suppkey + 9),
n AS (SELECT q, category, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT q, category FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, category) AS k FROM n) WHERE k = 1)
SELECT r.q, r.doc, r.category FROM r JOIN t USING (q, category)"""
)
def category_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the main category."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_nationkey").alias("category"))
    r = s.select(F.col("doc").alias("q"), F.explode(F.sequence(F.col("doc") + 1, F.col("doc") + 9)).alias("doc"))
    return retrieval.main_category(r, s, "q", "doc", "category").select("q", "doc", "category")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id")


@_R.query()
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each item assigned to the next's at least cost (M8, V27's morphology)."""
    return summarize.align_words(_neighbours(spark, sf_dir), "item_id", "w", "other")


@_R.query()
def slot_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a reference for the next, words that are rare adapted to it (M7)."""
    common = items(spark, sf_dir).select("item_id", F.explode("w").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n")).filter("n >= 5")
    return summarize.adapt_references(_neighbours(spark, sf_dir), "item_id", "w", "other", common, "word")


@_R.query(
    f"""WITH i AS (SELECT {_WORDS} AS w FROM benchmark), p AS (SELECT w[k] || '-' || w[k + 1] AS pair FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i))
SELECT pair, count(*) AS n FROM p GROUP BY pair"""
)
def dependency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of head and dependent (A34), with each word the head of the next."""
    w = items(spark, sf_dir).filter(F.size("w") > 1).select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("head"), F.slice("w", 2, F.size("w") - 1).alias("dependent"))).alias("x"))
    return secondary.dependency_pairs(w.select("x.head", "x.dependent"))


@_R.query("SELECT event_type AS type, (user_id % 10)::VARCHAR AS entity, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by type over distinct segments."""
    e = load(spark, sf_dir, "events")
    return secondary.entity_counts(e.select(F.col("user_id").alias("segment"), F.col("event_type").alias("type"), (F.col("user_id") % 10).cast("string").alias("entity")))


@_R.query(f"SELECT w[1:1] AS synset, count(*)::BIGINT AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL")
def synset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts rolled up to senses (A37), with the first letter as the sense."""
    t = items(spark, sf_dir).select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return secondary.synset_counts(t, t.select("token", F.substring("token", 1, 1).alias("synset")))


@_R.query("SELECT c_custkey, o - 1 AS ord, CASE o WHEN 1 THEN c_name ELSE c_mktsegment END AS context FROM customer, (SELECT unnest([1, 2]) AS o) WHERE o = 1 OR c_custkey % 2 = 0")
def xml_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context elements of XML cells, one or several."""
    c = load(spark, sf_dir, "customer")
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<ContextElement>"), "c_mktsegment", F.lit("</ContextElement>"))).otherwise("")
    x = c.select("c_custkey", F.concat(F.lit("<Context><ContextElement>"), "c_name", F.lit("</ContextElement>"), second, F.lit("</Context>")).alias("x"))
    return secondary.contexts_from_xml(x, "x").withColumn("ord", F.col("ord").cast("long"))


@_R.query("SELECT r_name, g, count(*) AS n FROM (SELECT r_name, unnest(list_transform(range(1, length(r_name) - 1), lambda i: r_name[i:i + 2])) AS g FROM region) GROUP BY ALL")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character trigrams."""
    return load(spark, sf_dir, "region").select("r_name", F.explode(T.char_ngrams("r_name", 3)).alias("g")).groupBy("r_name", "g").agg(F.count("*").alias("n"))


@_R.query("SELECT DISTINCT 'Top/' || source || '/' || lang AS category, 3 AS depth, 'Top/' || source AS parent, 'Top,Top/' || source || ',Top/' || source || '/' || lang AS ancestors FROM documents")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, parent and ancestors of category paths."""
    c = load(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("Top"), "source", "lang").alias("category")).distinct()
    return c.select("category", T.category_depth("category").alias("depth"), T.category_parent("category", 2).alias("parent"), F.array_join(T.category_ancestors("category"), ",").alias("ancestors"))


@_R.query(
    f"""WITH t AS (SELECT item_id AS i, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest({_WORDS}) AS x FROM benchmark) GROUP BY ALL), d AS (SELECT x, count(*) AS df FROM t GROUP BY x), l AS (SELECT i, sqrt(sum(n * n)) AS l FROM t GROUP BY i)
SELECT a.i AS a, b.i AS b, round(sum(a.n * b.n / (df * df)) / (any_value(la.l) * any_value(lb.l)), 9) AS cosine FROM t a JOIN t b ON a.x = b.x AND a.i < b.i JOIN d ON d.x = a.x JOIN l la ON la.i = a.i JOIN l lb ON lb.i = b.i GROUP BY ALL"""
)
def damped_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines with products damped by document frequency (V4, V5)."""
    c = items(spark, sf_dir).select("item_id", F.explode("w").alias("w")).groupBy("item_id", "w").agg(F.count("*").cast("double").alias("n"))
    df = c.groupBy("w").agg(F.count("*").alias("df"))
    return stats.cosine_pairs(c, "item_id", "w", "n", df).select("a", "b", F.round("cosine", 9).alias("cosine"))


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), t AS (SELECT item_id, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL), s AS (SELECT item_id, sum(n) AS s, count(*) AS d, sqrt(sum(n * n)) AS l FROM t GROUP BY item_id),
p AS (SELECT item_id, -sum((n / s) * ln(n / s)) AS h FROM t JOIN s USING (item_id) GROUP BY item_id)
SELECT item_id, round(l, 9) AS norm, s AS total, d::INT AS dimensions, round(h, 9) AS entropy FROM s JOIN p USING (item_id)"""
)
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, sizes and entropy of map vectors."""
    v = items(spark, sf_dir).filter(F.size("w") > 0).select("item_id", V.from_tokens("w").alias("v"))
    return v.select("item_id", F.round(V.norm("v"), 9).alias("norm"), V.total("v").alias("total"), V.dimensions("v").alias("dimensions"), F.round(V.entropy(V.scale("v", 1 / V.total("v"))), 9).alias("entropy"))
