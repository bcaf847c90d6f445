"""Queries of the sequence, clustering, summary and model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import sequences as Q
from glossa.functions import text as T
from glossa.operators import blocks, clustering, evaluation, models, secondary, stats, summarize, wordgraph
from glossa.plans.common import Registry, load
from glossa.plans import pages
from glossa.plans.additions import translation_sql
from glossa.plans.textual import items

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_WORDS = r"regexp_extract_all(lower(text), '[^\s[:punct:]]+')"

# longest common subsequences, a row of the table at a time
_LCS = f"""i AS (SELECT item_id, (item_id % 4)::VARCHAR AS category, {_WORDS} AS w FROM benchmark),
q AS (SELECT a.category, a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM i a JOIN i b ON a.category = b.category AND a.item_id < b.item_id),
o AS MATERIALIZED (SELECT category, a, b, CASE WHEN greatest(len(x), len(y)) > 0 THEN list_max(list_reduce(list_transform(range(1, len(x) + 1), lambda k: [k]),
  lambda row, k: list_concat([0::BIGINT], list_transform(range(1, len(y) + 1), lambda n: list_max(list_transform(range(1, n + 1), lambda j: greatest(row[j + 1], CASE WHEN y[j] = x[k[1]] THEN row[j] + 1 ELSE 0 END))))),
  list_transform(range(0, len(y) + 1), lambda z: 0::BIGINT)))::DOUBLE / greatest(len(x), len(y)) ELSE 0 END AS overlap FROM q)"""

_CLUSTERS = f"""{_LCS}, e AS (SELECT category, a, b FROM o WHERE overlap > 0 AND overlap >= 0.2), t AS (SELECT category, a, b FROM e UNION ALL SELECT category, b, a FROM e),
r AS (SELECT category, item_id, item_id AS other FROM i UNION SELECT r.category, r.item_id, t.b FROM r JOIN t ON t.category = r.category AND t.a = r.other),
m AS (SELECT category, item_id, min(other) AS root FROM r GROUP BY ALL), c AS (SELECT category, 0::INT AS block, item_id, dense_rank() OVER (PARTITION BY category ORDER BY root) - 1 AS cluster FROM m)"""


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the next one's tokens."""
    i = items(spark, sf_dir)
    return i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id")


def _grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("category", (F.col("item_id") % 4).cast("string"))


@_R.query(
    f"WITH {_LCS} SELECT category, a, b, overlap FROM o"
)
def lcs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of all pairs within a category."""
    return clustering.pair_overlaps(_grouped_items(spark, sf_dir), "category", "item_id", "w")


@_R.query(
    f"WITH {_LCS}, z AS (SELECT a AS item_id, b AS n, overlap FROM o UNION ALL SELECT b, a, overlap FROM o) SELECT item_id, n AS nearest, overlap FROM z QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, n) = 1"
)
def template_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest item of the category."""
    return clustering.nearest_in_group(_grouped_items(spark, sf_dir), "category", "item_id", "w")


@_R.query(
    f"WITH {_LCS} SELECT category, round(avg(overlap), 6) AS mean, round(stddev_pop(overlap), 6) AS sd, count(*) AS n FROM o GROUP BY category"
)
def lcs_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the overlaps of a category."""
    return lcs_pairs(spark, sf_dir).groupBy("category").agg(F.round(F.avg("overlap"), 6).alias("mean"), F.round(F.stddev_pop("overlap"), 6).alias("sd"), F.count("*").alias("n"))


@_R.query()
def diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from each item to the next."""
    d = _next(spark, sf_dir).select("item_id", F.posexplode(Q.diff_operations("w", "other")).alias("ord", "x"))
    return d.select("item_id", "ord", "x.op", "x.from", "x.to")


@_R.query()
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each item aligned to the next's."""
    return _next(spark, sf_dir).select("item_id", F.explode(Q.alignment("w", "other")).alias("from", "to"))


@_R.query()
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each item becomes the next with the words of a document."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), T.tokens("text").alias("known"))
    return clustering.reach_targets(_next(spark, sf_dir).join(d, "item_id"), "known", "w", "other", ["item_id"])


@_R.query()
def reachability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 table of reachability and length."""
    return clustering.reach_contingency(reachability(spark, sf_dir), F.col("ratio") >= 0.55, F.col("n_ops") >= 30)


@_R.query(
    f"WITH RECURSIVE {_CLUSTERS} SELECT category, block, item_id, cluster FROM c"
)
def cluster_single_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-link clusters of each category."""
    return clustering.cluster_groups(_grouped_items(spark, sf_dir), "category", "item_id", "w", 0.2)


@_R.query(
    f"""WITH RECURSIVE {_CLUSTERS}, k AS (SELECT category, cluster, count(*) AS k FROM c GROUP BY ALL)
SELECT category, sum(k)::BIGINT AS n, count(*) FILTER (k >= 2) AS n_clusters, round(coalesce(sum(k) FILTER (k >= 2), 0) / sum(k), 6) AS clusterable, round(max(k) / sum(k), 6) AS largest FROM k GROUP BY category"""
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusterable and largest shares."""
    return clustering.cluster_stats(cluster_single_link(spark, sf_dir), "category", "item_id")


@_R.query()
def min_cut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of order priorities by a cut of each nation's graph."""
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = o.groupBy("c_nationkey", "o_orderpriority", "c_mktsegment").agg(F.count("*").cast("double").alias("capacity"))
    mid = w.select("c_nationkey", F.col("o_orderpriority").alias("src"), F.col("c_mktsegment").alias("dst"), "capacity")
    ends = w.groupBy("c_nationkey", F.lit("s").alias("src"), F.col("o_orderpriority").alias("dst")).agg((F.sum("capacity") / 2).alias("capacity"))
    sinks = w.groupBy("c_nationkey", F.col("c_mktsegment").alias("src"), F.lit("t").alias("dst")).agg((F.sum("capacity") / 3).alias("capacity"))
    return clustering.cut_groups(mid.unionByName(ends).unionByName(sinks), "c_nationkey")


_SENTENCES = r"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([A-Za-z0-9_][.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '([A-Za-z0-9_][.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '[\x00-\x1F\x7F]+'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '\S$'))"""

@_R.query()
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of conversations: the user's sentences as context, the assistant's as content (M2)."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "role", "turn", T.sentences("text").alias("s"))
    both = c.groupBy("conv_id").agg(*[F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "s")))), lambda x: x["s"])).alias(n) for r, n in (("user", "context"), ("assistant", "content"))])
    return summarize.context_summaries(both, "conv_id", "context", "content")


@_R.query(
    rf"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS ord FROM documents),
t AS (SELECT doc_id, ord, w, count(*) AS n FROM (SELECT doc_id, ord, unnest({_WORDS}) AS w FROM s WHERE length(text) >= 10) GROUP BY ALL), d AS (SELECT doc_id, w, sum(n) AS d FROM t GROUP BY ALL),
c AS (SELECT doc_id, ord, round(sum(n * d) / sqrt(sum(n * n)), 6) AS score FROM t JOIN d USING (doc_id, w) GROUP BY ALL)
SELECT doc_id, ord, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1"""
)
def centroid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each document nearest to its centroid (M3)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    s = summarize.extract_sentences(d, "doc_id", {"content": "text"}, 10)
    return summarize.centroid_summary(s.select("doc_id", "ord", T.tokens("sentence").alias("w")), "doc_id", "ord", "w")


@_R.query(
    f"""WITH s AS ({pages.ORACLE["support_ranker"]}), x AS (SELECT s.page_id, s.score, {pages._TITLE} AS title, b.text AS reference FROM s JOIN pages p USING (page_id) JOIN benchmark b USING (item_id) WHERE s.rank = 1)
SELECT page_id, CASE WHEN score < 0.5 AND title <> '' THEN title ELSE reference END AS summary, title || ' | ' || reference AS joined FROM x"""
)
def hybrid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference that the page supports best, or the page's title where that is less than half (M6)."""
    from glossa.plans.pages import support_ranker

    s = support_ranker(spark, sf_dir).filter("rank = 1").select("page_id", "item_id", "score")
    p = load(spark, sf_dir, "pages").select("page_id", T.html_title("html").alias("title"))
    r = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    x = s.join(p, "page_id").join(r, "item_id")
    return x.select("page_id", summarize.hybrid_summary(F.col("title"), F.col("reference"), F.col("score")).alias("summary"), summarize.hybrid_summary(F.col("title"), F.col("reference"), F.col("score"), joined=True).alias("joined"))


@_R.query()
def word_graph_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence for each set of near-alike sentences of a source and language, fused from all of them."""
    d = load(spark, sf_dir, "documents").select(F.struct("doc_id", F.concat_ws("/", "source", "lang").alias("category")).alias("d"), "text")
    s = summarize.extract_sentences(d, "d", {"content": "text"}).select("d.doc_id", "d.category", T.tokens("sentence").alias("w"))
    return wordgraph.compress_groups(s, "category", "doc_id", "w", least=6)


@_R.query(
    """WITH v AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount), 6) - round(avg(l_tax), 6) AS d FROM lineitem GROUP BY ALL), d AS (SELECT l_returnflag, d::DOUBLE AS d, round(abs(d::DOUBLE), 12) AS a FROM v),
z AS (SELECT l_returnflag, abs(d) AS a, count(*)::DOUBLE AS n, count(*) FILTER (d > 0) AS up FROM d GROUP BY ALL),
k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM z),
s AS (SELECT l_returnflag, sum(n) AS m, coalesce(sum(n) FILTER (a = 0), 0) AS zeros, sum(up * rank) AS w, coalesce(sum(n * n * n - n) FILTER (a > 0), 0) AS ties FROM k GROUP BY ALL),
y AS (SELECT *, abs(w - (m * (m + 1) - zeros * (zeros + 1)) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - zeros * (zeros + 1) * (2 * zeros + 1)) / 24 - ties / 48) AS dev FROM s),
h AS (SELECT l_returnflag, unnest(range(0, 2001)) AS i, least(dev, 12) / 2000 AS h FROM y),
p AS (SELECT l_returnflag, round(greatest(1 - 2 * any_value(h) / 3 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * h) * (i * h) / 2) / sqrt(2 * pi())), 0), 6) AS p FROM h GROUP BY l_returnflag),
t AS (SELECT l_returnflag, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 9) AS t FROM d GROUP BY ALL)
SELECT l_returnflag, m::BIGINT AS n, w, p, p < 0.05 AS significant, t FROM y JOIN p USING (l_returnflag) JOIN t USING (l_returnflag)"""
)
def wilcoxon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significance of paired scores by ship mode flags."""
    li = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("x"), F.round(F.avg("l_tax"), 6).alias("y"))
    return evaluation.significance(li, ["l_returnflag"], "x", "y")


@_R.query(
    f"WITH {translation_sql(5)} SELECT s AS source, t AS target, round(p, 6) AS p FROM p4 WHERE p >= 1e-6 AND round(p, 6) >= 0.01"
)
def translation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical translation between each item and the next, after five steps (M5)."""
    x = models.translation_model(_next(spark, sf_dir), "item_id", "w", "other")
    return x.select("source", "target", F.round("p", 6).alias("p")).filter("p >= 0.01")


@_R.query()
def topic_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic shares of the documents (K1)."""
    from pyspark.ml.functions import vector_to_array

    d = load(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("w"))
    return models.topics(d, "w", 4).transform(d).select("doc_id", vector_to_array("topicDistribution").alias("topics"))


@_R.query()
def linear_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression of the quality label on words (K4)."""
    d = load(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("w")).join(load(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    return models.logistic(d, "w", "label").transform(d).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


@_R.query(
    r"""WITH t AS (SELECT doc_id, 'Top/' || source || '/' || lang AS c, 'Top/' || source AS b, 'Top' AS a, unnest(regexp_extract_all(lower(text), '[^\s[:punct:]]+')) AS w FROM documents),
nc AS (SELECT c, w, count(*) AS n FROM t GROUP BY c, w), nb AS (SELECT b, w, count(*) AS n FROM t GROUP BY b, w), na AS (SELECT a, w, count(*) AS n FROM t GROUP BY a, w),
pc AS (SELECT c, w, n / sum(n) OVER (PARTITION BY c) AS p FROM nc), pb AS (SELECT b, w, n / sum(n) OVER (PARTITION BY b) AS p FROM nb), pa AS (SELECT a, w, n / sum(n) OVER (PARTITION BY a) AS p FROM na)
SELECT t.doc_id, round(exp(-avg(ln(0.2 * pa.p + 0.3 * pb.p + 0.5 * pc.p))), 3) AS perplexity FROM t JOIN pa ON pa.w = t.w JOIN pb ON pb.b = t.b AND pb.w = t.w JOIN pc ON pc.c = t.c AND pc.w = t.w GROUP BY t.doc_id"""
)
def hierarchical_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity under the mixture of a category's levels (K3)."""
    d = blocks.dealt(load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("Top"), "source", "lang").alias("path"), "text"), "doc_id", "path")
    t = d.select(blocks.BLOCK, "doc_id", "path", F.explode(T.tokens("text")).alias("word"))
    return models.hierarchical_perplexity(t, "doc_id", "path", "word").select("doc_id", F.round("perplexity", 3).alias("perplexity"))


@_R.query(
    r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\s[:punct:]]+') AS w FROM benchmark),
g AS (SELECT item_id, o, list_distinct(list_transform(range(1, len(w) - o + 2), lambda k: array_to_string(w[k:k + o - 1], ' '))) AS g FROM i, (SELECT unnest([1, 2, 3]) AS o)),
x AS (SELECT a.item_id, a.o, CASE WHEN len(b.g) > 0 THEN len(list_intersect(a.g, b.g)) / len(b.g) ELSE 0 END AS v FROM g a JOIN g b ON b.item_id = a.item_id + 1 AND a.o = b.o)
SELECT item_id, round(max(v) FILTER (o = 1), 6) AS overlap_1, round(max(v) FILTER (o = 2), 6) AS overlap_2, round(max(v) FILTER (o = 3), 6) AS overlap_3 FROM x GROUP BY item_id"""
)
def energy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-gram overlap features of each item and the next."""
    e = models.energy_features(_next(spark, sf_dir), "w", "other")
    return e.select("item_id", *[F.round(f"overlap_{n}", 6).alias(f"overlap_{n}") for n in (1, 2, 3)])


@_R.query(
    r"""WITH b AS (SELECT source || '/' || lang AS category, w AS token, count(*) AS n FROM (SELECT source, lang, unnest(regexp_extract_all(text, '[^\s[:punct:]]+')) AS w FROM documents) WHERE regexp_matches(w, '^[a-z]') GROUP BY ALL HAVING count(*) >= 3)
SELECT token, count(DISTINCT category) AS n FROM b GROUP BY token HAVING count(DISTINCT category) >= 3"""
)
def functional_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of at least three categories."""
    t = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("category"), F.explode(T.tokens("text", lower=False)).alias("surface"))
    return secondary.attribute_categories(secondary.functional_attributes(t, "category", "surface"), "token", "category")


@_R.query(
    r"""WITH d AS (SELECT source AS field, unnest(regexp_extract_all(lower(text), '[^\s[:punct:]]+')) AS w FROM documents), p AS (SELECT DISTINCT field, w FROM d),
t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\s[:punct:]]+')) AS w FROM benchmark)
SELECT field, count(*) AS n, count(t.w) AS covered, round(count(t.w) / count(*), 6) AS share FROM p LEFT JOIN t USING (w) GROUP BY field"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's words that the benchmark has."""
    d = load(spark, sf_dir, "documents").select(F.lit(1).alias("k"), F.col("source").alias("field"), F.explode(T.tokens("text")).alias("w"))
    return summarize.coverage_report(d, items(spark, sf_dir).select(F.lit(1).alias("k"), F.explode("w").alias("w")), "k", "field", "w")


@_R.query(
    f"""WITH i AS (SELECT {_WORDS} AS w FROM benchmark), b AS (SELECT w[k] AS previous, w[k + 1] AS word, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i) GROUP BY ALL), u AS (SELECT w AS word, count(*) AS c FROM (SELECT unnest(w) AS w FROM i) GROUP BY w)
SELECT previous, word, round(n / sum(n) OVER (PARTITION BY previous), 9) AS score FROM b UNION ALL SELECT NULL, word, round(0.4 * c / (SELECT sum(c) FROM u), 9) FROM u"""
)
def bigram_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram shares and the unigrams that they back off to."""
    t = items(spark, sf_dir).select("item_id", F.posexplode("w").alias("pos", "word"))
    return stats.backoff_model(t, "item_id", "pos", "word").withColumn("score", F.round("score", 9))


@_R.query(
    """WITH g AS (SELECT event_type, user_id, count(*) AS v FROM events GROUP BY ALL), m AS (SELECT event_type, min(v) AS m, sum(v) AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT event_type, user_id, round(CASE WHEN s - n * m > 0 THEN (v - m) / (s - n * m) ELSE 1 / n END, 9) AS p FROM g JOIN m USING (event_type)"""
)
def shifted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as shifted distributions."""
    g = load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("v"))
    return models.shifted_distribution(g, "event_type", "v").select("event_type", "user_id", F.round("p", 9).alias("p"))

