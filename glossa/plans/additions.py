"""Queries of contexts, chunks, entities, formats and the remaining models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators import contexts, evaluation, models, retrieval, splits, stats, summarize
from glossa.operators.joins import with_ordinal
from glossa.plans.common import Registry, load
from glossa.plans.textual import items
from glossa.sources import readers, sinks
from glossa.sources.storage import shared_dir

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_WORDS = r"regexp_extract_all(lower(text), '[^\s[:punct:]]+')"
_ITEMS = f"i AS (SELECT item_id, {_WORDS} AS w FROM benchmark)"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the next one's words."""
    i = items(spark, sf_dir)
    return i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- contexts and chunks -------------------------------------------------------------------------


@_R.query(
    r"""WITH p AS (SELECT page_id, string_split_regex(regexp_replace(html, '\n', ' ', 'g'), '(?is)<a\s+[^>]+>') AS parts FROM pages)
SELECT page_id, len(parts) - 1 AS n_links, md5(regexp_replace(array_to_string(list_transform(parts, lambda x, i: CASE WHEN i > 1 THEN 'LINKMARK ' || (i - 2) || ' ' || x ELSE x END), ''), '(?i)</a>', 'LINKMARK', 'g')) AS marked FROM p"""
)
def context_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with marked links."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.size(contexts.link_targets("html")).cast("long").alias("n_links"), F.md5(contexts.mark_links("html")).alias("marked"))


@_R.query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\n', ' ', 'g'), '(?is)<a\s+[^>]+>', ' ', 'g'), '(?i)</a>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""
)
def context_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked links taken out again, and runs of white space shortened."""
    return load(spark, sf_dir, "pages").select("page_id", F.md5(contexts.cleanse(contexts.unmark_links(contexts.mark_links("html")))).alias("text"))


@_R.query("SELECT page_id, md5(base64(encode(html))) AS encoded, true AS same FROM pages")
def content_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as base64, and whether they come back."""
    p = load(spark, sf_dir, "pages").select("page_id", "html", contexts.serialized("html").alias("e"))
    return p.select("page_id", F.md5("e").alias("encoded"), (contexts.deserialized("e") == F.col("html")).alias("same"))


@_R.query(f"SELECT item_id, array_to_string(list_filter({_WORDS}, lambda x: length(x) >= 5), ' ') AS chunks FROM benchmark")
def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries' words of five letters or more (P10)."""
    kept = contexts.filtered_summaries(items(spark, sf_dir), "w", lambda x: F.length(x) >= 5)
    return kept.select("item_id", F.array_join("w", " ").alias("chunks"))


@_R.query(
    f"""WITH {_ITEMS}, d AS (SELECT a.item_id, list_distinct(a.w) AS x, list_distinct(b.w) AS y, list_distinct(a.w[1:3]) AS z FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, round(least(1 - len(list_intersect(x, y)) / greatest(len(x), len(y)), 1 - len(list_intersect(z, y)) / greatest(len(z), len(y))), 6) AS distance FROM d"""
)
def chunk_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each item, in whole or by its first words, from the next."""
    n = _neighbours(spark, sf_dir)
    own = F.array(F.array_join("w", " "), F.array_join(F.slice("w", 1, 3), " "))
    return n.select("item_id", F.round(contexts.chunk_distance(own, F.array(F.array_join("other", " "))), 6).alias("distance"))


@_R.query(
    f"""WITH {_ITEMS}, d AS (SELECT a.item_id, list_transform(a.w, lambda x: CASE WHEN list_contains(b.w, x) THEN chr(9) ELSE x END) AS m FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, array_to_string(list_filter(list_transform(string_split(array_to_string(m, ' '), chr(9)), lambda x: trim(x)), lambda x: x <> ''), '|') AS pieces FROM d"""
)
def chunk_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each item between words of the next."""
    n = _neighbours(spark, sf_dir)
    return n.select("item_id", F.array_join(contexts.split_on(F.array_join("w", " "), "other"), "|").alias("pieces"))


@_R.query("WITH s AS (SELECT DISTINCT c_mktsegment AS name, 'n' || c_nationkey AS r FROM customer) SELECT name, string_agg(r, '|' ORDER BY r) AS representations FROM s GROUP BY name")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one name merged."""
    c = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("representations"))
    return contexts.merge_chunks(c, "name", "representations").select("name", F.array_join("representations", "|").alias("representations"))


# -- entities and distances ----------------------------------------------------------------------


@_R.query("SELECT c_custkey, r_name AS types FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 1")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of customers' nations by exact normal form (X26); every other name is misspelt."""
    n = load(spark, sf_dir, "nation")
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), F.lower("n_name"), F.lit(";"))).otherwise(F.concat("n_name", F.lit("x"))).alias("string"))
    e = n.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("types"))
    return contexts.entity_types(s, "string", e).select("c_custkey", "types")


@_R.query(
    r"""WITH e AS (SELECT p_name AS entity, min(p_type) AS types FROM part GROUP BY p_name), w AS (SELECT entity, types, unnest(regexp_extract_all(lower(entity), '[^\s[:punct:]]+')) AS w FROM e)
SELECT w AS word, min(entity) AS entity, arg_min(types, entity) AS types FROM w GROUP BY w"""
)
def entity_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part whose name has a word."""
    e = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("entity")).agg(F.min("p_type").alias("types"))
    words = e.select(F.explode(T.tokens("entity")).alias("word")).distinct()
    return contexts.best_entities(words, "word", e)


@_R.query(
    f"""WITH a AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), b AS (SELECT source AS term, unnest({_WORDS}) AS w FROM documents),
x AS (SELECT item_id, w, count(*)::DOUBLE AS n FROM a GROUP BY ALL), y AS (SELECT term, w, count(*)::DOUBLE AS n FROM b GROUP BY ALL), lx AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM x GROUP BY ALL), ly AS (SELECT term, sqrt(sum(n * n)) AS l FROM y GROUP BY ALL)
SELECT item_id, term, round(sum(x.n * y.n) / (any_value(lx.l) * any_value(ly.l)), 6) AS similarity FROM x JOIN y USING (w) JOIN lx USING (item_id) JOIN ly USING (term) GROUP BY ALL"""
)
def semantic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of items to terms, each with the words of its text (X30); the sources stand for terms."""
    a = items(spark, sf_dir).select("item_id", F.explode("w").alias("word"))
    b = load(spark, sf_dir, "documents").select(F.col("source").alias("term"), F.explode(T.tokens("text")).alias("word"))
    return contexts.semantic_similarity(a, b, "item_id", "term", "word").select("item_id", "term", F.round("similarity", 6).alias("similarity"))


_FEATURES = f"""{_ITEMS}, t AS (SELECT item_id, w[k] AS x, w[k + 1] AS next, k FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS k FROM i)), n AS (SELECT x, count(*) AS n FROM t GROUP BY x),
mv AS (SELECT x, 'i' || (item_id % 8) AS f, count(*)::DOUBLE AS v FROM t GROUP BY ALL), av AS (SELECT x, CASE WHEN k <= 5 THEN 'early' ELSE 'late' END AS f, count(*)::DOUBLE AS v FROM t GROUP BY ALL), cv AS (SELECT x, length(next)::VARCHAR AS f, count(*)::DOUBLE AS v FROM t WHERE next IS NOT NULL GROUP BY ALL),
p AS (SELECT DISTINCT a.w[1] AS a, b.w[1] AS b FROM i a JOIN i b ON b.item_id IN (a.item_id + 1, a.item_id + 2, a.item_id + 3))"""


def _cos(v: str) -> str:
    return f"""(SELECT a, b, coalesce((SELECT sum(s.v * u.v) FROM {v} s JOIN {v} u ON s.f = u.f WHERE s.x = a AND u.x = b) / nullif(sqrt((SELECT sum(s.v * s.v) FROM {v} s WHERE s.x = a)) * sqrt((SELECT sum(s.v * s.v) FROM {v} s WHERE s.x = b)), 0), 0) AS c FROM p)"""


@_R.query(
    f"""WITH {_FEATURES}, m AS {_cos("mv")}, ap AS {_cos("av")}, cx AS {_cos("cv")}
SELECT p.a, p.b, round(0.1 * CASE WHEN regexp_matches(p.a, '^[0-9]') <> regexp_matches(p.b, '^[0-9]') THEN 0 ELSE least(length(p.a), length(p.b)) / greatest(length(p.a), length(p.b)) * exp(-levenshtein(p.a, p.b)) END
 + 0.6 * abs(m.c - 1) / 2 + 0.1 * (1 - ap.c) + 0.1 * (1 - cx.c) + 0.1 * abs(na.n - nb.n) / greatest(na.n, nb.n), 6) AS distance
FROM p JOIN m USING (a, b) JOIN ap USING (a, b) JOIN cx USING (a, b) JOIN n na ON na.x = p.a JOIN n nb ON nb.x = p.b WHERE regexp_full_match(p.a || p.b, '[\\x00-\\x7F]*')"""
)
def word_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite distance of first words of neighbouring items (V27), in ASCII, as edit distances elsewhere may count bytes."""
    i = items(spark, sf_dir)
    t = i.select("item_id", F.posexplode("w").alias("k", "word"), "w").withColumn("next", F.get("w", F.col("k") + 1))

    def vectors(feature, name: str) -> DataFrame:
        c = t.select("word", feature.alias("f")).filter("f is not null").groupBy("word", "f").agg(F.count("*").cast("double").alias("v"))
        return c.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias(name))

    known = t.groupBy("word").agg(F.count("*").alias("n"))
    for feature, name in ((F.concat(F.lit("i"), F.col("item_id") % 8), "meaning"), (F.when(F.col("k") < 5, "early").otherwise("late"), "appearance"), (F.length("next").cast("string"), "context")):
        known = known.join(vectors(feature, name), "word", "left")
    first = i.select("item_id", F.get("w", F.lit(0)).alias("a"))
    near = first.select("a", F.explode(F.array(*[F.col("item_id") + d for d in (1, 2, 3)])).alias("item_id")).join(first.withColumnRenamed("a", "b"), "item_id")
    pairs = near.select("a", "b").distinct().filter(F.concat("a", "b").rlike(r"^[\x00-\x7F]*$"))
    return contexts.composite_distance(pairs, "a", "b", known).select("a", "b", F.round("distance", 6).alias("distance"))


# -- models --------------------------------------------------------------------------------------


@_R.query(
    f"""WITH RECURSIVE t AS (SELECT doc_id, source, lang, unnest({_WORDS}) AS w FROM documents), n AS (SELECT doc_id, w, count(*)::DOUBLE AS n FROM t GROUP BY ALL), l AS (SELECT DISTINCT doc_id, 's:' || source AS l FROM t UNION SELECT DISTINCT doc_id, 'l:' || lang FROM t),
x AS MATERIALIZED (SELECT n.doc_id, w, l, n FROM n JOIN l USING (doc_id)), v AS (SELECT count(DISTINCT w) AS v FROM x),"""
    + ",".join(
        f"""
g{k} AS MATERIALIZED (SELECT doc_id, w, l, n * q / sum(q) OVER (PARTITION BY doc_id, w) AS g FROM (SELECT x.*, {"1.0" if not k else "p * share"} AS q FROM x {"" if not k else f"JOIN p{k - 1} USING (l, w) JOIN s{k - 1} USING (doc_id, l)"})),
p{k} AS MATERIALIZED (SELECT l, w, (sum(g) + 0.01) / (sum(sum(g)) OVER (PARTITION BY l) + 0.01 * any_value(v)) AS p FROM g{k}, v GROUP BY l, w),
s{k} AS MATERIALIZED (SELECT doc_id, l, (sum(g) + 0.1) / (sum(sum(g)) OVER (PARTITION BY doc_id) + 0.1 * count(*) OVER (PARTITION BY doc_id)) AS share FROM g{k} GROUP BY doc_id, l)"""
        for k in range(3)
    )
    + " SELECT doc_id, l AS label, round(share, 6) AS share FROM s2"
)
def labeled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a document's labels, its source and language, after three steps (K1)."""
    labels = F.array(F.concat(F.lit("s:"), "source"), F.concat(F.lit("l:"), "lang")).alias("labels")
    d = load(spark, sf_dir, "documents").select("doc_id", labels, "text")
    _, share = models.labeled_topics(d, "doc_id", "labels", T.tokens("text"))
    return share.select("doc_id", "label", F.round("share", 6).alias("share"))


_PAIRS = f"{_ITEMS}, a AS (SELECT a.item_id, list_distinct(list_concat([''], a.w)) AS s, b.w AS t FROM i a JOIN i b ON b.item_id = a.item_id + 1), k AS MATERIALIZED (SELECT item_id, s, t, count(*)::DOUBLE AS n FROM (SELECT item_id, s, unnest(t) AS t FROM (SELECT item_id, unnest(s) AS s, t FROM a)) GROUP BY ALL)"


def translation_sql(steps: int) -> str:
    """Lexical translation of items into the next ones, step by step."""
    out = _PAIRS
    for k in range(steps):
        x = "SELECT *, 1.0 AS p FROM k" if not k else f"SELECT k.*, p FROM k JOIN p{k - 1} USING (s, t)"
        out += f", c{k} AS (SELECT s, t, sum(g) AS c FROM (SELECT s, t, n * p / sum(p) OVER (PARTITION BY item_id, t) AS g FROM ({x})) GROUP BY s, t), p{k} AS MATERIALIZED (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM c{k})"
    return out


@_R.query(
    f"""WITH {translation_sql(3)}, m AS (SELECT s, t, round(p, 6) AS p FROM p2 WHERE p >= 1e-6), x AS (SELECT a.item_id, a.w AS w, b.w AS o FROM i a JOIN i b ON b.item_id = a.item_id + 1),
u AS (SELECT item_id, k, w[k] AS w, o, list_contains(o, w[k]) AS have FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM x)),
r AS (SELECT item_id, k, w, first(t ORDER BY p DESC, t) AS new FROM u JOIN m ON s = w AND list_contains(o, t) WHERE NOT have GROUP BY ALL)
SELECT item_id, string_agg(coalesce(new, u.w), ' ' ORDER BY k) AS adapted FROM u LEFT JOIN r USING (item_id, k) GROUP BY item_id"""
)
def global_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item adapted to the next by the corpus's translations (M7)."""
    n = _neighbours(spark, sf_dir)
    model = models.translation_model(n, "item_id", "w", "other", 3).withColumn("p", F.round("p", 6))
    return summarize.global_adaptation(n, "item_id", "w", "other", model)


@_R.query(
    f"""WITH {_ITEMS}, t AS (SELECT item_id, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL), q AS (SELECT * FROM t), l AS (SELECT x, sqrt(sum(n * n)) AS l FROM q GROUP BY x),
c AS (SELECT a.x AS a, b.x AS b, round(sum(a.n * b.n) / (any_value(la.l) * any_value(lb.l)), 6) AS cosine FROM q a JOIN q b ON a.item_id = b.item_id AND a.x <> b.x JOIN l la ON la.x = a.x JOIN l lb ON lb.x = b.x GROUP BY ALL),
p AS (SELECT a.item_id, a.w AS s, list_distinct(b.w) AS t FROM i a JOIN i b ON b.item_id = a.item_id + 1), s AS (SELECT DISTINCT item_id, unnest(s) AS x, t FROM p),
f AS (SELECT item_id, x, x AS y, 1.0 AS cosine FROM s WHERE list_contains(t, x) UNION ALL SELECT item_id, x, b, cosine FROM s JOIN c ON a = x AND list_contains(t, b))
SELECT item_id, x AS "from", first(y ORDER BY cosine DESC, y) AS "to", max(cosine) AS similarity FROM f GROUP BY ALL"""
)
def embedding_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words aligned by their vectors over the items (M8); the pairs of a vector are those of its item's words."""
    t = items(spark, sf_dir).select("item_id", F.explode("w").alias("x")).groupBy("item_id", "x").agg(F.count("*").cast("double").alias("n"))
    cos = stats.cosine_pairs(t, "x", "item_id", "n").withColumn("cosine", F.round("cosine", 6))
    both = cos.unionByName(cos.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    return summarize.embedding_alignment(_neighbours(spark, sf_dir), "item_id", "w", "other", both)


@_R.query(
    f"""WITH {_ITEMS}, s AS (SELECT unnest([1, 2, 3, 4]) AS o), g AS (SELECT item_id, o, array_to_string(w[k:k + o - 1], ' ') AS g FROM (SELECT item_id, w, o, unnest(range(1, len(w) - o + 2)) AS k FROM i, s)),
c AS (SELECT item_id, o, g, count(*)::DOUBLE AS n FROM g GROUP BY ALL), t AS (SELECT item_id, o, sum(n) AS t FROM c GROUP BY ALL), m AS (SELECT a.item_id, a.o, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.o = b.o AND a.g = b.g AND b.item_id = a.item_id + 1 GROUP BY ALL),
x AS (SELECT a.item_id, a.o, coalesce(m, 0) AS m, a.t AS c, b.t AS r FROM t a JOIN t b ON b.item_id = a.item_id + 1 AND a.o = b.o LEFT JOIN m ON m.item_id = a.item_id AND m.o = a.o)
SELECT o::INT AS n, count(*) AS items, round(avg(m / c), 6) AS macro_p, round(avg(m / r), 6) AS macro_r, round(sum(m) / sum(c), 6) AS micro_p, round(sum(m) / sum(r), 6) AS micro_r FROM x GROUP BY o"""
)
def rouge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro and micro averages of n-gram overlap, orders 1 to 4."""
    return evaluation.rouge_averages(_neighbours(spark, sf_dir), "w", "other", (1, 2, 3, 4))


@_R.query(
    f"""WITH t AS (SELECT source, lang, unnest({_WORDS}) AS w FROM documents), a AS (SELECT unnest(['Top', 'Top/' || source, 'Top/' || source || '/' || lang]) AS category, w FROM t)
SELECT category, count(*) AS n, count(DISTINCT w) AS vocabulary FROM a GROUP BY category"""
)
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and different words of each category and all above it (X40): counted by leaf, then rolled up."""
    leaf = load(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("Top"), "source", "lang").alias("path"), F.explode(T.tokens("text")).alias("w")).groupBy("path", "w").agg(F.count("*").alias("n"))
    each = leaf.select(F.explode(T.category_ancestors("path")).alias("category"), "w", "n").groupBy("category", "w").agg(F.sum("n").alias("n"))
    return each.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("vocabulary"))


@_R.query(
    f"""WITH s AS (SELECT source AS target, w, count(*) AS n FROM (SELECT source, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL), p AS (SELECT target, w, n / sum(n) OVER (PARTITION BY target) AS p FROM s),
r AS (SELECT item_id, w, count(*) AS k FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL), z AS (SELECT item_id, sum(k) AS n FROM r GROUP BY ALL)
SELECT target, item_id, round(sum(k * ln(p)), 6) AS score FROM r JOIN p USING (w) JOIN z USING (item_id) GROUP BY target, item_id HAVING sum(k) = any_value(z.n)"""
)
def joint_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the probability of all their words in a target (R9); the sources are targets."""
    n = load(spark, sf_dir, "documents").select(F.col("source").alias("target"), F.explode(T.tokens("text")).alias("word")).groupBy("target", "word").agg(F.count("*").alias("n"))
    shares = n.join(n.groupBy("target").agg(F.sum("n").alias("t")), "target").withColumn("p", F.col("n") / F.col("t"))
    r = items(spark, sf_dir).select("item_id", F.explode("w").alias("word"))
    return retrieval.joint_probability(r, shares, "target", "item_id", "word").select("target", "item_id", F.round("score", 6).alias("score"))


# -- order, union and formats --------------------------------------------------------------------


@_R.query("SELECT row_number() OVER (ORDER BY event_type, user_id, event_id) AS ord, event_type, user_id, event_id FROM events")
def external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in byte order of their type, then by numbers, with their places (O1)."""
    return with_ordinal(load(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id", "event_id"]).select("ord", "event_type", "user_id", "event_id")


@_R.query("SELECT name, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT s_name FROM supplier) GROUP BY name")
def union_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams one after the other, repeats and all."""
    c, s = load(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return c.unionByName(s).unionByName(s).groupBy("name").agg(F.count("*").alias("n"))


@_R.query(f"SELECT word, row_number() OVER (ORDER BY length(word) DESC, word) AS place FROM (SELECT DISTINCT unnest({_WORDS}) AS word FROM benchmark)")
def vocabulary_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by falling length."""
    w = items(spark, sf_dir).select(F.explode("w").alias("word")).distinct()
    return with_ordinal(w, [F.length("word").desc(), F.asc("word")], "place").select("word", "place")


@_R.query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_comment FROM (SELECT n_nationkey, n_name, 'a \"quoted\" ' || n_name AS n_comment FROM nation)")
def header_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through a file whose first line names the columns."""
    n, path = load(spark, sf_dir, "nation"), _folder(spark, "header")
    rows = n.select("n_nationkey", "n_name", F.concat(F.lit('a "quoted" '), "n_name").alias("n_comment"))
    sinks.write_header_tsv(rows, path)
    return readers.tsv_with_header(spark, path)


@_R.query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || chr(10) || 'a \"b\", ' || p_brand AS v FROM part")
def quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with quotes, commas and line ends through a quoted file."""
    path = _folder(spark, "quoted")
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('\na "b", '), "p_brand").alias("v"))
    sinks.write_quoted_csv(p, path)
    return readers.csv_quoted(spark, path)


@_R.query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY ALL")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each key, read back."""
    path = _folder(spark, "split")
    sinks.write_split(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey"), path, ["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@_R.query("SELECT count(*) AS n, true AS small, sum(o_orderkey)::BIGINT AS keys FROM orders")
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files of at most a thousand lines."""
    path = _folder(spark, "batches")
    sinks.write_batches(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, 1000)
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    per = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.split("value", "\t")[0].cast("long")).alias("keys"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 1000).alias("small"), F.sum("keys").alias("keys"))


@_R.query(f"WITH v AS (SELECT w AS word, count(*) AS tf FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w) SELECT row_number() OVER (ORDER BY word)::INT AS id, word, tf, length(word)::DOUBLE AS letters FROM v")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary with vectors through its file."""
    path = _folder(spark, "vocabulary")
    v = items(spark, sf_dir).select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("tf"))
    v = with_ordinal(v, ["word"], "id").withColumn("semantic", F.create_map(F.lit("letters"), F.length("word").cast("double")))
    sinks.write_vocabulary(v, path)
    return readers.vocabulary(spark, path).select("id", "word", "tf", F.col("semantic")["letters"].alias("letters"))


@_R.query("SELECT 'u' || s_suppkey AS url, 'Top/' || s_nationkey AS category, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal::DOUBLE END AS balance FROM supplier WHERE s_suppkey % 3 <> 0")
def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category and its field files joined by url (S3, S4), some urls only."""
    s, base = load(spark, sf_dir, "supplier").withColumn("url", F.concat(F.lit("u"), "s_suppkey")), _folder(spark, "category")
    sinks.write_tsv(s.select("url", F.concat(F.lit("Top/"), "s_nationkey")), base)
    sinks.write_tsv(s.select("url", "s_name"), f"{base}.title")
    sinks.write_tsv(s.filter("s_suppkey % 2 = 0").select("url", F.to_json(F.struct(F.col("s_acctbal").cast("double").alias("v")))), f"{base}.balance")
    x = readers.category_table(spark, base, ["title", "balance"], s.filter("s_suppkey % 3 <> 0"), {"balance": "v double"})
    return x.select("url", "category", "title", F.col("balance.v").alias("balance"))


@_R.query("SELECT string_agg(line, '|' ORDER BY line) AS lines FROM (SELECT r_regionkey || ' & ' || r_name || ' \\\\' AS line FROM region)")
def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table body."""
    path = _folder(spark, "latex")
    sinks.write_latex(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return spark.read.text(path).agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("lines"))


# -- small functions -----------------------------------------------------------------------------


@_R.query(
    r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\s[:punct:]]+|[[:punct:]]')) AS t FROM benchmark)
SELECT t AS token, regexp_matches(t, '^[[:punct:]]+$') AS punctuation, length(t) > 1 AND NOT regexp_matches(t, '^[[:punct:]]+$') AS valid, count(*) AS n FROM t GROUP BY ALL"""
)
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation and validity of tokens."""
    t = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens_keep_punct("text", lower=False)).alias("token"))
    return t.groupBy("token", T.is_punctuation("token").alias("punctuation"), T.is_valid_token("token").alias("valid")).agg(F.count("*").alias("n"))


@_R.query(
    f"""WITH {_ITEMS}, t AS (SELECT item_id, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL), p AS (SELECT a.item_id, a.x, a.n * coalesce(b.n, 0) AS v, a.n FROM t a LEFT JOIN t b ON b.item_id = a.item_id + 1 AND b.x = a.x)
SELECT item_id, sum(v) AS projected, count(*) FILTER (n > 1) AS frequent, count(*) AS ones FROM p WHERE item_id < (SELECT max(item_id) FROM i) GROUP BY item_id"""
)
def vector_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors projected onto others, filtered by count, and binary."""
    v = _neighbours(spark, sf_dir).select("item_id", V.from_tokens("w").alias("a"), V.from_tokens("other").alias("b"), V.from_tokens("w", binary=True).alias("o"))
    return v.select("item_id", V.total(V.project("b", "a")).alias("projected"), V.dimensions(V.count_filter("a", 1.0)).cast("long").alias("frequent"), V.total("o").cast("long").alias("ones"))


@_R.query(
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned, md5(replace(html, '’', '''')) AS straight, md5(regexp_replace(html, '[\t\r\n]', ' ', 'g')) AS flat FROM pages"""
)
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters, apostrophes and field breaks taken out."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.clean("html")).alias("cleaned"), F.md5(T.normalize_apostrophe("html")).alias("straight"), F.md5(T.flatten_field("html")).alias("flat"))


@_R.query("SELECT item_id FROM benchmark ORDER BY md5('5/' || item_id) LIMIT 1000000")
def shuffled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in a random order that any partitioning gives."""
    return splits.shuffled(load(spark, sf_dir, "benchmark").select("item_id"), 5)
