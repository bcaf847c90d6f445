"""Queries of the smaller operators, over the tables or over literal records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators import clustering, containment, evaluation, filters, joins, retrieval, secondary, splits, stats, summarize
from glossa.plans.common import Registry, load
from glossa.plans.pages import page_tokens
from glossa.plans.textual import items

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_WORDS = r"regexp_extract_all(lower(text), '[^\s[:punct:]]+')"


@_R.query(
    f"""SELECT item_id, array_to_string(list_transform(list_filter(w, lambda x: length(x) > 1), lambda x: CASE WHEN length(x) % 2 = 0 THEN x || ' ,' ELSE x END), ' ') AS kept
FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)"""
)
def tagged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with tags (P7, X16): a comma that is its own tag stays, a semicolon tagged as a word and a bare letter go."""
    tagged = F.transform("w", lambda x: F.when(F.length(x) == 1, x).when(F.length(x) % 2 == 0, F.concat(x, F.lit("/NN ,/,"))).otherwise(F.concat(x, F.lit("/VB ;/NN"))))
    kept = T.filter_tagged(F.array_join(tagged, " "))
    return items(spark, sf_dir).select("item_id", F.array_join(F.transform(kept, lambda x: F.regexp_extract(x, r"^(.+)/[^/]+$", 1)), " ").alias("kept"))


@_R.query(r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'))[1:20] AS v FROM benchmark")
def process_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column through steps named by a string."""
    return load(spark, sf_dir, "benchmark").select("item_id", filters.pipeline("lower/trim/prefix::20", F.col("text")).alias("v"))


@_R.query("SELECT doc_id, NULL::VARCHAR AS absent, lang FROM documents WHERE length(lang) > 0")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are absent are null."""
    return filters.required(filters.project(load(spark, sf_dir, "documents"), ["doc_id", "absent", "lang"]), ["lang"])


@_R.query(
    """WITH s AS (SELECT l_orderkey AS url, 's' || (l_suppkey % 2) AS system, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY ALL)
SELECT a.url, round(a.q, 4) AS a_q, round(b.q, 4) AS b_q FROM s a JOIN s b USING (url) WHERE a.system = 's0' AND b.system = 's1' AND a.q > b.q AND a.d < b.d"""
)
def compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urls on which one system beats the other."""
    s = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url"), F.concat(F.lit("s"), F.col("l_suppkey") % 2).alias("system")).agg(F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"))
    c = joins.compare_systems(s, "url", "system", "s0", "s1", ["q"], ["d"])
    return c.select("url", F.round("a_q", 4).alias("a_q"), F.round("b_q", 4).alias("b_q"))


@_R.query("SELECT a.s_name AS system_1, b.s_name AS system_2 FROM supplier a JOIN supplier b ON a.s_name < b.s_name AND (a.s_nationkey % 7 = b.s_nationkey % 7 OR a.s_nationkey % 7 = 0 OR b.s_nationkey % 7 = 0)")
def system_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a namespace and with the oracle."""
    s = load(spark, sf_dir, "supplier").select("s_name", F.when(F.col("s_nationkey") % 7 == 0, "oracle").otherwise((F.col("s_nationkey") % 7).cast("string")).alias("ns"))
    return joins.system_pairs(s, "s_name", "ns")


@_R.query("SELECT r_name, a, b FROM region, (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(['x', 'y']) AS b)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by every parameter combination (J12, J13, X11); the grid is stated, so its size is bounded."""
    return load(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(evaluation.parameter_grid(spark, {"a": [1, 2, 3], "b": ["x", "y"]})))


@_R.query(
    """WITH i AS (SELECT 'sys' || (p_partkey % 3) || '@size=' || p_size || ',brand=' || p_brand AS id, p_partkey FROM part)
SELECT p_partkey, regexp_extract(id, 'size=([^,]*)', 1) AS size, regexp_extract(id, 'brand=([^,]*)', 1) AS brand FROM i"""
)
def system_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in system ids as columns."""
    m = evaluation.parse_system_id(F.concat(F.lit("sys"), F.col("p_partkey") % 3, F.lit("@size="), "p_size", F.lit(",brand="), "p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["size"].alias("size"), F.col("m")["brand"].alias("brand"))


@_R.query(
    r"""WITH x AS (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(upper(p_name) || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE 'x' END), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM part)
SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS ratio FROM x"""
)
def title_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of outputs that are the title."""
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise("x")).alias("output"))
    return evaluation.replacement_ratio(p, "output", "title")


@_R.query(f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM benchmark), t AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) SELECT doc_id, w AS term, count(*) AS n FROM t JOIN w USING (w) GROUP BY ALL")
def find_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark in the documents."""
    v = items(spark, sf_dir).select(F.explode("w").alias("word"))
    d = load(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("words"))
    return containment.find_phrases(d, "doc_id", "words", v, "word").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@_R.query()
def url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL words cut by the page's own words."""
    d = page_tokens(spark, sf_dir).groupBy("page_id").agg(F.collect_set("word").alias("known"))
    p = load(spark, sf_dir, "pages").select("page_id", T.url_words("url").alias("words")).join(d, "page_id")
    return containment.segment_urls(p, "page_id", "words", "known")


@_R.query(r"WITH i AS (SELECT item_id, regexp_replace(" + _WORDS + r"[1], '[^\x00-\x7F]', 'x', 'g') AS w FROM benchmark) SELECT a.item_id, round(exp(-levenshtein(a.w, b.w)), 9) AS morphology, a.w AS x, b.w AS y FROM i a JOIN i b ON b.item_id = a.item_id + 1")
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(-edit distance) of first words (T36), in ASCII, as distances elsewhere may count bytes."""
    i = items(spark, sf_dir).select("item_id", F.regexp_replace(F.get("w", F.lit(0)), r"[^\x00-\x7F]", "x").alias("x"))
    j = i.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return i.join(j, "item_id").select("item_id", F.round(V.morphology(F.col("x"), F.col("y")), 9).alias("morphology"), "x", "y")


@_R.query(
    r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\s[:punct:]]+|[[:punct:]]')) AS t FROM benchmark)
SELECT CASE WHEN regexp_matches(t, '^[[:punct:]]+$') THEN 'punctuation' WHEN regexp_matches(t, '^[0-9]+$') THEN 'numeric-' || length(t) WHEN regexp_matches(t, '^[A-Z]+$') THEN 'allcaps'
 WHEN regexp_matches(t, '^[^A-Z]+$') THEN 'nocaps' WHEN regexp_matches(t, '^[A-Z][^A-Z]*$') THEN 'initcap' ELSE 'mixed' END AS shape, count(*) AS n FROM t GROUP BY ALL"""
)
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface markers."""
    t = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens_keep_punct("text", lower=False)).alias("t"))
    return t.groupBy(T.shape("t").alias("shape")).agg(F.count("*").alias("n"))


@_R.query(f"WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark) SELECT item_id, len(w)::INT + 1 AS n, w[1] AS first, array_to_string(w[len(w) - 1:], ' ') AS last FROM i WHERE len(w) >= 3")
def ngram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams with shorter prefixes and the tail."""
    g = items(spark, sf_dir).filter(F.size("w") >= 3).select("item_id", T.ngrams("w", 3, edges=True).alias("g"))
    return g.select("item_id", F.size("g").alias("n"), F.get("g", F.lit(0)).alias("first"), F.element_at("g", -1).alias("last"))


@_R.query(
    """WITH e AS (SELECT user_id AS entity, event_type AS category FROM events), s AS (SELECT DISTINCT category AS surface, entity FROM e)
SELECT surface, string_agg(entity::VARCHAR, ',' ORDER BY entity) AS entities FROM s GROUP BY surface"""
)
def surface_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces and their entities."""
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg(F.collect_list("event_type").alias("surfaces"))
    return secondary.surface_entities(e).select("surface", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"))


@_R.query("SELECT user_id AS resource, '[\"' || string_agg(event_type, '\",\"' ORDER BY event_type) || '\"]' AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def resource_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each resource as JSON."""
    return secondary.resource_types(load(spark, sf_dir, "events").select(F.col("user_id").alias("resource"), F.col("event_type").alias("type")))


@_R.query(
    """WITH t AS (SELECT user_id || ' ' || event_type || ' ' || event_id || ' x' AS v, user_id % 2 AS k FROM events)
SELECT user_id::VARCHAR AS subject, event_type AS predicate, event_id || ' x' AS object FROM events WHERE user_id % 2 = 0"""
)
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of wanted subjects."""
    e = load(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(" ", "user_id", "event_type", "event_id", F.lit("x")).alias("value")).unionByName(spark.range(1).select(F.lit("# a b").alias("value")))
    return secondary.triples(lines, e.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("s")))


@_R.query(r"WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\s[:punct:]]+')) AS w FROM benchmark) SELECT lower(w) AS lower, min(w) AS filler FROM t WHERE length(w) % 3 <> 0 GROUP BY ALL")
def slot_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that differ but for case, without those tagged as verbs."""
    t = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text", lower=False)).alias("filler"))
    tagged = t.withColumn("tag", F.when(F.length("filler") % 3 == 0, "VBD").otherwise("NN"))
    return secondary.slot_fillers(tagged, "filler", "tag").select(F.lower("filler").alias("lower"), "filler")


@_R.query("SELECT o_orderkey AS url, map_to_json FROM (SELECT o_orderkey, '{\"1\":' || o_custkey || '.0,\"2\":' || (o_orderkey % 7) || '.0}' AS map_to_json FROM orders)")
def merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature maps merged by index."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.to_json(F.create_map(F.lit("cust"), F.col("o_custkey").cast("double"), F.lit("mod"), F.lit(-1.0))).alias("m1"), F.to_json(F.create_map(F.lit("mod"), (F.col("o_orderkey") % 7).cast("double"), F.lit("unknown"), F.lit(1.0))).alias("m2"))
    d = spark.createDataFrame([("cust", 1), ("mod", 2)], "feature string, id int")
    return secondary.merge_features(o, ["m1", "m2"], d).select("url", F.to_json("features").alias("map_to_json"))


@_R.query(
    f"""WITH i AS (SELECT item_id, list_transform({_WORDS}, lambda x: CASE length(x) % 4 WHEN 0 THEN 'SLOT_ADJECTIVE' WHEN 1 THEN 'SLOT_ADVERB' ELSE x END) AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: NOT (starts_with(x, 'SLOT_') AND i > 1 AND starts_with(w[i - 1], 'SLOT_'))), ' ') AS s FROM i"""
)
def abstract_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverbs and adjectives as slots (X32), on words tagged by their length."""
    tag = lambda x: F.element_at(F.array(*[F.lit(t) for t in ("JJ", "RB", "NN", "VB")]), F.length(x) % 4 + 1)
    return items(spark, sf_dir).select("item_id", F.array_join(secondary.abstract_slots(F.col("w"), F.transform("w", tag)), " ").alias("s"))


@_R.query("SELECT s_suppkey, s_name || '|n' || s_nationkey AS owner FROM supplier")
def whois_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner lines of whois answers made from the suppliers."""
    before = [F.lit("No match for domain"), F.lit("Domain Status: ok"), F.lit("Updated Date: 2020-01-01")]
    after = [F.lit("Name Server: ns.example"), F.lit("DNSSEC: unsigned"), F.lit("For more information on Whois status codes, see"), F.lit("NOT FOUND")]
    lines = [*before, F.concat(F.lit("Organisation: "), "s_name"), F.concat(F.lit("name: "), F.upper("s_name")), F.lit(""), F.concat(F.lit("City:  n"), "s_nationkey"), *after]
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(secondary.whois_lines(F.concat_ws("\n", *lines)), "|").alias("owner"))


@_R.query("SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sets without one, for the suppliers of each nation."""
    return splits.leave_one_out(load(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "other")


@_R.query(
    f"""WITH t AS (SELECT item_id AS r, unnest({_WORDS}) AS w FROM benchmark), f AS (SELECT w, count(DISTINCT r) AS df FROM t GROUP BY w)
SELECT r, round(sum(length(w) / df), 6) AS score FROM t JOIN f USING (w) GROUP BY r"""
)
def weighted_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by weighted words (R8); a word weighs its letters."""
    t = items(spark, sf_dir).select(F.col("item_id").alias("r"), F.explode("w").alias("word"))
    w = t.select("word", F.length("word").cast("double").alias("weight")).distinct()
    return retrieval.weighted_relevance(t, w, "r", "word").select("r", F.round("score", 6).alias("score"))


@_R.query(
    f"""WITH t AS (SELECT item_id AS r, unnest({_WORDS}) AS w FROM benchmark), s AS (SELECT DISTINCT r, w FROM t),
x AS (SELECT p.target, p.r, count(s.w) AS k, count(*) AS n FROM (SELECT r AS target, unnest([r + 1, r + 2]) AS r FROM (SELECT DISTINCT r FROM t)) p JOIN t ON t.r = p.r LEFT JOIN s ON s.r = p.target AND s.w = t.w GROUP BY ALL)
SELECT target, r, round(k / nullif(n - k, 0), 6) AS score FROM x"""
)
def signature_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature terms over the rest (R3), of each item in the next two."""
    t = items(spark, sf_dir).select(F.col("item_id").alias("r"), F.explode("w").alias("word"))
    pairs = t.select(F.col("r").alias("target")).distinct().withColumn("r", F.explode(F.array(F.col("target") + 1, F.col("target") + 2)))
    return retrieval.signature_support(t.withColumnRenamed("r", "target"), t, pairs, "r", "target", "word").select("target", "r", F.round("score", 6).alias("score"))


@_R.query(
    """WITH s AS (SELECT s_suppkey AS i, 1.0 / (1 + s_suppkey) AS score FROM supplier), p AS (SELECT a.i, b.i AS j, 1.0 / (1 + abs(a.i - b.i)) AS score FROM s a JOIN s b ON abs(a.i - b.i) <= 10)
SELECT p.i, round(sum(s.score * p.score), 6) AS score FROM p JOIN s ON s.i = p.j WHERE p.i <> p.j GROUP BY p.i"""
)
def object_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are like others that are like the target (R7); alike are those at most ten numbers apart."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (1 / (1 + F.col("s_suppkey"))).alias("score"))
    p = _near(s.select("i"), 10)
    return retrieval.object_object(s.withColumn("target", F.lit("t")), p, "target").select("i", F.round("score", 6).alias("score"))


def _near(numbers: DataFrame, most: int) -> DataFrame:
    """i, j, score of numbers at most ``most`` apart, by an equi-join on the neighbours' numbers."""
    near = numbers.select("i", F.explode(F.sequence(F.col("i") - most, F.col("i") + most)).alias("j"))
    return near.join(numbers.select(F.col("i").alias("j")), "j").select("i", "j", (1 / (1 + F.abs(F.col("i") - F.col("j")))).alias("score"))


@_R.query(f"SELECT source AS key, 'content' AS modality, sum(len(regexp_extract_all(lower(text), '\\bthe\\b')))::BIGINT AS n FROM documents GROUP BY ALL HAVING sum(len(regexp_extract_all(lower(text), '\\bthe\\b'))) > 0")
def modality_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a token in the segments."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.lit("content").alias("modality"), F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("s"))
    return retrieval.modality_support(d, "key", "modality", "s", T.token_pattern("the"))


@_R.query(
    """WITH r AS (SELECT s_nationkey AS target, s_suppkey AS i, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier),
p AS (SELECT a.target, greatest(a.rank, b.rank) AS rank, CASE WHEN abs(a.i - b.i) <= 10 THEN 1.0 / (1 + abs(a.i - b.i)) ELSE 0 END AS s FROM r a JOIN r b ON a.target = b.target AND a.rank < b.rank), k AS (SELECT target, rank, sum(s) AS s, count(*) AS n FROM p GROUP BY target, rank)
SELECT target, rank, round(sum(s) OVER (PARTITION BY target ORDER BY rank) / sum(n) OVER (PARTITION BY target ORDER BY rank), 6) AS homogeneity FROM k"""
)
def homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of all pairs among the first ranks of each nation's suppliers (W7); those more than ten numbers apart are not alike at all."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("item"), "s_acctbal")
    r = splits.top_per_group(s, ["target"], [F.asc("s_acctbal"), F.asc("item")], 1 << 30).withColumn("rank", F.col("rank").cast("long")).drop("s_acctbal")
    return retrieval.homogeneity(r, _near(s.select(F.col("item").alias("i")), 10), "target", "item", "rank").select("target", "rank", F.round("homogeneity", 6).alias("homogeneity"))


@_R.query(
    f"""WITH t AS (SELECT source, unnest({_WORDS}) AS w FROM documents), p AS (SELECT source, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT source, w, n / sum(n) OVER (PARTITION BY source) AS p FROM p)
SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY source"""
)
def category_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each source's words (V25), in long form."""
    n = load(spark, sf_dir, "documents").select("source", F.explode(T.tokens("text")).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    t = n.groupBy("source").agg(F.sum("n").alias("t"))
    p = n.join(t, "source").withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


@_R.query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT DISTINCT (a.user_id % 3)::VARCHAR AS category, a.event_type AS a, b.event_type AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type),
n AS (SELECT category, b, list(a) AS near FROM p GROUP BY ALL), k AS (SELECT category, [a, b] AS c FROM p UNION ALL SELECT k.category, list_append(k.c, n.b) FROM k JOIN n ON n.category = k.category AND n.b > k.c[-1] AND list_has_all(n.near, k.c))
SELECT category, array_to_string(c, ' ') AS clique FROM k"""
)
def category_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of event types that users share pairwise."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    a, b = e.select("user_id", F.col("event_type").alias("a")), e.select("user_id", F.col("event_type").alias("b"))
    pairs = a.join(b, "user_id").filter("a < b").groupBy((F.col("user_id") % 3).cast("string").alias("category"), "a", "b").count()
    return clustering.cliques(pairs.select("category", "a", "b"))


@_R.query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('1/' || source || '/' || doc_id), source, doc_id) <= 5")
def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a source in a seeded order."""
    return secondary.value_samples(load(spark, sf_dir, "documents").select("source", "doc_id"), "source", 5, 1)


@_R.query(
    """WITH x AS (SELECT n_nationkey, n_nationkey / 4.0 AS x FROM nation),
s AS (SELECT n_nationkey, x, sqrt(x) / 400 AS h, unnest(range(0, 401)) AS i FROM x),
w AS (SELECT n_nationkey, h, CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * h) * (i * h) / 2) / sqrt(2 * pi()) AS y FROM s)
SELECT n_nationkey, round(1 - 2 * any_value(h) / 3 * sum(y), 5) AS p FROM w GROUP BY n_nationkey"""
)
def chi_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of chi-square (A15); the SQL integrates the normal density."""
    return load(spark, sf_dir, "nation").select("n_nationkey", F.round(stats.chi_square_p(F.col("n_nationkey") / 4), 5).alias("p"))


@_R.query(r"SELECT item_id, trim(regexp_replace(regexp_replace('(a) ' || text || ' [b]', '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM benchmark")
def strip_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries without bracketed spans."""
    return load(spark, sf_dir, "benchmark").select("item_id", T.strip_brackets(F.concat(F.lit("(a) "), "text", F.lit(" [b]"))).alias("s"))
