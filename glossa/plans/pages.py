"""Page, retrieval, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import counts, evaluation, retrieval, similarity, splits
from glossa.plans.common import Registry, load
from glossa.plans.textual import items

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_TITLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
_WORDS = r"regexp_extract_all(lower({}), '[^\s[:punct:]]+')"
_PAGE_TOKENS = f"pt AS (SELECT page_id, {_HOST} AS host, unnest({_WORDS.format(_TEXT)} || {_WORDS.format(_TITLE)}) AS w FROM pages)"


def page_tokens(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """page_id, host, word of every word of the visible text and the title; ``dealt``: with all of a page in one task that Spark knows of."""
    both = F.concat(T.tokens(T.html_text("html")), T.tokens(T.html_title("html")))
    p = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (p.repartition("page_id") if dealt else p).select("page_id", T.url_host("url").alias("host"), F.explode(both).alias("word"))


@_R.query(f"SELECT page_id, length({_TEXT})::BIGINT AS n, md5({_TEXT}) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages."""
    return load(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


_SIGNATURE = f"""{_PAGE_TOKENS}, n AS (SELECT count(*) AS n FROM pages), df AS (SELECT w, count(DISTINCT page_id) AS df FROM pt GROUP BY w),
c AS (SELECT page_id, host, w, count(*) AS c FROM pt GROUP BY ALL HAVING count(*) >= 2 AND length(w) >= 3 AND NOT regexp_matches(w, '^[+-]?[0-9]+([.,][0-9]+)*$') AND NOT contains(host, w)),
r AS (SELECT page_id, w, count(*) OVER (PARTITION BY page_id) - row_number() OVER (PARTITION BY page_id ORDER BY c DESC, w) AS coord FROM c),
x AS (SELECT page_id, w AS word, round(coord / (1 + df / n), 6) AS weight FROM r JOIN df USING (w), n),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, word)::INT AS rank FROM x) WHERE rank <= 20)"""


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_tokens(spark, sf_dir).groupBy("page_id", "host", "word").agg(F.count("*").alias("n"))
    # pages are parsed once: that filter keeps the counts, so that both uses share the shuffle
    df = t.filter("n > 0").groupBy("word").agg(F.count_distinct("page_id").alias("df"))
    n = load(spark, sf_dir, "pages").agg(F.count("*").alias("n_pages"))
    x = retrieval.url_signature(t, "page_id", "word", "host", df.crossJoin(n).select("word", (F.col("df") / F.col("n_pages")).alias("df")), F.lit(1.0))
    return x.select("page_id", "word", "weight", "rank")


@_R.query(f"WITH {_SIGNATURE} SELECT page_id, word, weight, rank FROM sig")
def url_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature(spark, sf_dir)


@_R.query(
    f"""WITH {_SIGNATURE}, b AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS word FROM benchmark),
s AS (SELECT page_id, item_id, round(sum(weight), 6) AS score FROM sig JOIN b USING (word) GROUP BY ALL)
SELECT page_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_id)::INT AS rank FROM s) WHERE rank <= 20"""
)
def boosted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's signature as a boosted query against the reference summaries."""
    posts = items(spark, sf_dir).select("item_id", F.explode("w").alias("word")).distinct()
    return retrieval.boosted_query(signature(spark, sf_dir).select("page_id", "word", "weight"), posts, "page_id", "word", "weight", "item_id")


@_R.query(
    f"""WITH {_SIGNATURE}, l AS (SELECT page_id, sqrt(sum(weight * weight)) AS l FROM sig GROUP BY ALL),
bc AS (SELECT item_id, word, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS word FROM benchmark) GROUP BY ALL), m AS (SELECT item_id, sqrt(sum(n * n)) AS m FROM bc GROUP BY ALL),
s AS (SELECT page_id, item_id, round(sum(weight * n) / (any_value(l) * any_value(m)), 5) AS score FROM sig JOIN bc USING (word) JOIN l USING (page_id) JOIN m USING (item_id) WHERE l > 0 GROUP BY ALL HAVING sum(weight * n) > 0)
SELECT page_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10"""
)
def field_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the cosine with the page's signature."""
    target = signature(spark, sf_dir).select("page_id", "word", F.col("weight").alias("w")).filter("w > 0")
    refs = items(spark, sf_dir).select("item_id", F.explode("w").alias("word")).groupBy("item_id", "word").agg(F.count("*").cast("double").alias("w"))
    scored = retrieval.field_ranker(target, refs, "page_id", "item_id", "word", "w").withColumn("score", F.round("score", 5))
    return splits.top_per_group(scored, ["page_id"], [F.desc("score"), F.asc("item_id")], 10)


@_R.query(
    """WITH a AS (SELECT item_id, row_number() OVER (ORDER BY length(text) DESC, item_id) AS r FROM benchmark),
b AS (SELECT item_id, row_number() OVER (ORDER BY md5(text) DESC, item_id) AS r FROM benchmark WHERE item_id % 2 = 0)
SELECT item_id, fused, row_number() OVER (ORDER BY fused, item_id)::INT AS rank FROM (
SELECT a.item_id, a.r + coalesce(b.r, (SELECT count(*) FROM b) + 1) AS fused FROM a LEFT JOIN b USING (item_id))"""
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings fused; what the second lacks has its last rank and one."""
    b = load(spark, sf_dir, "benchmark")
    one, two = b.select("item_id", F.length("text").alias("s")), b.filter("item_id % 2 = 0").select("item_id", F.md5("text").alias("s"))
    return retrieval.rank_fusion([one, two], "item_id", "s")


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark), c AS (SELECT item_id, x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM i) GROUP BY ALL),
l AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM c GROUP BY ALL),
s AS (SELECT a.item_id AS t, b.item_id AS r, round(sum(a.n * b.n) / (any_value(la.l) * any_value(lb.l)), 6) AS score FROM c a JOIN c b USING (x) JOIN l la ON la.item_id = a.item_id JOIN l lb ON lb.item_id = b.item_id GROUP BY ALL)
SELECT t, rank_gold FROM (SELECT t, r, row_number() OVER (PARTITION BY t ORDER BY score DESC, r)::INT AS rank_gold FROM s) WHERE t = r"""
)
def rank_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each target among its own references."""
    c = items(spark, sf_dir).select(F.col("item_id").alias("t"), F.explode("w").alias("word")).groupBy("t", "word").agg(F.count("*").cast("double").alias("w"))
    s = retrieval.field_ranker(c, c.withColumnRenamed("t", "r"), "t", "r", "word", "w").withColumn("score", F.round("score", 6))
    return retrieval.exclude_self(s, "t", "r", [F.desc("score"), F.asc("r")])[1]


@_R.query(
    f"""WITH {_PAGE_TOKENS}, h AS (SELECT DISTINCT page_id, w FROM pt), r AS (SELECT item_id, unnest({_WORDS.format("text")}) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS c FROM r GROUP BY ALL), z AS (SELECT item_id, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT page_id, item_id, round(sum(c / n), 6) AS score FROM h JOIN c USING (w) JOIN z USING (item_id) GROUP BY ALL)
SELECT page_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10"""
)
def support_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten references of which a page has the greatest share of words (R6, P13), among all references."""
    refs = items(spark, sf_dir).select("item_id", F.explode("w").alias("word"))
    return similarity.supported_references(page_tokens(spark, sf_dir, True), refs, "page_id", "item_id", "word")


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark), n AS (SELECT a.item_id AS t, b.item_id AS r, 1 / (b.item_id - a.item_id) AS s FROM i a JOIN i b ON b.item_id BETWEEN a.item_id + 1 AND a.item_id + 3),
h AS (SELECT DISTINCT item_id AS r, unnest(w) AS word FROM i), q AS (SELECT t, count(*) AS n, sum(s) AS s FROM n GROUP BY t)
SELECT t, word, round(count(*) / any_value(q.n), 6) AS prior, round(sum(n.s) / any_value(q.s), 6) AS density FROM n JOIN h USING (r) JOIN q USING (t) GROUP BY ALL"""
)
def neighborhood_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior and density of words among the next three items."""
    i = items(spark, sf_dir)
    steps = i.select(F.col("item_id").alias("t"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("k"))
    near = steps.select("t", (F.col("t") + F.col("k")).alias("r"), (1 / F.col("k")).alias("s")).join(i.select(F.col("item_id").alias("r")), "r", "left_semi")
    x = retrieval.neighborhood(near, i.select(F.col("item_id").alias("r"), F.explode("w").alias("word")), "t", "r", "s", "word")
    return x.select("t", "word", F.round("prior", 6).alias("prior"), F.round("density", 6).alias("density"))


@_R.query(
    f"""WITH s AS (SELECT source || '/' || lang AS category, unnest({_WORDS.format("text")}) AS w FROM documents), g AS (SELECT DISTINCT category, w FROM s),
n AS (SELECT count(DISTINCT category) AS n FROM g), f AS (SELECT w, count(*) AS df FROM g GROUP BY w HAVING count(*) < 0.25 * (SELECT n FROM n)),
tf AS (SELECT item_id, w, count(*) AS tf FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS w FROM benchmark) GROUP BY ALL),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, w) AS k FROM tf) WHERE k <= 20),
x AS (SELECT item_id, category, round(sum(tf * ln(n / df)), 6) AS score FROM q JOIN f USING (w) JOIN g USING (w), n GROUP BY ALL)
SELECT item_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, category) AS k FROM x) WHERE k = 1"""
)
def category_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best category of each item by its terms."""
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("category"), F.explode(T.tokens("text")).alias("word")).distinct()
    tf = items(spark, sf_dir).select("item_id", F.explode("w").alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("tf"))
    return retrieval.category_signature_match(tf, d, "item_id", "word", "category")


@_R.query(
    f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark), s AS (SELECT unnest([1, 2, 3, 4]) AS o),
g AS (SELECT item_id, o, array_to_string(w[k:k + o - 1], ' ') AS g FROM (SELECT item_id, w, o, unnest(range(1, len(w) - o + 2)) AS k FROM i, s)),
c AS (SELECT item_id, o, g, count(*)::DOUBLE AS n FROM g GROUP BY ALL), t AS (SELECT item_id, o, sum(n) AS t FROM c GROUP BY ALL),
m AS (SELECT a.item_id, a.o, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.o = b.o AND a.g = b.g AND b.item_id = a.item_id + 1 GROUP BY ALL),
x AS (SELECT a.item_id, a.o, coalesce(m, 0) / a.t AS p, coalesce(m, 0) / b.t AS r FROM t a JOIN t b ON b.item_id = a.item_id + 1 AND a.o = b.o LEFT JOIN m ON m.item_id = a.item_id AND m.o = a.o),
f AS (SELECT item_id, o, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM x)
SELECT item_id, """ + ", ".join(f"max({m}) FILTER (o = {k}) AS rouge_{k}_{m}" for k in (1, 2, 3, 4) for m in "prf") + " FROM f GROUP BY item_id"
)
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a candidate for the next."""
    i = items(spark, sf_dir)
    nxt = i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("ref"))
    return i.join(nxt, "item_id").select("item_id", *[x for n in (1, 2, 3, 4) for x in evaluation.rouge_n(F.col("w"), F.col("ref"), n)])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (url, system, metric, value) made of part prices by supplier."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("url"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("system"), F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"))).alias("metric", "value"))


_SCORES = "s AS (SELECT l_partkey AS url, 's' || (l_suppkey % 3) AS system, l_quantity AS quantity, l_discount AS discount FROM lineitem)"


@_R.query(f"WITH {_SCORES} SELECT url, " + ", ".join(f"round(coalesce(avg({m}) FILTER (system = 's{k}'), 0), 6) AS s{k}_{m}" for k in range(3) for m in ("quantity", "discount")) + " FROM s GROUP BY url")
def eval_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluation.pivot_metrics(_scores(spark, sf_dir), "url", "system", "metric", "value", ["s0", "s1", "s2"], ["quantity", "discount"])
    return x.select("url", *[F.round(c, 6).alias(c) for c in x.columns if c != "url"])


@_R.query(f"WITH {_SCORES} SELECT system, round(avg(quantity), 4) AS quantity, round(avg(discount), 4) AS discount FROM s GROUP BY system")
def system_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.system_table(_scores(spark, sf_dir), "system", "metric", "value", ["quantity", "discount"])


@_R.query("SELECT i, count(*) AS n, round(avg(l_discount), 5) AS l_discount, round(avg(l_tax), 5) AS l_tax FROM (SELECT unnest(range(0, 51)) AS i) JOIN lineitem ON l_quantity >= i GROUP BY i")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluation.threshold_sweep(load(spark, sf_dir, "lineitem"), "l_quantity", ["l_discount", "l_tax"], 50)
    return x.select("i", "n", F.round("l_discount", 5).alias("l_discount"), F.round("l_tax", 5).alias("l_tax"))


_LABELS = ("very_poor", "poor", "acceptable", "good", "very_good")


@_R.query(
    """WITH r AS (SELECT l_returnflag AS system, 'accuracy' AS q, nullif(l_linenumber, 7) AS n, l_discount AS c FROM lineitem UNION ALL SELECT l_returnflag, 'informativeness', l_quantity, l_tax FROM lineitem)
SELECT system, q AS question, round(avg(n::INT % 5 + 1), 6) AS mean, round(avg(c::DOUBLE), 6) AS agreement, count(n) AS n FROM r GROUP BY ALL"""
)
def crowd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratings (A28), with labels made from the line items' numbers; a seventh line has none."""
    label = lambda c: F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (c.cast("int") % 5 + 1))
    r = load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("system"), F.when(F.col("l_linenumber") != 7, label(F.col("l_linenumber"))).alias("accuracy"), F.col("l_discount").cast("string").alias("accuracy:confidence"),
        label(F.col("l_quantity")).alias("informativeness"), F.col("l_tax").cast("string").alias("informativeness:confidence"),
    )
    return evaluation.crowd_means(r, "system", ["accuracy", "informativeness"])


@_R.query(
    """WITH v AS (SELECT l_returnflag AS system_1, l_linestatus AS system_2, 1 - l_partkey::INT % 3 AS v FROM lineitem)
SELECT system_1, system_2, round(avg(v), 6) AS preference, round(avg((v + 1) / 2), 6) AS first_share, round(avg((1 - v) / 2), 6) AS second_share, count(*) AS n FROM v GROUP BY ALL"""
)
def pair_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of pairs of systems (A29), with judgements made from the line items' parts."""
    said = F.element_at(F.array(F.lit("first"), F.lit("neither"), F.lit("second")), (F.col("l_partkey").cast("int") % 3 + 1))
    j = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("system_1"), F.col("l_linestatus").alias("system_2"), said.alias("judgement"))
    return evaluation.pair_preference(j, "system_1", "system_2", "judgement")


@_R.query(f"WITH s AS (SELECT page_id, {_TITLE} AS title FROM pages) SELECT page_id, title AS summary FROM s WHERE title <> ''")
def title_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title as the summary (M1)."""
    return load(spark, sf_dir, "pages").select("page_id", T.html_title("html").alias("summary")).filter("summary <> ''")


@_R.query(
    f"""WITH {_PAGE_TOKENS}, f AS (SELECT 'w:' || w AS f, page_id FROM pt), k AS (SELECT f, row_number() OVER (ORDER BY f) AS id FROM (SELECT f FROM (SELECT DISTINCT f, page_id FROM f) GROUP BY f HAVING count(*) >= 50)),
c AS (SELECT page_id, f, count(*) AS v FROM f GROUP BY ALL)
SELECT page_id, string_agg(id || ':' || v, ' ' ORDER BY id) AS features FROM c JOIN k USING (f) GROUP BY page_id"""
)
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as id:value rows."""
    f = page_tokens(spark, sf_dir).groupBy("page_id", F.concat(F.lit("w:"), "word").alias("f")).agg(F.count("*").alias("v"))
    return counts.feature_rows(f, "page_id", "f", "v", 50)


@_R.query(
    f"""WITH t AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM t)
SELECT doc_id, w AS word, round(min((p - 1) / n), 6) AS relative_position, count(*) AS n FROM f WHERE length(w) > 1 GROUP BY ALL HAVING count(*) >= 10"""
)
def relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where frequent words first stand in their documents."""
    # dealt as texts: the rows of words are many times as much
    d = load(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", T.tokens("text").alias("w"))
    f = d.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word")).filter(T.is_valid_token("word"))
    return f.groupBy("doc_id", "word").agg(F.round(F.min(F.col("p") / F.col("n")), 6).alias("relative_position"), F.count("*").alias("n")).filter("n >= 10").select("doc_id", "word", "relative_position", "n")


@_R.query(
    f"""WITH {_PAGE_TOKENS}, b AS (SELECT host, w, count(*) AS n FROM pt GROUP BY ALL) SELECT host, w AS word, n FROM b WHERE n >= 20"""
)
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged token counts of all modalities by host."""
    return page_tokens(spark, sf_dir).groupBy("host", "word").agg(F.count("*").alias("n")).filter("n >= 20")

