"""Similarity within groups and between strings, divergence of distributions, adaptation by a hidden Markov model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import adapters, models, similarity
from glossa.plans.common import Registry, load
from glossa.plans.textual import items

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_WORDS = r"regexp_extract_all(lower(text), '[^\s[:punct:]]+')"
_FORM = r"trim(regexp_replace(regexp_replace(lower({}), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g'))"


@_R.query(
    f"""WITH t AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest({_WORDS}) AS w FROM conversations) GROUP BY ALL), z AS (SELECT conv_id, turn, sum(c) AS t FROM t GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn AS x, b.turn AS y, sum(least(a.c, b.c)) AS m FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn < b.turn GROUP BY ALL),
j AS (SELECT p.conv_id, sum(m / (a.t + b.t)) AS h, sum(m / (a.t + b.t - m)) AS j FROM p JOIN z a ON a.conv_id = p.conv_id AND a.turn = x JOIN z b ON b.conv_id = p.conv_id AND b.turn = y GROUP BY ALL)
SELECT conv_id, n, round(coalesce(h, 0) / (n * (n - 1) / 2), 6) AS jaccard_half, round(coalesce(j, 0) / (n * (n - 1) / 2), 6) AS jaccard FROM (SELECT conv_id, count(*) AS n FROM z GROUP BY ALL HAVING count(*) > 1) LEFT JOIN j USING (conv_id)"""
)
def mean_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard of all pairs of a conversation's turns."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.tokens("text")).alias("word"))
    x = similarity.mean_jaccard(t, "conv_id", "turn", "word")
    return x.select("conv_id", "n", F.round("jaccard_half", 6).alias("jaccard_half"), F.round("jaccard", 6).alias("jaccard"))


@_R.query(
    f"""WITH t AS (SELECT DISTINCT conv_id, turn, text FROM conversations), p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
u AS (SELECT conv_id, turn, x, y, 'a' AS k, unnest(string_split({_FORM.format("x")}, ' ')) AS w FROM p UNION ALL SELECT conv_id, turn, x, y, 'b', unnest(string_split({_FORM.format("y")}, ' ')) FROM p),
c AS (SELECT conv_id, turn, x, y, w, count(*) FILTER (k = 'a')::DOUBLE AS a, count(*) FILTER (k = 'b')::DOUBLE AS b FROM u WHERE w <> '' GROUP BY ALL),
s AS (SELECT conv_id, turn, x, y, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS s FROM c GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(s, 0), 6) AS cosine FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s.turn = p.turn AND s.x = p.x AND s.y = p.y"""
)
def turn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each turn's string and the next one's."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct()
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return similarity.cosine_of(t.join(after, ["conv_id", "turn"]), "text", "next").select("conv_id", "turn", F.round("cosine", 6).alias("cosine"))


@_R.query(
    f"""WITH t AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL), a AS (SELECT w, sum(n) AS a FROM t GROUP BY w),
x AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p, a / (SELECT sum(n) FROM t) AS q FROM t JOIN a USING (w))
SELECT source, round(sum(p * ln(p / q)), 6) AS divergence FROM x GROUP BY source"""
)
def category_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kullback-Leibler divergence of each source's words from the corpus."""
    t = load(spark, sf_dir, "documents").select("source", F.explode(T.tokens("text")).alias("word"))
    return similarity.divergence(t, "source", "word").select("source", F.round("divergence", 6).alias("divergence"))


@_R.query()
def markov_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference adapted to the next by the best path through the corpus's translations and word pairs (M7)."""
    i = items(spark, sf_dir)
    pairs = i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other")), "item_id")
    model = models.translation_model(pairs, "item_id", "w", "other", 3).filter("source <> ''")
    out = adapters.hidden_markov(pairs, "item_id", "w", "other", model, i, "w")
    return out.select("item_id", F.array_join("adapted", " ").alias("adapted"), F.round("score", 3).alias("score"))
