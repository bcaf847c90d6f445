"""Corpus statistics in long form: weights, contingency, vector pairs, language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import vectors as V
from glossa.operators.blocks import BLOCK, told
from glossa.operators.vector_index import exhaustive


def tfidf(tokens: DataFrame, doc: str, word: str) -> DataFrame:
    """doc, word, tf, df, weight = tf ln(N / df), and the block, of tokens that are dealt by document.

    Words are counted in their blocks. A word's document frequency is summed
    over its blocks and goes back to them.
    """
    tf = tokens.groupBy(BLOCK, doc, word).agg(F.count("*").alias("tf"))
    own = tf.groupBy(BLOCK, word).agg(F.count("*").alias("_df"))
    df = own.select(BLOCK, word, F.sum("_df").over(W.partitionBy(word)).alias("df"))
    n = tokens.groupBy(BLOCK, doc).agg(F.count("*")).agg(F.count(doc).alias("_n"))
    return told(tf, df, [word]).crossJoin(n).select(BLOCK, doc, word, "tf", "df", (F.col("tf") * F.log(F.col("_n") / F.col("df"))).alias("weight"))


def contingency(rows: DataFrame, doc: str, word: str, flag: str, least: int) -> DataFrame:
    """word and its 2 x 2 table against a flag of the documents: n11 (has the word, flagged), n10, n01, n00."""
    total = rows.select(doc, flag).distinct().agg(F.count("*").alias("_n"), F.count_if(F.col(flag)).alias("_f"))
    per = rows.groupBy(word).agg(F.count_if(F.col(flag)).alias("n11"), F.count("*").alias("_w")).filter(F.col("_w") >= least)
    t = per.crossJoin(total).withColumn("n10", F.col("_w") - F.col("n11")).withColumn("n01", F.col("_f") - F.col("n11"))
    return t.withColumn("n00", F.col("_n") - F.col("_w") - F.col("n01")).select(word, "n11", "n10", "n01", "n00")


def chi_square() -> Column:
    """N (ad - bc)^2 / product of the margins, null if a cell is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    x = (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))
    return F.when(a * b * c * d != 0, x)


def chi_square_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, by a rational approximation of erfc (7 digits)."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.5 * z)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly: Column = F.lit(terms[-1])
    for k in terms[-2::-1]:
        poly = F.lit(k) + t * poly
    return t * F.exp(-z * z + poly)


def cosine_pairs(vectors: DataFrame, item: str, term: str, weight: str, df: DataFrame | None = None) -> DataFrame:
    """a, b, cosine of pairs a < b that share a term (V5).

    The join is on the term, so its work is the sum of squared document
    frequencies; for large collections drop or threshold frequent terms first,
    or look for near-duplicates instead. With df (term, df) products are damped.
    """
    norm = vectors.groupBy(item).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_l"))
    v = vectors.select(item, term, F.col(weight).alias("_w"))
    a, b = v.select(F.col(item).alias("a"), term, F.col("_w").alias("_x")), v.select(F.col(item).alias("b"), term, F.col("_w").alias("_y"))
    both = a.join(b, term).filter("a < b")
    if df is not None:
        both = both.join(df.select(term, "df"), term).withColumn("_x", F.col("_x") / (F.col("df") * F.col("df")))
    dots = both.groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_d"))
    la, lb = norm.select(F.col(item).alias("a"), F.col("_l").alias("_la")), norm.select(F.col(item).alias("b"), F.col("_l").alias("_lb"))
    return dots.join(la, "a").join(lb, "b").select("a", "b", (F.col("_d") / (F.col("_la") * F.col("_lb"))).alias("cosine"))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q, key, cosine, rank: the k nearest other vectors of each query, a stated set, all of them compared in blocks."""
    return exhaustive(queries, vectors, key, vector, k)


def unigram_perplexity(tokens: DataFrame, doc: str, word: str) -> DataFrame:
    """exp of the mean negative log probability under add-one unigrams of all tokens, which are dealt by document."""
    k = tokens.groupBy(BLOCK, doc, word).agg(F.count("*").alias("_k"))
    own = k.groupBy(BLOCK, word).agg(F.sum("_k").alias("_k"))
    whole = W.partitionBy(word)
    u = own.select(BLOCK, word, F.sum("_k").over(whole).alias("_c"), (1 / F.count("*").over(whole)).alias("_one"), F.col("_k").alias("_own"))
    # the shares of a word's blocks add up to 1
    t = u.agg(F.sum("_own").alias("_n"), F.round(F.sum("_one")).alias("_v"))
    p = told(k, u.select(BLOCK, word, "_c"), [word]).crossJoin(t)
    log = F.log((F.col("_c") + 1) / (F.col("_n") + F.col("_v")))
    return p.groupBy(BLOCK, doc).agg(F.exp(-F.sum(F.col("_k") * log) / F.sum("_k")).alias("perplexity")).drop(BLOCK)


def backoff_model(tokens: DataFrame, doc: str, pos: str, word: str, weight: float = 0.4) -> DataFrame:
    """(previous, word, score) of bigrams; unseen ones take ``weight`` times the unigram share (K3)."""
    nxt = tokens.select(doc, (F.col(pos) - 1).alias(pos), F.col(word).alias("_next"))
    bi = tokens.join(nxt, [doc, pos]).groupBy(F.col(word).alias("previous"), F.col("_next").alias("word")).agg(F.count("*").alias("n"))
    uni = tokens.groupBy(word).agg(F.count("*").alias("_c"))
    first = bi.groupBy("previous").agg(F.sum("n").alias("_h"))
    seen = bi.join(first, "previous").select("previous", "word", (F.col("n") / F.col("_h")).alias("score"))
    total = uni.agg(F.sum("_c").alias("_t"))
    fall = uni.crossJoin(total).select(F.lit(None).cast("string").alias("previous"), F.col(word).alias("word"), (F.lit(weight) * F.col("_c") / F.col("_t")).alias("score"))
    return seen.unionByName(fall)
