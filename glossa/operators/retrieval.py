"""Retrieval, ranking and support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators.joins import with_ordinal
from glossa.operators.splits import top_per_group


def boosted_query(query: DataFrame, postings: DataFrame, q: str, term: str, boost: str, doc: str, rows: int = 20) -> DataFrame:
    """q, doc, score, rank: documents by the sum of the boosts of their matching terms.

    postings has distinct (doc, term); scores are summed on the map side before
    the shuffle, and each task keeps its best rows of a query.
    """
    scored = query.select(q, term, boost).join(postings.select(doc, term), term).groupBy(q, doc).agg(F.sum(boost).alias("score"))
    return top_per_group(scored.withColumn("score", F.round("score", 6)), [q], [F.desc("score"), F.asc(doc)], rows)


def url_signature(terms: DataFrame, page: str, term: str, host: str, df: DataFrame, n_docs: Column, boosts: DataFrame | None = None, top: int = 20) -> DataFrame:
    """page, term, weight, rank: signature terms of pages.

    Terms that are met at least twice, of three letters or more, no numbers and
    not in the host; the coordinate is n - rank, times 1 + boost, over 1 + df/N.
    terms: (page, host, term, n) counts; exactly ``top`` at most.
    """
    c = terms.withColumnRenamed("n", "_c").filter((F.col("_c") >= 2) & (F.length(term) >= 3) & ~T.is_numeric(term) & ~F.contains(F.col(host), F.col(term)))
    w = W.partitionBy(page)
    ranked = c.withColumn("_coord", F.count("*").over(w) - F.row_number().over(w.orderBy(F.desc("_c"), F.asc(term))))
    x = ranked.join(df.select(term, "df"), term, "left")
    boost = F.lit(0.0)
    if boosts is not None:
        x = x.join(boosts.select(term, F.col("boost").alias("_b")), term, "left")
        boost = F.coalesce("_b", F.lit(0.0))
    x = x.withColumn("weight", F.round(F.col("_coord") * (1 + boost) / (1 + F.coalesce("df", F.lit(0)) / n_docs), 6))
    return top_per_group(x.select(page, term, "weight"), [page], [F.desc("weight"), F.asc(term)], top)


def support(reference_tokens: DataFrame, target_tokens: DataFrame, pairs: DataFrame, ref: str, target: str, token: str) -> DataFrame:
    """target, ref, supported, total, score: share of a reference's tokens that the target has (R6, P13); pairs says what to score."""
    have = target_tokens.select(target, token).distinct().withColumn("_hit", F.lit(1))
    each = pairs.join(reference_tokens.select(ref, token), ref).join(have, [target, token], "left")
    out = each.groupBy(target, ref).agg(F.count("_hit").alias("supported"), F.count("*").alias("total"))
    return out.withColumn("score", F.col("supported") / F.col("total"))


def signature_support(signature: DataFrame, reference_tokens: DataFrame, pairs: DataFrame, ref: str, target: str, token: str) -> DataFrame:
    """Signature terms in a reference over its tokens that aren't any (R3); null without unsupported tokens."""
    s = support(reference_tokens, signature, pairs, ref, target, token)
    return s.select(target, ref, (F.col("supported") / F.nullif(F.col("total") - F.col("supported"), F.lit(0))).alias("score"))


def field_ranker(targets: DataFrame, references: DataFrame, target: str, ref: str, term: str, weight: str) -> DataFrame:
    """target, ref, score: positive cosines of long-form vectors (R5); both directions score the same."""

    def at_one(df: DataFrame, key: str) -> DataFrame:
        n = df.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_l"))
        return df.join(n, key).select(key, term, (F.col(weight) / F.col("_l")).alias(f"_{key}"))

    both = at_one(targets, target).join(at_one(references, ref), term)
    return both.groupBy(target, ref).agg(F.sum(F.col(f"_{target}") * F.col(f"_{ref}")).alias("score")).filter("score > 0")


def object_object(target_similarity: DataFrame, pair_similarity: DataFrame, target: str) -> DataFrame:
    """target, i, score: sum over j of sim(target, j) times sim(i, j), j other than i."""
    s = target_similarity.select(target, F.col("i").alias("j"), F.col("score").alias("_s"))
    return s.join(pair_similarity.filter("i <> j"), "j").groupBy(target, "i").agg(F.sum(F.col("_s") * F.col("score")).alias("score"))


def weighted_relevance(summary_tokens: DataFrame, weights: DataFrame, ref: str, token: str) -> DataFrame:
    """ref, score: sum of weight * tf over the set's document frequency."""
    df = summary_tokens.select(ref, token).distinct().groupBy(token).agg(F.count("*").alias("_df"))
    tf = summary_tokens.groupBy(ref, token).agg(F.count("*").alias("_tf"))
    return tf.join(weights.select(token, "weight"), token).join(df, token).groupBy(ref).agg(F.sum(F.col("weight") * F.col("_tf") / F.col("_df")).alias("score"))


def rank_fusion(rankings: list[DataFrame], item: str, score: str) -> DataFrame:
    """item, fused, rank: ranks summed over rankers, ascending (R9, W4); an item that a ranker lacks has its n + 1."""
    ranked = []
    for k, r in enumerate(rankings):
        n = r.agg(F.count("*").alias(f"_n{k}"))
        ranked.append((with_ordinal(r.select(item, score), [F.desc(score), F.asc(item)], f"_r{k}").select(item, f"_r{k}"), n))
    out = reduce(lambda a, b: a.join(b, item, "full"), [r for r, _ in ranked])
    for _, n in ranked:
        out = out.crossJoin(n)  # one row each
    fused = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_r{k}"), F.col(f"_n{k}") + 1) for k in range(len(ranked))])
    return with_ordinal(out.select(item, fused.cast("long").alias("fused")), ["fused", item], "rank").select(item, "fused", "rank")


def neutral_ranks(references: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """References ranked as they come (R9's ranker that doesn't rank): an order that the caller states, no scores."""
    return with_ordinal(references, order, name)


def joint_probability(tokens: DataFrame, shares: DataFrame, target: str, ref: str, token: str) -> DataFrame:
    """target, ref, score: log of the product of the shares that a target gives to a reference's tokens.

    tokens: (ref, token); shares: (target, token, p). Tokens that a target has
    no share for leave the pair without a score.
    """
    need = tokens.groupBy(ref, token).agg(F.count("*").alias("_k"))
    size = tokens.groupBy(ref).agg(F.count("*").alias("_n"))
    found = need.join(shares.filter("p > 0").select(target, token, "p"), token).groupBy(target, ref).agg(F.sum("_k").alias("_have"), F.sum(F.col("_k") * F.log("p")).alias("score"))
    return found.join(size, ref).filter("_have = _n").select(target, ref, "score")


def exclude_self(ranked: DataFrame, target: str, ref: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """References without the target itself, and (target, rank_gold) of the self matches."""
    r = ranked.withColumn("_rank", F.row_number().over(W.partitionBy(target).orderBy(*order)))
    return r.filter(F.col(target) != F.col(ref)).drop("_rank"), r.filter(F.col(target) == F.col(ref)).select(target, F.col("_rank").alias("rank_gold"))


def neighborhood(neighbours: DataFrame, summary_tokens: DataFrame, target: str, ref: str, similarity: str, token: str) -> DataFrame:
    """target, token, prior, density: share of neighbours whose summary has the token, and the same weighted by similarity."""
    total = neighbours.groupBy(target).agg(F.count("*").alias("_n"), F.sum(similarity).alias("_s"))
    have = neighbours.join(summary_tokens.select(ref, token).distinct(), ref).groupBy(target, token).agg(F.count("*").alias("_k"), F.sum(similarity).alias("_w"))
    return have.join(total, target).select(target, token, (F.col("_k") / F.col("_n")).alias("prior"), (F.col("_w") / F.col("_s")).alias("density"))


def modality_support(segments: DataFrame, key: str, modality: str, segment: str, pattern: str) -> DataFrame:
    """key, modality, n: matches of a token pattern in the segments."""
    return segments.groupBy(key, modality).agg(F.sum(T.count_matches(segment, pattern)).cast("long").alias("n")).filter("n > 0")


def category_signature_match(terms: DataFrame, signatures: DataFrame, doc: str, term: str, category: str, top: int = 20, most: float = 0.25) -> DataFrame:
    """doc, category, score: the best category by TF-IDF of a document's first ``top`` terms.

    terms: (doc, term, tf); signatures: distinct (category, term). Terms of at
    least a ``most`` share of the categories are skipped.
    """
    n = signatures.agg(F.count_distinct(category).alias("_n"))
    df = signatures.groupBy(term).agg(F.count("*").alias("_df")).crossJoin(n).filter(F.col("_df") < most * F.col("_n"))
    q = top_per_group(terms, [doc], [F.desc("tf"), F.asc(term)], top, "_k")
    scored = q.join(df, term).withColumn("_w", F.col("tf") * F.log(F.col("_n") / F.col("_df"))).join(signatures.select(category, term), term)
    scored = scored.groupBy(doc, category).agg(F.round(F.sum("_w"), 6).alias("score"))
    return top_per_group(scored, [doc], [F.desc("score"), F.asc(category)], 1, "_k").drop("_k")


def topicality(sentence: Column, document: Column) -> Column:
    """Length of the sentence's projection of the document over the document's length (M2)."""
    n = V.norm(document)
    return F.when(n > 0, V.norm(V.project(document, V.scale(sentence, 1.0))) / n).otherwise(F.lit(0.0))


def two_rank(df: DataFrame, group: list[str], length: Column, distance: Column, item: str) -> DataFrame:
    """R1 * sqrt(R2), with R1 by falling length and R2 by rising distance, both from 0."""
    w = W.partitionBy(*group)
    r1, r2 = F.row_number().over(w.orderBy(length.desc(), F.asc(item))) - 1, F.row_number().over(w.orderBy(distance.asc(), F.asc(item))) - 1
    return df.withColumn("f", r1 * F.sqrt(r2))


def homogeneity(ranked: DataFrame, pair_similarity: DataFrame, target: str, item: str, rank: str) -> DataFrame:
    """target, rank, homogeneity: mean similarity of all pairs among the first ``rank`` items, from the second on.

    ranked has ranks from 1 on without gaps. pair_similarity is sparse: a pair
    that it lacks has similarity 0 and counts in the mean.
    """
    r = ranked.select(target, item, rank)
    a, b = r.select(target, F.col(item).alias("i"), F.col(rank).alias("_ri")), r.select(target, F.col(item).alias("j"), F.col(rank).alias("_rj"))
    pairs = pair_similarity.join(a, "i").join(b, [target, "j"]).filter("_ri <> _rj").select(target, F.greatest("_ri", "_rj").alias(rank), "score", F.least("_ri", "_rj").alias("_low")).dropDuplicates([target, rank, "_low"])
    per = pairs.groupBy(target, rank).agg(F.sum("score").alias("_s"))
    each = r.filter(F.col(rank) > 1).select(target, rank).join(per, [target, rank], "left").fillna(0.0, ["_s"])
    w = W.partitionBy(target).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    return each.select(target, rank, (2 * F.sum("_s").over(w) / (F.col(rank) * (F.col(rank) - 1))).alias("homogeneity"))


def iterative_query(query: DataFrame, postings: DataFrame, similarity: DataFrame, q: str, term: str, rank: str, doc: str, rows: int = 20) -> DataFrame:
    """q, n_terms, score, docs: the query's first terms whose results are nearest to it on average.

    Queries of n terms ask for their first n, n - 1, ..., 1 terms; of equal
    averages the fewest terms count. query has at most a few dozen ranked terms
    for each q; similarity has (q, doc, score), absent pairs count as 0.
    """
    most = query.groupBy(q).agg(F.max(rank).alias("_n"))
    hits = query.join(postings.select(doc, term), term).join(most, q).filter(F.col(doc) != F.col(q))
    per = hits.select(q, doc, F.explode(F.sequence(F.col(rank), F.col("_n"))).alias("n_terms")).groupBy(q, "n_terms", doc).agg(F.count("*").alias("_k"))
    best = top_per_group(per, [q, "n_terms"], [F.desc("_k"), F.asc(doc)], rows, "_r").join(similarity.select(q, doc, "score"), [q, doc], "left")
    clusters = best.groupBy(q, "n_terms").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"), F.sort_array(F.collect_list(doc)).alias("docs"))
    return top_per_group(clusters, [q], [F.desc("score"), F.asc("n_terms")], 1, "_r").drop("_r")


def main_category(ranked: DataFrame, categories: DataFrame, q: str, doc: str, category: str) -> DataFrame:
    """References of the category that most of a target's references have, the first by name among equals."""
    r = ranked.join(categories.select(doc, category), doc)
    n = r.groupBy(q, category).agg(F.count("*").alias("_n"))
    top = top_per_group(n, [q], [F.desc("_n"), F.asc(category)], 1, "_k").select(q, category)
    return r.join(top, [q, category])
