"""Pruned search of an inverted index (S16, S17, R1, R5): exact top results without the long postings of frequent terms.

Postings lie in layers of falling impact: those of a term whose weights have one
power of two, dealt into parts of a bounded size. A query's terms are gone
through from the rarest to the most frequent; a layer is read only if its best
weight, with the best weights of the terms after it, can still reach the query's
k-th best score, of which a few rare layers give a lower bound first. What is
found so is scored in full by its (term, document) pairs, which are never many
of one key. A frequent term is then looked up, but its postings aren't dealt out
to every query that has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators.blocks import BLOCK
from glossa.operators.splits import top_per_group
from glossa.sources.storage import shared_dir, written

#: Postings of a part, about.
PART = 4096
#: Postings of a layer that may serve for the lower bound, and of all such layers of a query.
SEED, SEEDS = 2000, 8000
#: Digits that scores are rounded to, and what rounding may add to a score.
DIGITS = 6


class ImpactIndex:
    """Postings (term, doc, weight > 0) by term, layer and part, on disk.

    (term, doc) pairs are distinct; rows with a null or without a positive
    weight are left out. Documents have one type that can be ordered.
    """

    def __init__(self, postings: DataFrame, term: str, doc: str, weight: str, part: int = PART):
        self.spark = postings.sparkSession
        self.root = f"{shared_dir(self.spark)}/impact-index-{uuid.uuid4().hex}"
        rows = postings.select(F.col(term).alias("term"), F.col(doc).alias("doc"), F.col(weight).cast("double").alias("weight")).filter("term is not null and doc is not null and weight > 0")
        rows = rows.withColumn("layer", F.floor(F.log2("weight")).cast("int"))
        self.layers = self.kept(rows.groupBy("term", "layer").agg(F.count("*").alias("n"), F.max("weight").alias("best")), "layers")
        self.terms = self.kept(self.layers.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("most")), "terms")
        parts = self.layers.select("term", "layer", F.ceil(F.col("n") / part).alias("parts"))
        dealt = rows.join(parts, ["term", "layer"]).withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
        self.postings = self.kept(dealt.select("term", "layer", "part", "doc", "weight"), "postings")
        self.parts = parts

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _query_terms(self, queries: DataFrame, name: str) -> DataFrame:
        """q, term, boost, df, place from the rarest on, rest: what the terms after it may add at most."""
        q = queries.groupBy("q", "term").agg(F.sum("boost").alias("boost")).filter("boost > 0").join(self.terms, "term")
        order = W.partitionBy("q").orderBy("df", "term")  # a query has at most a few dozen terms
        after = order.rowsBetween(1, W.unboundedFollowing)
        return self.kept(q.withColumn("place", F.row_number().over(order)).withColumn("rest", F.coalesce(F.sum(F.col("boost") * F.col("most")).over(after), F.lit(0.0))), f"{name}-terms")

    def _candidates(self, layers: DataFrame) -> DataFrame:
        """Distinct (q, doc) of the layers (q, term, layer), through their parts."""
        parts = layers.join(self.parts, ["term", "layer"]).select("q", "term", "layer", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
        return parts.join(self.postings, ["term", "layer", "part"]).select("q", "doc").distinct()

    def _scores(self, candidates: DataFrame, terms: DataFrame) -> DataFrame:
        """q, doc, score of candidates, over all terms of their queries."""
        asked = candidates.join(terms.select("q", "term", "boost"), "q")
        found = asked.join(self.postings.select("term", "doc", "weight"), ["term", "doc"])
        return found.groupBy("q", "doc").agg(F.round(F.sum(F.col("boost") * F.col("weight")), DIGITS).alias("score"))

    def needed(self, terms: DataFrame, rows: int, name: str) -> DataFrame:
        """The layers (q, term, layer, n, needed) of all queries, those marked that must be read."""
        layers = self.kept(terms.join(self.layers, "term").withColumn("bound", F.col("boost") * F.col("best") + F.col("rest")), f"{name}-layers")
        order = W.partitionBy("q").orderBy("place", F.desc("layer")).rowsBetween(W.unboundedPreceding, 0)
        few = layers.filter(F.col("n") <= SEED).withColumn("sum", F.sum("n").over(order)).filter(F.col("sum") <= SEEDS)
        seeds = top_per_group(self._scores(self._candidates(few), terms), ["q"], [F.desc("score"), F.asc("doc")], rows)
        # fewer than ``rows`` found: any document may enter
        least = self.kept(seeds.filter(F.col("rank") == rows).select("q", F.col("score").alias("least")), f"{name}-least")
        slack = 10.0**-DIGITS  # rounding moves a score by half of that, up or down
        return layers.join(least, "q", "left").withColumn("needed", F.coalesce(F.col("bound") >= F.col("least") - slack, F.lit(True)))

    def search(self, queries: DataFrame, q: str, term: str, boost: str, rows: int = 20) -> DataFrame:
        """q, doc, score, rank: the ``rows`` documents of the greatest sums of boost * weight, ties by document.

        Equal terms of a query add up; terms with no boost above 0, or in no
        document, say nothing; a query without a hit gives no row.
        """
        name = uuid.uuid4().hex
        asked = queries.select(F.col(q).alias("q"), F.col(term).alias("term"), F.col(boost).cast("double").alias("boost")).filter("q is not null and term is not null")
        terms = self._query_terms(asked, name)
        read = self.needed(terms, rows, name).filter("needed").select("q", "term", "layer")
        candidates = self.kept(self._candidates(read), f"{name}-candidates")
        best = top_per_group(self._scores(candidates, terms), ["q"], [F.desc("score"), F.asc("doc")], rows)
        return best.select(F.col("q").alias(q), "doc", "score", "rank")


def scored_in_blocks(postings: DataFrame, queries: DataFrame, doc: str, term: str, weight: str, q: str, boost: str, rows: int) -> DataFrame:
    """q, doc, score, rank: the same for postings that are dealt by document and queries that most documents share terms with.

    There an index can leave out few postings. Queries, (q, term) distinct, come
    to the documents, whose sums are made where the postings are; only the first
    rows of each task for a query are shuffled.
    """
    met = postings.filter((F.col(weight) > 0) & F.col(doc).isNotNull()).join(written(queries.select(q, term, boost), "query-terms"), term)
    s = met.groupBy(BLOCK, doc, q).agg(F.round(F.sum(F.col(boost) * F.col(weight)), DIGITS).alias("score"))
    return top_per_group(s, [q], [F.desc("score"), F.asc(doc)], rows).select(q, doc, "score", "rank")
