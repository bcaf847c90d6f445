"""Words assigned to the nodes of a category tree.

A word belongs to the first node on the way down from the root whose children it
does not tell apart. The tree is passed level by level; what a word's counts say
about a node's children is one row for each (node, word), made by sums over the
children that have the word and, for the others, by sums over all children, so
that no word is paired with children that lack it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import category_ancestors
from glossa.sources.storage import shared_dir

#: Upper tail of chi-square below whose value a word tells nothing; deviations from the mean of the other tests. Fixed values.
TAIL = 0.45
ENTROPY_DEVIATIONS = 3
CROSS_ENTROPY_DEVIATIONS = 2
TINY = 1e-11


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its power series, or by its continued fraction far out."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return scale * total
    # Lentz's form of the continued fraction of the upper part
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi_square_value(freedom: int, tail: float = TAIL) -> float:
    """The value that chi-square exceeds with probability ``tail``, by bisection."""
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - gamma_share(freedom / 2, mid / 2) > tail else (low, mid)
    return (low + high) / 2


def _thresholds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(threshold=[chi_square_value(n - 1) for n in f["children"]])


class Tree:
    """Counts of a tree: documents of each node, and of each (node, word) how many of its documents have the word.

    docs: (path, doc), words: distinct (path, doc, word), path a slash path from
    one root. Rows without a path or word are left out.
    """

    def __init__(self, docs: DataFrame, words: DataFrame):
        self.spark = docs.sparkSession
        self.root = f"{shared_dir(self.spark)}/words-of-a-tree-{uuid.uuid4().hex}"
        leaf = docs.filter("path is not null").groupBy("path").agg(F.count("*").alias("docs"))
        nodes = leaf.select(F.explode(category_ancestors("path")).alias("node"), "docs").groupBy("node").agg(F.sum("docs").alias("docs"))
        nodes = self.kept(self.placed(nodes), "nodes")
        child = nodes.filter("depth > 1").withColumn("s", F.col("docs") + 2.0)
        below = child.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("s").alias("sum_s"), F.sum(1 / F.col("s")).alias("sum_inv"), F.sum("docs").alias("below"))
        self.nodes = self.kept(nodes.join(below, "node", "left").fillna(0, ["children", "sum_s", "sum_inv", "below"]), "tree")
        per = words.filter("path is not null and word is not null").groupBy("path", "word").agg(F.count("*").alias("df"))
        self.words = self.kept(self.placed(per.select(F.explode(category_ancestors("path")).alias("node"), "word", "df").groupBy("node", "word").agg(F.sum("df").alias("df"))), "counts")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    @staticmethod
    def placed(df: DataFrame) -> DataFrame:
        """With parent and depth of column node."""
        parts = F.split("node", "/")
        return df.withColumn("depth", F.size(parts)).withColumn("parent", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")))

    def scored(self, mode: str) -> DataFrame:
        """node, parent, depth, word, df, children, score: how even a word is over a node's children; null with fewer than two."""
        o, s, t, all_ = F.col("df").cast("double"), F.col("own") + 2.0, F.col("df"), F.col("docs")
        # what a child's count adds to its parent's row, the parent's own count left out
        parts = {"a": o * o / s, "b": o / s, "o": o, "g": o * F.log(o)}
        parts = {k: parts[k] for k in {"chi-square": "abo", "perplexity": "og"}.get(mode, "")}
        sums = [F.sum(k).alias(k) for k in parts]
        if mode == "cross-entropy":
            parts, sums = {"child": F.struct("own", o.alias("o"))}, [F.collect_list("child").alias("child")]
        rows = self.words.join(self.nodes.select("node", F.col("docs").alias("own")), "node")
        nothing = {k: F.lit(None).cast(rows.select(c.alias(k)).schema[k].dataType) for k, c in parts.items()}
        itself = F.struct("node", "df", *[c.alias(k) for k, c in nothing.items()])
        above = F.struct(F.col("parent").alias("node"), F.lit(None).cast("long").alias("df"), *[c.alias(k) for k, c in parts.items()])
        rows = rows.select("word", F.explode(F.when(F.col("depth") > 1, F.array(itself, above)).otherwise(F.array(itself))).alias("row"))
        # one shuffle brings a word's count at a node and those at its children together: neither is joined with the other
        counts = rows.select("word", "row.*").groupBy("node", "word").agg(F.sum("df").alias("df"), *sums)
        each = counts.join(self.nodes, "node")
        if mode == "chi-square":
            # sum over all children of the smoothed 2 x k table: those without the word by sum_s and sum_inv, what the others add by a, b and o
            n, a, b, oo = F.col("children"), F.col("a"), F.col("b"), F.col("o")
            c = (F.col("df") + n) / (F.col("docs") + 2 * n)
            without = F.col("sum_inv") / c - 2 * n + c * F.col("sum_s") + (c * c * F.col("sum_s") - 4 * c * n + 4 * F.col("sum_inv")) / (1 - c)
            score = without + (a + 2 * b) / c - 2 * oo + (a - 2 * c * oo + 4 * b) / (1 - c)
        elif mode == "perplexity":
            score = (F.log(t) * F.col("o") - F.col("g")) / t
        elif mode == "cross-entropy":
            x = F.aggregate("child", F.lit(0.0), lambda sum_, c: sum_ + c["own"] / all_ * (F.log(c["o"] / t + TINY) - math.log(TINY)))
            score = F.when(F.size("child") > 0, -x - math.log(TINY) * F.col("below") / all_)
        else:
            raise ValueError(f"no such mode: {mode!r}")
        return each.select("node", "parent", "depth", "word", "df", "children", F.when(F.col("children") > 1, score).alias("score"))


def assign_words(docs: DataFrame, words: DataFrame, mode: str = "chi-square") -> DataFrame:
    """category, word, df, score: words at the first node on each way down whose children they don't tell apart.

    By mode: chi-square, where the smoothed statistic of children against
    presence is below its value at a tail of TAIL; perplexity, where the entropy
    over the children is more than three deviations above its mean over the
    node's open words; cross-entropy, two deviations below. A node with one child
    hands all words on; a leaf keeps what is left, without a score.
    """
    tree = Tree(docs, words)
    scored = tree.kept(tree.scored(mode), "scored")
    if mode == "chi-square":
        limits = scored.filter("children > 1").select("children").distinct().mapInPandas(_thresholds, "children long, threshold double")
        limits = tree.kept(limits, "limits")
    depths = [r["depth"] for r in tree.nodes.select("depth").distinct().collect()]  # as many as the tree is deep
    out = open_ = None
    for depth in range(1, max(depths, default=0) + 1):
        level = scored.filter(F.col("depth") == depth)
        if open_ is not None:
            level = level.join(open_, ["parent", "word"], "left_semi")
        if mode == "chi-square":
            level = level.join(limits, "children", "left").withColumn("stays", F.col("score") < F.col("threshold"))
        else:
            level = tree.kept(level, f"level{depth}")
            k = ENTROPY_DEVIATIONS if mode == "perplexity" else -CROSS_ENTROPY_DEVIATIONS
            limit = level.groupBy("node").agg((F.avg("score") + k * F.stddev_pop("score")).alias("threshold"))
            level = level.join(limit, "node").withColumn("stays", F.col("score") > F.col("threshold") if k > 0 else F.col("score") < F.col("threshold"))
        stays = (F.col("children") == 0) | ((F.col("children") > 1) & F.coalesce("stays", F.lit(False)))
        level = tree.kept(level.select("node", "word", "df", "score", stays.alias("stays")), f"decided{depth}")
        found = level.filter("stays").select(F.col("node").alias("category"), "word", "df", "score")
        out = found if out is None else out.unionByName(found)
        open_ = level.filter("not stays").select(F.col("node").alias("parent"), "word")
    return out if out is not None else scored.select(F.col("node").alias("category"), "word", "df", "score")
