"""Evaluation: overlap metrics, pivots, significance, crowd tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators.joins import with_ordinal_sum
from glossa.operators.stats import chi_square_p


def rouge_n(candidate: Column, reference: Column, n: int, prefix: str = "rouge") -> list[Column]:
    """Precision, recall and F of n-gram overlap between two token arrays."""
    p, r, f = V.overlap_prf(V.from_tokens(T.ngrams(reference, n)), V.from_tokens(T.ngrams(candidate, n)))
    return [F.round(p, 6).alias(f"{prefix}_{n}_p"), F.round(r, 6).alias(f"{prefix}_{n}_r"), F.round(f, 6).alias(f"{prefix}_{n}_f")]


def rouge_averages(pairs: DataFrame, candidate: str, reference: str, orders: tuple[int, ...]) -> DataFrame:
    """n, items, macro and micro precision and recall of n-gram overlap.

    Macro averages are means over the pairs that have n-grams on both sides,
    micro averages are of the sums.
    """
    each = F.array(*[F.struct(F.lit(n).alias("n"), V.from_tokens(T.ngrams(candidate, n)).alias("c"), V.from_tokens(T.ngrams(reference, n)).alias("r")) for n in orders])
    x = pairs.select(F.explode(each).alias("x")).select("x.n", V.shared("x.c", "x.r").alias("m"), V.total("x.c").alias("c"), V.total("x.r").alias("r")).filter("c > 0 and r > 0")
    means = [F.round(F.avg(F.col("m") / F.col(s)), 6).alias(f"macro_{n}") for n, s in (("p", "c"), ("r", "r"))]
    sums = [F.round(F.sum("m") / F.sum(s), 6).alias(f"micro_{n}") for n, s in (("p", "c"), ("r", "r"))]
    return x.groupBy("n").agg(F.count("*").alias("items"), *means, *sums)


def coverage(candidate: Column, reference: Column, n: int) -> Column:
    """Share of the candidate's distinct n-grams that the reference has."""
    g = F.array_distinct(T.ngrams(candidate, n))
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, T.ngrams(reference, n))) / F.size(g)).otherwise(F.lit(0.0))


def multi_reference_cosine(pairs: DataFrame, item: str, candidate: str, reference: str) -> DataFrame:
    """item, cosine: the largest over an item's references, each against as many of the candidate's tokens as it has."""
    cut = F.slice(F.col(candidate), 1, F.greatest(F.size(reference), F.lit(1)))
    c = V.cosine(V.from_tokens(cut), V.from_tokens(reference))
    return pairs.groupBy(item).agg(F.max(F.round(c, 6)).alias("cosine"))


def pivot_metrics(evaluation: DataFrame, url: str, system: str, metric: str, value: str, systems: list[str], metrics: list[str]) -> DataFrame:
    """One row a url, a column for each system and metric, 0 where there is none.

    The columns are stated, so no pass over the data has to find them.
    """
    cells = [F.coalesce(F.avg(F.when((F.col(system) == s) & (F.col(metric) == m), F.col(value))), F.lit(0.0)).alias(f"{s}_{m}") for s in systems for m in metrics]
    return evaluation.groupBy(url).agg(*cells)


def system_table(evaluation: DataFrame, system: str, metric: str, value: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean of each metric by system."""
    return evaluation.groupBy(system).agg(*[F.round(F.coalesce(F.avg(F.when(F.col(metric) == m, F.col(value))), F.lit(0.0)), digits).alias(m) for m in metrics])


def parse_system_id(c: Column) -> Column:
    """Parameters of ids like ``name@a=1,b=2`` as a map."""
    return F.when(F.contains(c, F.lit("@")), F.str_to_map(F.substring_index(c, "@", -1), F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))


def parameter_grid(spark, domains: dict[str, list]) -> DataFrame:
    """Every combination of stated parameter values."""
    out = spark.range(1).select()
    for name, values in domains.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out


def threshold_sweep(df: DataFrame, size: str, metrics: list[str], most: int) -> DataFrame:
    """i, n and the means of metrics over rows of at least size i, for i from 0 to most.

    Rows are first summed by size, of which at most ``most`` + 1 matter; the
    sums are then accumulated from above.
    """
    from pyspark.sql import Window as W

    per = df.groupBy(F.least(F.col(size), F.lit(most)).cast("long").alias("i")).agg(F.count("*").alias("_n"), *[F.sum(m).alias(f"_{m}") for m in metrics])
    grid = df.sparkSession.range(most + 1).withColumnRenamed("id", "i")
    w = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    x = grid.join(per, "i", "left")
    n = F.sum("_n").over(w)
    return x.select("i", F.coalesce(n, F.lit(0)).alias("n"), *[(F.sum(f"_{m}").over(w) / n).alias(m) for m in metrics])


#: Rating labels and their values: fixed values.
RATINGS = {"very_poor": 1, "poor": 2, "acceptable": 3, "good": 4, "very_good": 5}
#: Preference labels and their values: fixed values.
PREFERENCES = {"first": 1, "neither": 0, "second": -1}


def _labels(c: Column, values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def crowd_means(ratings: DataFrame, system: str, questions: list[str]) -> DataFrame:
    """system, question, mean, agreement (A28): each question has its label and ``<question>:confidence`` column."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"`{q}`").alias("label"), F.col(f"`{q}:confidence`").cast("double").alias("confidence")) for q in questions]))
    long = ratings.select(system, each.alias("x")).select(system, "x.*").withColumn("v", _labels(F.col("label"), RATINGS))
    return long.groupBy(system, "question").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg("confidence"), 6).alias("agreement"), F.count("v").alias("n"))


def pair_preference(judgements: DataFrame, first: str, second: str, label: str) -> DataFrame:
    """Mean preference of each pair of systems, and the shares 1, 1/2, 0 of either."""
    v = _labels(F.col(label), PREFERENCES)
    share = F.when(v == 1, 1.0).when(v == 0, 0.5).when(v == -1, 0.0)
    return judgements.groupBy(first, second).agg(F.round(F.avg(v), 6).alias("preference"), F.round(F.avg(share), 6).alias("first_share"), F.round(F.avg(1 - share), 6).alias("second_share"), F.count("*").alias("n"))


def replacement_ratio(outputs: DataFrame, output: str, title: str) -> DataFrame:
    """Share of outputs that are the title, but for punctuation and case."""
    return outputs.agg(F.count("*").alias("n"), F.round(F.avg((T.similarity_form(output) == T.similarity_form(title)).cast("double")), 6).alias("ratio"))


def significance(scores: DataFrame, group: list[str], first: str, second: str, level: float = 0.05) -> DataFrame:
    """group, n, w, p, significant, t: signed-rank and t statistics of paired scores.

    Differences are ranked by size, equal ones by their mean rank; zeros are
    ranked and then dropped (Pratt). w is the sum of the ranks of positive
    differences, p two-sided by the normal approximation. Positions come from a
    range sort of the distinct sizes, so no task holds a group. Pairs with a
    null are left out.
    """
    d = scores.select(*group, (F.col(first) - F.col(second)).cast("double").alias("_d")).filter("_d is not null")
    per = d.groupBy(*group, F.abs("_d").alias("_a")).agg(F.count("*").cast("double").alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    sizes = with_ordinal_sum(per, [*group, "_a"], "_n", "_before")
    start = sizes.groupBy(*group).agg(F.min("_before").alias("_start"))
    rank = F.col("_before") - F.col("_start") + (F.col("_n") + 1) / 2
    ties = F.when(F.col("_a") > 0, F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).otherwise(F.lit(0.0))
    ranked = sizes.join(start, group).groupBy(*group).agg(
        F.sum("_n").alias("_m"), F.sum(F.when(F.col("_a") == 0, F.col("_n")).otherwise(F.lit(0.0))).alias("_z"), F.sum(F.col("_up") * rank).alias("w"), F.sum(ties).alias("_t")
    )
    m, z = F.col("_m"), F.col("_z")
    mean = (m * (m + 1) - z * (z + 1)) / 4
    var = (m * (m + 1) * (2 * m + 1) - z * (z + 1) * (2 * z + 1)) / 24 - F.col("_t") / 48
    p = F.when(var > 0, chi_square_p((F.col("w") - mean) * (F.col("w") - mean) / var)).otherwise(F.lit(1.0))
    moments = d.groupBy(*group).agg(F.avg("_d").alias("_mean"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col("_mean") / (F.col("_sd") / F.sqrt(m))).otherwise(F.lit(0.0))
    out = ranked.join(moments, group).withColumn("p", F.round(p, 6))
    return out.select(*group, m.cast("long").alias("n"), "w", "p", (F.col("p") < level).alias("significant"), F.round(t, 9).alias("t"))
