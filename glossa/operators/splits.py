"""Splits, folds, caps and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators.joins import with_ordinal


def split_corpus(df: DataFrame, order: list[str], train: int, test: int, dev: int) -> DataFrame:
    """Column split: the head is test, then dev, the tail train, by percentages that sum to 100 (U4).

    n_train = min(floor(N train / 100), N - 2); n_test = floor((N - n_train) test / (test + dev)).
    """
    if train + test + dev != 100:
        raise ValueError("percentages must sum to 100")
    rows = with_ordinal(df, order)
    n = df.agg(F.count("*").alias("_n")).select("_n", F.least(F.floor(F.col("_n") * train / 100), F.col("_n") - 2).alias("_train"))
    n = n.select("_n", "_train", F.floor((F.col("_n") - F.col("_train")) * test / (test + dev)).alias("_test"))
    name = F.when(F.col("ord") <= F.col("_test"), "test").when(F.col("ord") <= F.col("_n") - F.col("_train"), "dev").otherwise("train")
    return rows.crossJoin(n).withColumn("split", name).drop("_n", "_train", "_test")


def folds(df: DataFrame, order: list[str], mode: str, amount: int) -> DataFrame:
    """Column fold from 0 (U5, W9). mode n: folds of ``amount`` rows; p: of floor(amount n / 100) rows, at least 1; all: one fold."""
    rows = with_ordinal(df, order)
    if mode == "all":
        return rows.withColumn("fold", F.lit(0).cast("long"))
    n = df.agg(F.count("*").alias("_n"))
    size = F.lit(amount) if mode == "n" else F.greatest(F.floor(F.lit(amount) * F.col("_n") / 100), F.lit(1))
    return rows.crossJoin(n).withColumn("fold", F.floor((F.col("ord") - 1) / size).cast("long")).drop("_n")


def label_cap(df: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each label (U8)."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their ranks (O3, W1); Spark trims groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def leave_one_out(df: DataFrame, group: str, item: str) -> DataFrame:
    """Each item with every other of its group."""
    return df.select(group, item).join(df.select(group, F.col(item).alias("other")), group).filter(F.col(item) != F.col("other"))


def rank_score(df: DataFrame, group: list[str], order: list[Column], name: str = "coordinate") -> DataFrame:
    """n - rank, so that the last has 0."""
    w = W.partitionBy(*group)
    return df.withColumn(name, F.count("*").over(w) - F.row_number().over(w.orderBy(*order)))


def digest_order(seed: int, *columns: str) -> Column:
    """A random order that any partitioning gives: by the md5 of the seed and the columns."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """Random order."""
    return df.orderBy(digest_order(seed, *df.columns))


def random_pick(df: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """n random rows."""
    return shuffled(df, seed).limit(n)


def head(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
