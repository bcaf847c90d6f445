"""Record filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as T

MAX_CONTENT = 500_000


def missing(c: Column | str) -> Column:
    """Null or empty; the text "0" is a value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def reject_reason(url: str, title: str, description: str, content: str) -> Column:
    """Why a directory record is rejected, null if it is valid (P1). The first reason counts."""
    u = F.col(url)
    return (
        F.when(missing(u) | ~u.startswith("http"), "scheme")
        .when(u.contains("?"), "query")
        .when(u.rlike(r"\s"), "space")
        .when(missing(title), "title")
        .when(missing(description), "description")
        .when(missing(content), "content")
        .when(F.length(content) > MAX_CONTENT, "length")
    )


def not_foreign(category: Column | str) -> Column:
    """Categories outside Top/World."""
    return ~(F.col(category) if isinstance(category, str) else category).rlike("^/?Top/World/")


def in_list(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose trimmed value is among the wanted ones (P3-P5, J5); Spark broadcasts the list if it is small."""
    keys = wanted.select(F.trim(F.col(wanted.columns[0]).cast("string")).alias("_key")).distinct()
    return df.join(keys, F.trim(F.col(column).cast("string")) == F.col("_key"), "left_semi")


def not_in(df: DataFrame, columns: list[str], other: DataFrame) -> DataFrame:
    """Rows without a partner."""
    return df.join(other.select(*columns).distinct(), columns, "left_anti")


def outlier_categories(df: DataFrame, category: str, host: str, per_host: int = 10, in_all: int = 200) -> DataFrame:
    """Rows of categories with at most per_host urls of any host and in_all urls."""
    per = df.groupBy(category, host).agg(F.count("*").alias("_n")).groupBy(category).agg(F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return df.join(per.filter((F.col("_most") <= per_host) & (F.col("_all") <= in_all)).select(category), category, "left_semi")


def category_check(df: DataFrame, category: str, rules: dict[str, tuple[int, float]]) -> DataFrame:
    """Categories in which, for every field, the share of values of its least length is high enough."""
    shares = [F.avg(F.when(F.length(f) >= least, 1.0).otherwise(0.0)).alias(f"_share_{f}") for f, (least, _) in rules.items()]
    ok = F.lit(True)
    for f, (_, ratio) in rules.items():
        ok = ok & (F.col(f"_share_{f}") >= ratio)
    return df.groupBy(category).agg(F.count("*").alias("n"), *shares).filter(ok)


def length_reject(content: str, description: str, least_content: int = 400, least_description: int = 60) -> Column:
    """Too short to summarise."""
    return F.when(F.length(content) < least_content, "content").when(F.length(description) < least_description, "description")


def host_cap(links: DataFrame, url: str, order: list[str], most: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """http links, not of the skipped domains, at most ``most`` a host.

    Ranks are needed only up to the bound, so each task first drops what can't
    be among its own first ``most``: a host with any number of links is cut
    down before its rows meet.
    """
    host = T.url_host(F.col(url))
    rows = links.filter(F.col(url).rlike("^https?://")).withColumn("_host", host)
    for s in skip:
        rows = rows.filter(~F.col("_host").endswith(s))
    w = W.partitionBy("_host").orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).withColumnRenamed("_k", "k").drop("_host")


def by_length(df: DataFrame, length: Column, mode: str, limit: int) -> DataFrame:
    """mode long drops what is shorter, short what is longer (P20)."""
    return df.filter(length >= limit) if mode == "long" else df.filter(length <= limit)


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in order; those that are absent are null."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def required(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which no required field is missing."""
    for f in fields:
        df = df.filter(~missing(F.col(f).cast("string")))
    return df


_STEPS = {"trim": T.trim_spaces, "clean": T.clean, "normalize": T.normalize, "similarity": T.similarity_form, "corpus": T.corpus_form, "token": T.token_form, "lower": lambda c: F.lower(c), "length": lambda c: F.length(c), "prefix": lambda c, n: F.substring(c, 1, int(n)), "split": lambda c, p: F.split(c, p), "join": lambda c, s: F.array_join(c, s), "tokens": T.tokens}


def pipeline(spec: str, c: Column) -> Column:
    """A column through steps written as ``name::argument/name``."""
    for step in spec.split("/"):
        name, *args = step.split("::")
        c = _STEPS[name](c, *args)
    return c
