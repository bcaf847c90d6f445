"""URL filters by dated lists: a temporal join in DataFrame operations only.

Dated additions and removals become validity intervals; each capture is joined
with the intervals of its host, its parent domains and its path prefixes, as of
the time it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, at) -> list, kind, pattern, valid_from, valid_to.

    Each dated entry holds until the next of the same pattern; removals make
    gaps. If a pattern is both added and removed at one time, it is removed.
    Rows with a null in any of the five columns are left out; valid_to of the
    last is null.
    """
    e = entries.select("list", "kind", "pattern", "action", "at").dropna()
    e = e.groupBy("list", "kind", "pattern", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    following = F.lead("at").over(W.partitionBy("list", "kind", "pattern").orderBy("at"))
    return e.select("list", "kind", "pattern", F.col("at").alias("valid_from"), following.alias("valid_to"), "removed").filter("removed = 0").drop("removed")


def keys_of(url: Column) -> Column:
    """All (kind, pattern) by which a list may name a URL: host, it and its parents as domains, host with path prefixes."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    steps = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(steps)
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: key("domain", F.array_join(F.slice(labels, i, n), ".")))
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: key("path", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))))
    return F.when(host != "", F.concat(F.array(key("host", host)), domains, F.coalesce(paths, F.array().cast("array<struct<kind:string,pattern:string>>"))))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched) against dated entries -> page_id, url, fetched, n_active, verdict, list, pattern.

    The longest pattern that is active at the fetch decides, "block" before
    other lists among equals, then by name; verdict is its list's name, or
    "none". Null and hostless URLs and null times match nothing. Repeated
    captures are judged each; other columns are ignored; empty captures give
    none, and without entries every verdict is "none".
    """
    valid = intervals(entries)
    c = captures.select("page_id", F.col("url").cast("string").alias("url"), "fetched")
    asked = c.distinct()
    keyed = asked.select("page_id", "url", "fetched", F.explode(keys_of(F.col("url"))).alias("key")).select("page_id", "url", "fetched", "key.kind", "key.pattern")
    active = keyed.join(valid, ["kind", "pattern"]).filter((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    order = F.struct((-F.length("pattern")).alias("a"), F.when(F.col("list") == "block", 0).otherwise(1).alias("b"), F.col("list").alias("list"), F.col("pattern").alias("pattern"), F.col("kind"))
    best = active.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_active"), F.min(order).alias("best"))
    best = best.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched").alias("f"), "n_active", "best")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f"))
    out = c.join(best, same, "left")
    return out.select("page_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce(F.col("best.list"), F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.kind").alias("kind"))
