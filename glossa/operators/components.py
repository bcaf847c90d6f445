"""Connected components of an edge table by alternating large and small stars.

Every step is a join or an aggregation with map-side combining. The least
neighbours of a round are written before they are joined: both inputs of a join
are then shuffles of their own, so that Spark splits a hub, a node with a great
part of all links, over several tasks. Links that fit in one partition go
through the same steps there, without shuffles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.sources.storage import remove, shared_dir


#: Links that one partition holds: as few need no shuffle, and no hub among them is split.
SMALL = 1 << 18


def components(edges: DataFrame, group: str | None = None, rounds: int = 60) -> DataFrame:
    """(u, v) links, within ``group`` if there is one -> (group, node, root) for every node of a link.

    root is the least node that links reach. Self links and nulls are ignored;
    no links give no rows.
    """
    spark = edges.sparkSession
    where = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    by = [group] if group else []
    key = [*by, "u"]

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    def turned(df: DataFrame, u: str, v: str) -> DataFrame:
        return df.select(*by, F.col(u).alias("u"), F.col(v).alias("v"))

    def stars(e: DataFrame, k: int, links: int) -> DataFrame:
        """First each node's larger neighbours, then all of its neighbours, move to its least one."""
        few = links <= SMALL
        own = (lambda df, name: df) if few else kept
        one = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        both = one(e.unionByName(turned(e, "v", "u")))
        low = own(both.groupBy(*key).agg(F.least(F.min("v"), F.first("u")).alias("m")), f"low{k}")
        large = own(turned(both.filter("v > u").join(low, key), "v", "m").distinct(), f"large{k}")
        low = own(large.groupBy(*key).agg(F.min("v").alias("m")), f"least{k}")
        moved = turned(large.join(low, key), "v", "m")
        return one(moved.unionByName(turned(low, "u", "m"))).filter("u > v").distinct()

    e = kept(edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges0")
    before = None
    for k in range(1, rounds + 1):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(*by, "u", "v")), F.bit_xor(F.xxhash64("v", "u", *by))).first())
        if now == before or not now[0]:
            break
        before, e = now, kept(stars(e, k, now[0]), f"edges{k}")
        for name in (f"edges{k - 1}", f"low{k}", f"large{k}", f"least{k}"):
            remove(spark, f"{where}/{name}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(*by, "v").distinct()
    return e.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(*by, F.col("v").alias("node"), F.col("v").alias("root")))
