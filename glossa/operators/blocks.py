"""Rows dealt in blocks by a key, so that their long form is counted and joined where it is made.

A table of documents is dealt once, as whole texts. What is told of a word goes
to each block that has it, once, however many of its documents do; the rows of
words in documents, which are many times the texts, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.sources.storage import written

BLOCK = "_block"
#: Rows of a block, about, and the least number of blocks: the larger a block, the fewer words it has for its rows.
ROWS, BLOCKS = 8192, 24


def dealt(df: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """The rows with their block, a number from their key; all rows of a block lie in one task.

    With ``group``, of which there are far fewer values than rows, blocks have
    rows of one group (but for equal hashes), a large group several blocks.
    """
    if group is None:
        block = F.pmod(F.xxhash64(key), F.lit(max(BLOCKS, -(-df.count() // ROWS))))
    else:
        sizes = written(df.groupBy(group).agg(F.ceil(F.count("*") / ROWS).alias("_parts")), "group-sizes")
        df = df.join(sizes, df[group].eqNullSafe(sizes[group])).drop(sizes[group])
        block = F.xxhash64(group, F.pmod(F.xxhash64(key), F.col("_parts")))
    # never null, so that no filter comes before the exchange and all uses of the rows share it
    return df.withColumn(BLOCK, F.coalesce(block, F.lit(0).cast("long"))).drop("_parts").repartition(BLOCK)


def told(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Dealt rows joined with values that have a block too; only the values are shuffled."""
    return rows.join(values.repartition(BLOCK), [BLOCK, *on])
