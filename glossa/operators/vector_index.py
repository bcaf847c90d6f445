"""Nearest vectors by cosine (V26, O8): in blocks, exhaustively or through an inverted file of cells.

``Cells`` deals vectors to the nearest of some centroids, which are fitted on a
bounded sample. A search first probes the few cells nearest to a query. Where
the angle between the query and another cell's centroid, less the cell's radius,
leaves room for a better vector than the k-th found, that cell is probed too, so
that the result is exact; without this second step it is approximate.

Both searches compare a block of vectors with a block of queries in one matrix
product and keep the k best of each query, so nothing is paired row by row and
neither side is broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.splits import top_per_group
from glossa.sources.storage import shared_dir

#: Vectors of a block, and queries that meet one at a time.
BLOCK, QUERIES = 4096, 2048
#: Queries whose angles to all centroids are held at once, and rows that a task gives at once.
ANGLES, ROWS = 256, 4096
#: Rows that centroids are fitted on, and centroids, at most.
SAMPLE, MOST_CELLS = 16_384, 1024
#: Digits that cosines are rounded to, and what that may add to one.
DIGITS, SLACK = 6, 1e-6


def _unit(rows: list) -> np.ndarray:
    """Vectors as a matrix of length 1; one without a length becomes nan."""
    x = np.array([np.asarray(r, np.float64) for r in rows], np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _numbered(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """With a block number of about ``size`` rows within ``by``, by a hash of the key."""
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_n"))
    return df.join(n, by).withColumn(name, F.pmod(F.xxhash64("key"), "_n").cast("int")).drop("_n")


def _block_best(key: str, kind: pa.DataType, k: int):
    """A block of vectors and one of queries -> the k best of each query."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names, found = ["q", "key", "cosine"], []
        if len(queries) and len(vectors):
            keys = vectors.column("key").to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            keys, x = keys[order], _unit([vectors.column("vector")[i].as_py() for i in order.tolist()])
            asked = queries.column("key").to_numpy(zero_copy_only=False)
            y = _unit(queries.column("vector").to_pylist())
            for a in range(0, len(asked), 256):
                cosine = np.round(y[a : a + 256] @ x.T, DIGITS)
                cosine[np.isnan(cosine) | (asked[a : a + 256, None] == keys[None, :])] = -np.inf
                # equal cosines by key: they are in order of keys, and the sort is stable
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                for i, row in enumerate(best):
                    for j in row:
                        if np.isfinite(cosine[i, j]):
                            found.append((asked[a + i], keys[j], float(cosine[i, j])))
        types = [kind, kind, pa.float64()]
        return pa.Table.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(types)], names=names)

    return run


def _compared(queries: DataFrame, vectors: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, key, vector) on both sides -> q, key, cosine: the k best of each query in each block of vectors that it meets.

    A cell that many queries probe is met by blocks of them, each of which sees
    all blocks of the cell's vectors.
    """
    kind = vectors.schema["key"].dataType.simpleString()
    v = vectors if "block" in vectors.columns else _numbered(vectors, by, BLOCK, "block")
    q = _numbered(queries, by, QUERIES, "asking")
    blocks, askers = v.select(*by, "block").distinct(), q.select(*by, "asking").distinct()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    group = [*by, "asking", "block"]
    # both sides may come from one table: aliases make the columns of each its own
    left, right = ([F.col(c).alias(c) for c in [*group, "key", "vector"]] for _ in range(2))
    left, right = q.join(blocks, by).select(*left), v.join(askers, by).select(*right)
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_block_best("key", arrow, k), f"q {kind}, key {kind}, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found.dropDuplicates(["q", "key"]), ["q"], [F.desc("cosine"), F.asc("key")], k)


def _keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("key is not null and vector is not null")


def exhaustive(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q, key, cosine, rank: the k nearest other vectors of each query, all of them compared.

    Nulls and vectors without a length have no neighbours; ties go by key.
    """
    one = lambda df: _keyed(df, key, vector).withColumn("cell", F.lit(0))
    return _best(_compared(one(queries), one(vectors), ["cell"], k), k).withColumnRenamed("key", key)


def fitted(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of length 1 of a sample of vectors of length 1, by k-means on the sphere; cells that fall empty go."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = (sums / np.where(length > 0, length, 1))[length[:, 0] > 0]
    return centroids


class Cells:
    """An inverted file over (key, vector): every vector in the cell of its nearest centroid.

    Centroids are fitted on the SAMPLE rows with the least hashes; there are as
    many as the square root of the number of vectors, MOST_CELLS at most, so
    that what is broadcast is bounded. Cells of any size are dealt into blocks.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE):
        self.spark, self.key, self.vector = vectors.sparkSession, key, vector
        self.root = f"{shared_dir(self.spark)}/cells-{uuid.uuid4().hex}"
        rows = _keyed(vectors, key, vector)
        n = rows.count()
        taken = rows.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()  # at most ``sample`` rows
        unit = _unit(taken["vector"].to_list()) if len(taken) else np.zeros((0, 1))
        unit = unit[~np.isnan(unit).any(1)]
        wanted = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
        self.centroids = fitted(unit, wanted) if len(unit) else unit
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in (whole.iloc[a : a + ROWS] for whole in frames for a in range(0, len(whole), ROWS)):
                x = _unit(f["vector"].to_list())
                f, x = f[~np.isnan(x).any(1)], x[~np.isnan(x).any(1)]
                near = x @ shared.value.T
                cell = near.argmax(1) if len(f) else np.zeros(0, int)
                angle = np.arccos(np.clip(near[np.arange(len(f)), cell], -1, 1))
                yield f.assign(cell=cell.astype(np.int32), angle=angle)

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
        dealt = self.kept(rows.mapInPandas(placed, f"{kinds}, cell int, angle double") if len(unit) else self.spark.createDataFrame([], f"{kinds}, cell int, angle double"), "dealt")
        self.vectors = self.kept(_numbered(dealt, ["cell"], BLOCK, "block").drop("angle"), "cells")
        radius = np.full(len(self.centroids), -np.inf)
        for r in dealt.groupBy("cell").agg(F.max("angle").alias("radius")).collect():  # a row a cell
            radius[r["cell"]] = r["radius"]
        self.radius = radius

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _probes(self, queries: DataFrame, choose) -> DataFrame:
        """Queries in the cells that ``choose`` gives for their angles to all centroids."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.radius))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in (whole.iloc[a : a + ANGLES] for whole in frames for a in range(0, len(whole), ANGLES)):
                y = _unit(f["vector"].to_list())
                f, y = f[~np.isnan(y).any(1)].reset_index(drop=True), y[~np.isnan(y).any(1)]
                if not len(f):
                    continue
                centroids, radius = shared.value
                angles = np.arccos(np.clip(y @ centroids.T, -1, 1))
                row, cell = choose(f, angles, radius)
                # a query may go to every cell: its copies leave in parts
                for a in range(0, len(row), ROWS):
                    yield f.iloc[row[a : a + ROWS]][["key", "vector"]].assign(cell=cell[a : a + ROWS].astype(np.int32))

        kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("key", "vector"))
        return queries.mapInPandas(run, f"{kinds}, cell int")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
        """q, key, cosine, rank: the k nearest other vectors of each of ``queries``, which have the index's columns.

        Ties go by key. Without ``exact`` only the ``probes`` nearest cells of
        a query are looked at.
        """
        asked = _keyed(queries, self.key, self.vector)
        if not len(self.centroids):
            kind = asked.schema["key"].dataType.simpleString()
            return self.spark.createDataFrame([], f"q {kind}, `{self.key}` {kind}, cosine double, rank int")
        probes = min(probes, len(self.centroids))

        def nearest(f, angles, radius):
            order = np.argpartition(angles, probes - 1, axis=1)[:, :probes]
            return np.repeat(np.arange(len(f)), probes), order.ravel()

        def others(f, angles, radius):
            """Cells beyond the first that may have a vector of the k-th best cosine or a better one."""
            best = np.cos(np.maximum(angles - radius, 0))  # an empty cell has no radius: nothing is near
            best[:, ~np.isfinite(radius)] = -np.inf
            may = best >= f["least"].to_numpy()[:, None] - SLACK
            first = np.argpartition(angles, probes - 1, axis=1)[:, :probes]
            np.put_along_axis(may, first, False, axis=1)
            return np.nonzero(may)

        found = self.kept(_compared(self._probes(asked, nearest), self.vectors, ["cell"], k), f"found-{uuid.uuid4().hex}")
        if exact:
            kth = _best(found, k).filter(F.col("rank") == k).select(F.col("q").alias("key"), F.col("cosine").alias("least"))
            again = asked.join(kth, "key", "left").fillna(-2.0, ["least"])
            found = found.unionByName(_compared(self._probes(again, others), self.vectors, ["cell"], k))
        return _best(found, k).withColumnRenamed("key", self.key)
