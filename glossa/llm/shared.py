"""Helpers for operators that run in several jobs.

Tables that cut the lineage of a run are written to the folder that the cluster
names in ``spark.checkpoint.dir``: every executor can read it, and what has been
written survives the loss of the executor that made it. Other intermediate
tables are persisted on disk for the run, and recomputed where they are lost.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources.storage import shared_dir


class Workspace:
    """A folder of tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Hold a table that later steps of the run read on the executors' disks until ``free``.

        Its lineage stays: what a lost executor held is computed again.
        """
        self.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.kept[-1]

    def free(self) -> None:
        """Let go of all kept tables."""
        while self.kept:
            self.kept.pop().unpersist()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that a caller's other columns can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter over hashes: its size is the same for any number of them.
FILTER_BITS = 1 << 26


def hash_bits(hashes: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bit for each 64-bit hash: 8 MB whatever their number, of which the driver gets FILTER_BITS / 64 numbers at most."""
    size = bits or FILTER_BITS
    bit = F.pmod(F.col(column), F.lit(size))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    got = hashes.groupBy(F.floor(bit / 64).alias("at")).agg(F.bit_or(word).alias("bits")).toArrow()  # as arrays: rows would take a hundred times the memory
    out = np.zeros(size // 64, np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter: all that are, and by chance a few others."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


#: Bytes of text that a worker turns into Python objects at once; a row above that goes alone.
SLICE_BYTES = 4 << 20


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's texts and binaries."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if any(is_kind(column.type) for is_kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` and, beyond one row, ``size`` bytes, so that a worker holds few texts as Python objects.

    At the end of a task, memory that its buffers and tables took goes back to
    the system: Python workers live on from task to task.
    """
    for batch in batches:
        ends, at = np.cumsum(_row_bytes(batch)), 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(max(fits, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass
