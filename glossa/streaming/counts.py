"""Streaming forms of the record operators.

The record pipelines have no event time. What streams is counting: batches are
summed and merged into a keyed table, which a replayed batch doesn't change.
Windows over the events table are an extension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glossa.sources.storage import found


def stream_table(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class CountSink:
    """foreachBatch target: sums a batch by key under its own id.

    The run and the batch id name the folder, so a batch that runs again
    overwrites its own sums, and a stream with another checkpoint those of no
    other; totals add up all folders that were written to the end.
    """

    def __init__(self, root: str, keys: list[str], count: str | None = None, run: str = "0"):
        self.root, self.keys, self.count, self.run = root.rstrip("/"), keys, count, run

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        n = F.count("*") if self.count is None else F.sum(self.count)
        batch.groupBy(*self.keys).agg(n.alias("n"), F.count("*").alias("n_rows")).write.mode("overwrite").parquet(f"{self.root}/run={self.run}/batch={batch_id}")

    def totals(self, spark: SparkSession) -> DataFrame:
        done = [p.rpartition("/")[0] for p in found(spark, f"{self.root}/run=*/batch=*/_SUCCESS")]
        return spark.read.parquet(*done).groupBy(*self.keys).agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def run_counts(stream: DataFrame, sink: CountSink, checkpoint: str) -> StreamingQuery:
    """Start counting all that is there; the checkpoint is the run's name."""
    sink.run = hashlib.md5(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows with a watermark (extension)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts in sessions of a key (extension)."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def group_flush(stream: DataFrame, key: str, size: int) -> DataFrame:
    """key, n of every ``size`` rows of a key: bounded state that is flushed when full (§2.10), for append mode."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        full, rest = divmod(n, size)
        state.update((rest,))
        yield pd.DataFrame({key: [k[0]] * full, "n": [size] * full})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long", "n long", "append", "NoTimeout")
