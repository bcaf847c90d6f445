"""Toxicity scores by FTRL-proximal logistic regression over hashed words.

Features are the presence of words, of pairs of neighbouring words and of pairs
with one word between them, hashed to DIMENSIONS. Each coordinate has its own
rate, and the L1 term keeps the weights of most at zero, so that the model is a
short list of (coordinate, weight) that is broadcast to the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.decontaminate import words_of
from glossa.llm.hashing import WordHashes, ngram_hashes
from glossa.llm.shared import Workspace, slices

LOG2_DIMENSIONS = 20
#: Bound of the labelled rows that the model is fitted on.
MAX_TRAINING_ROWS = 16_384


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the fit: rate alpha / (beta + sqrt(n)), penalties l1 and l2, passes over the rows."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    passes: int = 8


def features(words: np.ndarray) -> np.ndarray:
    """Distinct coordinates of a text's words, neighbours and skip-pairs."""
    skip = words[:-2] * np.uint64(0xD6E8FEB86659FD93) + words[2:] if len(words) > 2 else np.empty(0, np.uint64)
    every = np.concatenate([ngram_hashes(words, 1), ngram_hashes(words, 2), ngram_hashes(skip, 1)])
    return np.unique((every >> np.uint64(64 - LOG2_DIMENSIONS)).astype(np.int32))


def fit(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (coordinates, label) in their order -> coordinates and weights that aren't zero; the last coordinate is the bias."""
    size = (1 << LOG2_DIMENSIONS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        zi, l1 = z[at], np.where(at == bias, 0.0, p.l1)
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.passes):
        for at, label in rows:
            at = np.append(at, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return at, w[at]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        found = [features(hashes.of(words_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["ord", "label", "features"])


def _fitted(p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            flat, ends = b.column("features").flatten().to_numpy(), b.column("features").offsets.to_numpy()
            rows += [(flat[a - ends[0] : e - ends[0]], y) for a, e, y in zip(ends[:-1], ends[1:], b.column("label").to_pylist(), strict=True)]
        at, w = fit(rows, p)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, params: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``max_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0.

    Toxic rows may take half of the bound, as they are few; the rows of either
    label are those of the least hashes of doc_id, so the choice is the same for
    any partitioning. A doc_id that has several labels is toxic if any is;
    null ids and labels don't count. Where a doc_id is there several times, its
    rows are trained on as far as ``max_rows`` allows, those of the least hashes
    first. Without labelled rows all texts score alike, below 0.5.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = chosen.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = chosen.withColumn("ord", F.xxhash64("doc_id"))
    toxic = chosen.filter("label > 0").orderBy("ord", "doc_id").limit(max_rows // 2)
    clean = chosen.filter("label <= 0").orderBy("ord", "doc_id").limit(max_rows - toxic.count())
    # the fit goes through them in another order, in which toxic rows are spread evenly
    chosen = toxic.unionByName(clean).withColumn("ord", F.xxhash64(F.lit("order"), "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.join(F.broadcast(chosen), "doc_id").select("ord", "label", "text").mapInArrow(_hashed, "ord long, label int, features array<int>")
    work = Workspace(docs.sparkSession, "toxicity")
    hashed = work.keep(hashed)
    order = ["ord", "label", F.xxhash64("features")]
    model = hashed.orderBy(*order).limit(max_rows).repartition(1).sortWithinPartitions(*order).mapInArrow(_fitted(params), "at long, weight double").toPandas()
    work.free()
    if not len(model):
        return np.array([1 << LOG2_DIMENSIONS]), np.array([-1.0])
    return model["at"].to_numpy(), model["weight"].to_numpy()


class Scorer:
    """A broadcast model; scores texts on the executors."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.at, self.weight = model

    def ready(self) -> Scorer:
        self.dense = np.zeros((1 << LOG2_DIMENSIONS) + 1)
        self.dense[self.at] = self.weight
        self.hashes = WordHashes()
        return self

    def __call__(self, text: str | None) -> float:
        s = self.dense[features(self.hashes.of(words_of(text)))].sum() + self.dense[-1]
        return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text) and (doc_id, toxic) -> doc_id, held_out, score, predicted, one row per document row.

    Only the text is scored; null and empty texts get the score of the bias.
    Held-out rows are those whose crc32 of doc_id as text is 0 mod 5, a null
    doc_id as the empty text's (crc32 0, so held out). Repeated rows are scored
    each; other columns are ignored; an empty table gives none.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(train(docs, labels, max_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.value.ready()
        for b in slices(batches):
            s = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns.

    Only the text is scored: repeated rows and null ids stay or go alike, texts
    of any length are read whole. Null and empty texts get the score of the
    bias. Columns of any names pass through; an empty table gives none.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(train(docs, labels, max_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.value.ready()
        for b in slices(batches):
            yield b.filter(pa.array([score(t) < 0.5 for t in b.column("text").cast(pa.string()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
