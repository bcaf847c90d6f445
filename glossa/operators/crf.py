"""Linear-chain conditional random fields over hashed features (K4).

Weights are one vector of a fixed size: a row of label weights for each feature
bucket, then the transitions. Tasks run forward and backward passes over padded
batches of sequences and add up their gradients, which are summed in a tree; the
driver holds a few vectors of that size and makes limited-memory quasi-Newton
steps. Labels are read off by Viterbi paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a padded batch, about.
POSITIONS = 1 << 15
#: Gradients that one step of the tree sums.
FAN = 16


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Batch:
    """Sequences padded to one length: which hashed features are where, and how long each is."""

    lengths: np.ndarray
    at: np.ndarray  # sequence * width + position, for each feature
    bucket: np.ndarray
    width: int

    @staticmethod
    def of(sequences: list[list[list[str]]], buckets: int) -> Batch:
        lengths = np.array([len(s) for s in sequences])
        width = int(lengths.max())
        at = [i * width + t for i, s in enumerate(sequences) for t, features in enumerate(s) for _ in features]
        bucket = [xxhash.xxh64_intdigest(f) % buckets for s in sequences for features in s for f in features]
        return Batch(lengths, np.array(at, np.int64), np.array(bucket, np.int64), width)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores (sequence, position, label)."""
        n, labels = len(self.lengths), weights.shape[1]
        out = np.stack([np.bincount(self.at, weights[self.bucket, k], n * self.width) for k in range(labels)], axis=1)
        return out.reshape(n, self.width, labels)

    def mask(self) -> np.ndarray:
        return np.arange(self.width) < self.lengths[:, None]


class Chain:
    """The model's parts of a weight vector: ``buckets`` rows of ``labels`` weights, then ``labels`` rows of transitions."""

    def __init__(self, labels: int, buckets: int):
        self.labels, self.buckets = labels, buckets

    @property
    def size(self) -> int:
        return (self.buckets + self.labels) * self.labels

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.buckets * self.labels
        return w[:cut].reshape(self.buckets, self.labels), w[cut:].reshape(self.labels, self.labels)

    def log_likelihood(self, w: np.ndarray, batch: Batch, gold: list[list[int]]) -> tuple[float, np.ndarray]:
        """Of the gold labels, summed over the batch, with its gradient: observed less expected counts."""
        weights, move = self.parts(w)
        score, mask = batch.emissions(weights), batch.mask()
        n, width = mask.shape
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, width):
            stepped = score[:, t] + _lse(forward[:, t - 1, :, None] + move, 1)
            forward[:, t] = np.where(mask[:, t, None], stepped, forward[:, t - 1])
        total = _lse(forward[:, -1], 1)
        for t in range(width - 2, -1, -1):
            stepped = _lse(move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], stepped, 0.0)
        share = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        y = np.zeros((n, width), np.int64)
        for i, labels in enumerate(gold):
            y[i, : len(labels)] = labels
        gold_score = (np.take_along_axis(score, y[:, :, None], 2)[:, :, 0] * mask).sum()
        both = mask[:, 1:]
        gold_score += (move[y[:, :-1], y[:, 1:]] * both).sum()
        observed = np.zeros_like(share)
        np.put_along_axis(observed, y[:, :, None], 1.0, 2)
        surplus = ((observed * mask[:, :, None]) - share).reshape(-1, self.labels)
        grad = np.zeros(self.size)
        of_weights, of_move = self.parts(grad)
        for k in range(self.labels):
            of_weights[:, k] = np.bincount(batch.bucket, surplus[batch.at, k], self.buckets)
        np.add.at(of_move, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        for t in range(1, width):
            pair = forward[:, t - 1, :, None] + move + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            of_move -= (np.exp(pair) * mask[:, t, None, None]).sum(0)
        return float(gold_score - total.sum()), grad

    def best(self, w: np.ndarray, batch: Batch) -> list[list[int]]:
        """Viterbi paths; of equal ones that with the lower labels, from the end on."""
        weights, move = self.parts(w)
        score, mask = batch.emissions(weights), batch.mask()
        n, width = mask.shape
        came = np.zeros((n, width, self.labels), np.int64)
        top = score[:, 0]
        for t in range(1, width):
            through = top[:, :, None] + move
            came[:, t] = np.where(mask[:, t, None], through.argmax(1), np.arange(self.labels))
            top = np.where(mask[:, t, None], through.max(1) + score[:, t], top)
        label = top.argmax(1)
        path = np.empty((n, width), np.int64)
        for t in range(width - 1, -1, -1):
            path[:, t] = label
            label = came[np.arange(n), t, label]
        return [row[:k].tolist() for row, k in zip(path, batch.lengths.tolist(), strict=True)]


def _batches(rows: list[tuple], most: int = POSITIONS) -> Iterator[list[tuple]]:
    """Rows (features, ...) of like length together, so that padding is short; a longer sequence goes alone."""
    held: list[tuple] = []
    for row in sorted(rows, key=lambda r: len(r[0])):
        if held and (len(held) + 1) * len(row[0]) > most:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _slices(batches: Iterator[pa.RecordBatch], most: int = POSITIONS) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``most`` positions or one row, as their features take many times the room as Python objects."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.list_value_length(b.column("features")), 0).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def _gradients(chain: Chain, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grad = 0.0, np.zeros(chain.size)
        for b in _slices(batches):
            rows = [(x, y) for x, y in zip(b.column("features").to_pylist(), b.column("gold").to_pylist(), strict=True) if x]
            for some in _batches(rows):
                value, part = chain.log_likelihood(shared.value, Batch.of([x for x, _ in some], chain.buckets), [y for _, y in some])
                total, grad = total + value, grad + part
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total]), pa.array([grad.tobytes()], pa.binary())], ["task", "value", "grad"])

    return run


def _added(table: pa.Table) -> pa.Table:
    order = np.argsort(table["task"].to_numpy())  # in one order, so that a sum is the same whatever came first
    grads = table["grad"].to_pylist()
    total = np.sum([np.frombuffer(grads[k]) for k in order], axis=0)
    return pa.table({"task": pa.array([int(table["task"].to_numpy().min()) // FAN], pa.int32()), "value": [float(table["value"].to_numpy()[order].sum())], "grad": [total.tobytes()]})


_SUM = "task int, value double, grad binary"


class ConditionalRandomField:
    """A chain over rows (features array<array<string>>, gold array<int>)."""

    def __init__(self, labels: int, buckets: int = 1 << 14, penalty: float = 0.1):
        self.chain, self.penalty = Chain(labels, buckets), penalty
        self.weights = np.zeros(self.chain.size)
        self.history: list[float] = []

    def objective(self, rows: DataFrame, w: np.ndarray, tasks: int) -> tuple[float, np.ndarray]:
        """Penalised negative log-likelihood of all rows, with its gradient."""
        shared = rows.sparkSession.sparkContext.broadcast(w)
        sums = rows.mapInArrow(_gradients(self.chain, shared), _SUM)
        while tasks > FAN:
            sums, tasks = sums.groupBy(F.floor(F.col("task") / FAN)).applyInArrow(_added, _SUM), -(-tasks // FAN)
        parts = sorted(sums.collect(), key=lambda r: r["task"])  # FAN at most
        shared.unpersist()
        value = -sum(r["value"] for r in parts) + self.penalty / 2 * float(w @ w)
        return value, -np.sum([np.frombuffer(r["grad"]) for r in parts], axis=0) + self.penalty * w

    def fit(self, rows: DataFrame, steps: int = 12, memory: int = 6) -> ConditionalRandomField:
        """Quasi-Newton steps from the present weights; each looks at all rows once or, where it must be shortened, more often.

        Rows without positions say nothing; without any rows the weights stay.
        """
        rows = rows.select("features", "gold").filter(F.size("features") > 0)
        tasks = rows.rdd.getNumPartitions()
        if rows.isEmpty():
            return self
        w = self.weights
        value, grad = self.objective(rows, w, tasks)
        self.history = [value]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(steps):
            q, kept = grad.copy(), []
            for s, y in reversed(pairs):
                a = (s @ q) / (y @ s)
                kept.append(a)
                q -= a * y
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(grad).max()))
            for (s, y), a in zip(pairs, reversed(kept), strict=True):
                q += (a - (y @ q) / (y @ s)) * s
            length = 1.0
            for _ in range(12):
                new = w - length * q
                new_value, new_grad = self.objective(rows, new, tasks)
                if new_value <= value - 1e-4 * length * float(grad @ q):
                    break
                length /= 2
            else:
                break
            s, y = new - w, new_grad - grad
            if y @ s > 1e-10:
                pairs = [*pairs, (s, y)][-memory:]
            done = value - new_value < 1e-6 * max(1.0, abs(value))
            w, value, grad = new, new_value, new_grad
            self.history.append(value)
            if done:
                break
        self.weights = w
        return self

    def label(self, rows: DataFrame, key: str) -> DataFrame:
        """key, labels: the best labels of each row's features; none for an empty or null row."""
        chain, kind = self.chain, rows.schema[key].dataType.simpleString()
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                sequences = b.column("features").to_pylist()
                out: list[list[int]] = [[] for _ in sequences]
                for some in _batches([(x, k) for k, x in enumerate(sequences) if x]):
                    for (_, k), path in zip(some, chain.best(shared.value, Batch.of([x for x, _ in some], chain.buckets)), strict=True):
                        out[k] = path
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.int32()))], [key, "labels"])

        return rows.select(key, "features").mapInArrow(run, f"`{key}` {kind}, labels array<int>")


def word_features(words: str) -> Column:
    """Features of each word of an array: itself, its neighbours, its last letters and how long it is."""
    w = F.col(words)

    def at(i: Column, name: str, step: int) -> Column:
        return F.concat(F.lit(f"{name}="), F.coalesce(F.get(w, i + step), F.lit("")))

    def features(x: Column, i: Column) -> Column:
        return F.array(at(i, "word", 0), at(i, "before", -1), at(i, "after", 1), F.concat(F.lit("end="), F.right(x, F.lit(2))), F.concat(F.lit("length="), F.least(F.length(x), F.lit(8)).cast("string")), F.lit("always"))

    return F.transform(w, features)
