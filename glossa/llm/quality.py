"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on each document. The votes of
all documents are counted by pattern, and expectation-maximisation over these
counts estimates how each labeller votes on good and on bad documents and hence
the probability of good for each pattern. These probabilities then train a
linear scorer over hashed features of the texts, which scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Workspace, slices

LOG2_DIMENSIONS = 16
#: Bound of the documents that the linear scorer is fitted on.
MAX_TRAINING_ROWS = 16_384
BAD, NONE, GOOD = 0, 1, 2

_LETTERS_LOW = bytes(range(97, 123))
_LETTERS_UP = bytes(range(65, 91))
_SPACE = b" \t\n\r\x0b\x0c"
_COMMON_MARKS = b".,;:'\"()?-"
_DIGITS = bytes(range(48, 58))
_ODD = bytes(b for b in range(33, 127) if b not in _LETTERS_LOW + _LETTERS_UP + _DIGITS + _COMMON_MARKS + b"!|")


def measures(text: str | None) -> tuple[float, ...]:
    """Shares that the labellers look at; byte counts of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n_bytes, n_words = max(1, len(raw) - _count(raw, _SPACE)), max(1, len(words))
    ups, lows = _count(raw, _LETTERS_UP), _count(raw, _LETTERS_LOW)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        float(len(words)),
        _count(raw, _ODD) / n_bytes,
        ups / max(1, ups + lows),
        raw.count(b"!") / n_words,
        raw.count(b"|") / n_words,
        _variety(words),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words,
        n_bytes / n_words,
    )


#: Words in a row whose share of distinct ones is looked at.
WINDOW = 1024


def _variety(words: list[bytes], size: int = WINDOW) -> float:
    """Mean share of distinct words over all windows of ``size`` words (the text, if it is shorter), so that length does not lower it.

    A word counts in the windows in which it is the first of its kind: those
    that start after its last occurrence before, and not after it.
    """
    n = len(words)
    if n <= size:
        return len(set(words)) / max(1, n)
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.uint16 if len(number) <= 1 << 16 else np.int64, n)
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    at = np.arange(n)
    starts = np.minimum(at, n - size) - np.maximum(before, at - size)
    return float(np.maximum(starts, 0).sum()) / (size * (n - size + 1))


def _count(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """One vote of each labeller.

    Eight detectors call a document bad or say nothing: odd marks, capitals,
    shouting, bars, poor vocabulary (whatever the length), repeated lines, stutter, odd word lengths.
    One looks for plain prose and calls it good, or a text without words bad.
    """
    n, odd, caps, bangs, bars, variety, same_lines, stutter, length = m
    longer = n >= 8
    bad = (
        odd > 0.08,
        longer and caps > 0.5,
        bangs > 0.3,
        longer and bars > 0.15,
        longer and variety < 0.35,
        longer and same_lines > 0.4,
        longer and stutter > 0.2,
        n > 0 and (length > 14 or length < 2),
    )
    prose = n > 0 and variety > 0.5 and caps < (0.2 if longer else 0.6) and stutter < 0.1 and odd < 0.04 and bars < 0.03 and bangs < 0.1 and 1.5 < length < 14
    return (*(BAD if x else NONE for x in bad), GOOD if prose else BAD if n == 0 else NONE)


def label_model(patterns: list[tuple[str, int]], steps: int = 200) -> dict[str, float]:
    """EM over (pattern, count): the probability of good for each pattern.

    Votes are independent given the class; each labeller has its own rate of
    bad, no and good votes on either class. The start, that a document is
    likely bad if any labeller says so, fixes the names of the classes.
    """
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    q = np.where((v == BAD).any(1), 0.1, 0.9)
    for _ in range(steps):
        prior = (n @ q + 1) / (n.sum() + 2)
        log = np.tile([math.log(1 - prior), math.log(prior)], (len(q), 1))
        for j in range(v.shape[1]):
            for y, w in ((0, n * (1 - q)), (1, n * q)):
                rate = np.bincount(v[:, j], w, 3) + 1.0
                log[:, y] += np.log(rate / rate.sum())[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return {p: float(x) for (p, _), x in zip(patterns, q, strict=True)}


_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 0, runs shortened to two: what a word looks like, not what it says."""
    out = bytearray()
    for c in (word + word[-4:]).translate(_SHAPE):
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out)


#: Longer words count as pieces of so many bytes.
PIECE = 64


def _pieces(words: list[bytes]) -> list[bytes]:
    """Words with the long ones cut up, so that a text without spaces is looked at from end to end."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


class Shapes(dict):
    """Word -> hash of its shape, emptied beyond its limit; nothing else is held from text to text."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(_shape(word)) >> (64 - LOG2_DIMENSIONS)
        return value


def features(text: str | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values: share of each word shape, and the measures in steps."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = _pieces(raw.split())
    size = 1 << LOG2_DIMENSIONS
    at, count = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), return_counts=True)
    m = measures(text)
    steps = [min(9, int(math.log2(1 + m[0])))] + [min(9, int(x * 10)) for x in m[1:8]] + [min(9, int(m[8] / 2))]
    steps_at = np.array([size - 128 + 10 * k + s for k, s in enumerate(steps)])
    return np.concatenate([at % (size - 128), steps_at]), np.concatenate([count / max(1, len(words)), np.full(len(steps), 0.5)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 6, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by per-coordinate adaptive steps; the last weight is the bias."""
    w, g2 = np.zeros((1 << LOG2_DIMENSIONS) + 1), np.full((1 << LOG2_DIMENSIONS) + 1, 1e-3)
    for _ in range(passes):
        for at, x, y in rows:
            at, x = np.append(at, len(w) - 1), np.append(x, 0.5)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[at] @ x))))) - y) * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = ["".join(map(str, votes(measures(t)))) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array(found, pa.string())], ["ord", "pattern"])


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Label model over the votes on all documents, scorer over ``max_rows`` of them.

    The scorer's rows are those of the least hashes of (doc_id, length of the
    text); rows that tie beyond the bound are chosen by their pattern.
    """
    work = Workspace(docs.sparkSession, "quality")
    key = F.xxhash64(F.col("doc_id").cast("string"), F.length("text"))
    voted = work.keep(docs.select(key.alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(_voted, "ord long, pattern string"))
    # at most 3 ** labellers rows, however many documents there are
    counts = [(r["pattern"], r["n"]) for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()]
    model = label_model(counts)
    bound = voted.orderBy("ord").limit(max_rows).agg(F.max("ord")).first()[0]
    rows = docs.select(key.alias("ord"), F.col("text").cast("string").alias("text")).filter(F.col("ord") <= F.lit(bound)) if bound is not None else docs.limit(0).select(key.alias("ord"), F.col("text").cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in slices(batches):
            found = [(*features(t, shapes), model["".join(map(str, votes(measures(t))))]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.float64())], ["ord", "at", "x", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [r for b in batches for r in zip(b.column("at").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        w = fit([(np.array(a, np.int64), np.array(x), y) for a, x, y in given])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "weight"])

    sample = work.keep(rows.mapInArrow(hashed, "ord long, at array<long>, x array<double>, y double"))
    got = sample.orderBy("ord", "y").limit(max_rows).repartition(1).sortWithinPartitions("ord", "y", F.xxhash64("x")).mapInArrow(fitted, "at long, weight double").toPandas()
    weights = np.zeros((1 << LOG2_DIMENSIONS) + 1)
    weights[got["at"].to_numpy()] = got["weight"].to_numpy()
    work.free()
    return model, weights


def _scores(weights: np.ndarray, texts: list[str | None], shapes: Shapes) -> list[float]:
    out = []
    for t in texts:
        at, x = features(t, shapes)
        out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(weights[at] @ x) + 0.5 * float(weights[-1]))))))
    return out


def quality(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, pattern, posterior, score, kept; one row per document row.

    pattern holds the labellers' votes, posterior the label model's probability
    of good, score the scorer's, kept whether score >= 0.5. Null and empty
    texts have no words: one labeller calls them bad, the others say nothing. Repeated rows and null ids are scored each; other columns are
    ignored; an empty table gives none.
    """
    model, weights = (docs.sparkSession.sparkContext.broadcast(x) for x in train(docs, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            found = ["".join(map(str, votes(measures(t)))) for t in texts]
            s = _scores(weights.value, texts, shapes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string()), pa.array([model.value[p] for p in found], pa.float64()), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_())], ["doc_id", "pattern", "posterior", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, pattern string, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs whose score is at least 0.5, with all their columns.

    Only the text decides: repeated rows and null ids stay or go alike, texts of
    any length are read whole. Null and empty texts are scored as texts without
    words. Columns of any names pass through; an empty table gives none.
    """
    _, trained = train(docs, max_rows)
    weights = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in slices(batches):
            texts = b.column("text").cast(pa.string()).to_pylist()
            yield b.filter(pa.array([s >= 0.5 for s in _scores(weights.value, texts, shapes)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
