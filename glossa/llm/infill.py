"""Fill-in-the-middle: each text is cut at two unit boundaries and its middle moves to the end.

Units are found by a predicate over two adjacent bytes (a code point, word or
line starts here), so a text can be cut into chunks that overlap by one byte
and whose boundaries are counted independently, many chunks in one numpy call.
Prefix sums over the counts give the number of units, from which the two cut
ranks follow, and tell which chunk owns each cut; only these chunks are scanned
again, for the byte at which the cut lies. No array over characters is made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import slices

#: Bytes of a chunk without its overlap, and chunks that are counted in one call.
CHUNK = 4096
TOGETHER = 256

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True

#: Does a unit start at this byte, given the byte before it? The first byte of a text always starts one.
STARTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "line": lambda before, here: before == 10,
}


class Chunks:
    """Texts, end to end, as chunks of at most ``size`` bytes that see one byte before them."""

    def __init__(self, texts: list[bytes], unit: str, size: int = CHUNK):
        self.starts_here = STARTS[unit]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        per_text = -(-lengths // size)
        #: The first chunk of each text, and one more: chunks never span texts.
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        owner = np.repeat(np.arange(len(texts)), per_text)
        self.low = self.begins[owner] + nth * size
        self.high = np.minimum(self.low + size, self.ends[owner])
        self.opens = nth == 0
        #: Units that start before each chunk of the whole run.
        self.before = np.concatenate([[0], np.cumsum(self._counts())])
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def _flags(self, low: int, high: int, opening: np.ndarray) -> np.ndarray:
        """Which bytes of [low, high) start a unit; ``opening`` are places in it where texts begin."""
        here = self.raw[low:high]
        before = self.raw[low - 1 : high - 1] if low else np.concatenate([np.zeros(1, np.uint8), here[:-1]])
        flags = self.starts_here(before, here)
        flags[opening] = True
        return flags

    def _counts(self) -> np.ndarray:
        counts = [np.empty(0, np.int64)]
        for a in range(0, len(self.low), TOGETHER):
            part = slice(a, a + TOGETHER)
            low, high = int(self.low[part][0]), int(self.high[part][-1])
            flags = self._flags(low, high, self.low[part][self.opens[part]] - low)
            counts.append(np.add.reduceat(flags, self.low[part] - low, dtype=np.int64))
        return np.concatenate(counts)

    def offset(self, text: int, rank: int) -> int:
        """Bytes of the text before its unit number ``rank``: only the chunk that owns the rank is scanned."""
        if rank >= self.units[text]:
            return int(self.ends[text] - self.begins[text])
        sought = self.before[self.first[text]] + rank
        chunk = int(np.searchsorted(self.before, sought, "right")) - 1
        low, high = int(self.low[chunk]), int(self.high[chunk])
        flags = self._flags(low, high, np.flatnonzero(self.opens[chunk : chunk + 1]))
        return low + int(np.flatnonzero(flags)[sought - self.before[chunk]]) - int(self.begins[text])


@dataclass(frozen=True)
class Plan:
    """What is drawn for each document: percentages of infilled and, of these, suffix-first texts; the sentinels."""

    seed: int = 1
    infill_pct: int = 90
    suffix_first_pct: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        tails = {a[k:] for a in marks for k in range(1, len(a))}
        if "" in marks or len(set(marks)) < 3 or any(b.startswith(t) or t.startswith(b) for t in tails for b in marks):
            raise ValueError("sentinels must differ, and no end of one may begin another: an output could not be taken apart")

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four 32-bit numbers from the seed and the id."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


_SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


def _infilled(plan: Plan, unit: str, size: int):
    marks = [x.encode() for x in (plan.prefix, plan.suffix, plan.middle)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            chunks = Chunks(texts, unit, size)
            rows = []
            for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                n, (h1, h2, h3, h4) = int(chunks.units[k]), plan.draws(doc_id)
                if not text or h3 % 100 >= plan.infill_pct or any(x in text for x in marks):
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                r1, r2 = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = chunks.offset(k, r1), chunks.offset(k, r2)
                if h4 % 100 < plan.suffix_first_pct:
                    rows.append((doc_id, n, "spm", r1, r2 - r1, b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
                else:
                    rows.append((doc_id, n, "psm", r1, r2 - r1, b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=False)]
            # characters are never cut, so that the bytes are text
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[5], pa.binary()).cast(pa.string())], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def infill(docs: DataFrame, plan: Plan = Plan(), unit: str = "char", size: int = CHUNK) -> DataFrame:
    """(doc_id, text) -> doc_id, n (units of the text), form, prefix_units, middle_units, output.

    The cuts lie after h1 % (n + 1) and h2 % (n + 1) units, by draws from the
    seed and the id; form is psm (prefix, suffix, middle), spm (suffix first) or
    plain (the text as it is, with null counts: empty texts, texts that contain
    a sentinel, and those not drawn for infilling).

    A null text is as an empty one; a null doc_id draws as an empty id; rows are
    independent, so repeated rows and ids pass through each by itself; other
    columns are ignored; an empty table gives none. Texts of any length are read
    whole: beside a text, numbers for each of its chunks are held.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_infilled(plan, unit, size), _SCHEMA)


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that ``infill`` was given, from its output and form alone.

    Infilled texts contain no sentinel, and no end of a sentinel begins another
    (``Plan`` sees to that), so the sentinels of an output are just the three
    that were put in.
    """
    parts = F.split(output, "|".join(re.escape(x) for x in (plan.prefix, plan.suffix, plan.middle)), -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    rebuilt = [(form == name, F.concat(*[F.get(parts, F.lit(k)) for k in order])) for name, order in at.items()]
    out = F.when(*rebuilt[0]).when(*rebuilt[1])
    return out.otherwise(output)
