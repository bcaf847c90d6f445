"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text, those that are the least of some sliding window
are its fingerprints. With windows of ``SPAN - k + 1`` k-grams, any SPAN words
that two texts share contain a fingerprint of both, so joining fingerprints
misses no shared span; each hit is then extended to the windows around it, which
are compared whole.

The benchmark's fingerprints and windows are tables. Documents are read once
beside two bitmaps over their hashes, whose size is fixed: a fingerprint that
the first one lacks is in no item, and of the windows around the others only
those that the second one has go on. These few rows are joined with the table
of windows, so that neither texts are shuffled nor the benchmark is held in
memory, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.hashing import Words, distinct, ngram_hashes
from glossa.llm.shared import Workspace, among, hash_bits, slices

SPAN = 13
K = 6

#: What parts words: all ASCII but digits and letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split() if text else []


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """Which hashes are the least of some window of ``width`` hashes; all ties count."""
    if len(grams) < width:
        return np.zeros(len(grams), bool)
    low, have = grams, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    pad = np.zeros(width - 1, np.uint64)
    high, have = np.concatenate([pad, low, pad]), 1
    while have < width:
        step = min(have, width - have)
        high = np.maximum(high[:-step], high[step:])
        have += step
    return high == grams


#: What tells the item sets of windows apart.
CLASS = ["c1", "c2", "size"]

_WINDOWS = "item string, m int, g long, print boolean"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> the hashes of their windows, by their number of words m, and of their fingerprints."""
    words = Words(SEPARATORS)
    for batch in slices(batches, rows=64):
        items, ms, grams, prints = [], [], [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            w = words(text)
            m = min(SPAN, len(w))
            found = [(ngram_hashes(w, m), False)] if m else []
            if m == SPAN:
                short = ngram_hashes(w, K)
                found.append((short[fingerprints(short, SPAN - K + 1)], True))
            for g, is_print in found:
                g = distinct(g)
                items += [item] * len(g)
                ms.append(np.full(len(g), m, np.int32))
                grams.append(g.view(np.int64))
                prints.append(np.full(len(g), is_print))
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(np.concatenate(ms)), pa.array(np.concatenate(grams)), pa.array(np.concatenate(prints))], [x.split()[0] for x in _WINDOWS.split(", ")])


class Index:
    """A benchmark's windows and their items as tables, the bitmaps over its hashes, and the lengths of its short items.

    Windows that the same items have are of one class, so that a document's
    windows are joined with classes, and only these with items.
    """

    def __init__(self, benchmark: DataFrame, work: Workspace):
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
        table = work.table(items.mapInArrow(_item_windows, _WINDOWS), "windows")
        windows = table.filter("not print")
        each = windows.select("m", "g", "item").distinct()
        digest = [F.bit_xor(F.xxhash64("item")).alias("c1"), F.bit_xor(F.xxhash64(F.lit("second"), "item")).alias("c2"), F.count("*").alias("size")]
        # written: a window that very many documents have is then split where it is joined
        self.windows = work.table(each.groupBy("m", "g").agg(*digest), "by_window")
        one = self.windows.groupBy(*CLASS).agg(F.min(F.struct("m", "g")).alias("w")).select(*CLASS, "w.*")
        self.classes = work.table(each.join(one, ["m", "g"]).select(*CLASS, "item"), "classes")
        self.short = sorted(r["m"] for r in windows.filter(F.col("m") < SPAN).select("m").distinct().collect())  # 12 at most
        self.bits = benchmark.sparkSession.sparkContext.broadcast((hash_bits(table.filter("print"), "g"), hash_bits(windows, "g")))


_SCANNED = "d1 long, d2 long, n_words long, candidates array<struct<m:int,at:int,g:bigint>>"
_CANDIDATE = pa.struct([("m", pa.int32()), ("at", pa.int32()), ("g", pa.int64())])


def _scanned(bits, short: list[int], columns: list[str]):
    """Texts -> their number of words, and the windows that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (prints, windows) = Words(SEPARATORS), bits.value
        for batch in slices(batches):
            counts, ends, found = [], [0], [[], [], []]
            for text in batch.column("text").to_pylist():
                w = words(text)
                n = 0
                for m in [*short, SPAN]:
                    if len(w) < m:
                        continue
                    if m == SPAN:
                        grams = ngram_hashes(w, K)
                        at = np.flatnonzero(fingerprints(grams, SPAN - K + 1))
                        at = at[among(prints, grams[at])]
                        if not len(at):
                            continue
                        near = (at[:, None] + np.arange(K - SPAN, 1)).ravel()
                        near = np.unique(near[(near >= 0) & (near <= len(w) - SPAN)])
                    else:
                        near = np.arange(len(w) - m + 1)
                    g = ngram_hashes(w, m)[near]
                    there = among(windows, g)
                    k = int(there.sum())
                    if k:
                        n += k
                        for column, values in zip(found, (np.full(k, m, np.int32), near[there].astype(np.int32), g[there].view(np.int64)), strict=True):
                            column.append(values)
                counts.append(len(w))
                ends.append(ends[-1] + n)
            parts = [pa.array(np.concatenate(c) if c else [], t.type) for c, t in zip(found, _CANDIDATE, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_CANDIDATE)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(counts, pa.int64()), lists], [*columns, "n_words", "candidates"])

    return run


def _digest() -> list:
    """128 bits of a text: what equal texts are told by."""
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2")]


def _judged(docs: DataFrame, benchmark: DataFrame, work: Workspace, columns: list[str]) -> DataFrame:
    """Rows with d1, d2, text -> their ``columns``, n_words, n_hit, items, contaminated."""
    index = Index(benchmark, work)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema if f.name not in ("d1", "d2")]
    scanned = work.table(docs.select(*columns, "text").mapInArrow(_scanned(index.bits, index.short, columns), ", ".join([*kinds, _SCANNED])), "scanned")
    # equal texts are one from here on, so a text with many copies is joined once
    text = ["d1", "d2"]
    c = scanned.select(*text, F.explode("candidates").alias("c")).select(*text, "c.*").distinct()
    matched = work.table(c.join(index.windows, ["m", "g"]), "matched")
    spans = matched.select(*text, "at", (F.col("at") + F.col("m")).alias("end"))
    earlier = W.partitionBy(*text).orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1)  # one text's windows
    fresh = F.greatest(F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(earlier), F.lit(0))), F.lit(0))
    hit = spans.withColumn("fresh", fresh).groupBy(*text).agg(F.sum("fresh").cast("long").alias("hit"))
    items = matched.select(*text, *CLASS).distinct().join(index.classes, CLASS).groupBy(*text).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = work.table(hit.join(items, text), "found")
    out = scanned.drop("candidates").join(found, text, "left")
    out = out.withColumn("n_hit", F.coalesce("hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(*columns, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) against (item_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is SPAN consecutive words of an item, or the whole of a shorter
    item that has words. A document word inside an occurrence of a window is
    hit; the document is contaminated if 20 * n_hit >= n_words > 0 and n_hit >
    0. Null and empty texts have no words and are never contaminated. Texts of
    any length are read whole. Rows of documents are independent: repeats and
    null ids pass through, and equal texts get equal results. Repeated items
    count once by id; an item whose id is null goes by the name "null". With an
    empty benchmark nothing is hit; an empty table gives none. Other columns
    are ignored. Windows are told apart by 64-bit, texts by 128-bit hashes.
    """
    work = Workspace(docs.sparkSession, "decontamination")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = _judged(rows.select("doc_id", "text", *_digest()), benchmark, work, ["doc_id", "d1", "d2"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Only the text of a row decides: repeated rows and null ids stay or go alike,
    null and empty texts stay. An empty table gives none, an empty benchmark all
    rows. Contaminated texts are few; their hashes are joined, no text is.
    """
    work = Workspace(docs.sparkSession, "decontamination")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    gone = _judged(rows.select("text", *_digest()), benchmark, work, ["d1", "d2"]).filter("contaminated").select("d1", "d2").distinct()
    gone = work.table(gone, "gone")
    same = (F.xxhash64(text) == gone["d1"]) & (F.xxhash64(F.lit("second"), text) == gone["d2"])
    return docs.join(gone, same, "left_anti")
