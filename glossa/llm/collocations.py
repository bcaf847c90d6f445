"""Phrase collocations: a minimal perfect hash over candidates, counts as numpy arrays by slot.

1. Candidates. Tasks count hashes of words and word pairs, then of phrases of
   three and four words all of whose pairs are frequent, up to the threshold;
   sums by hash are upper bounds of the phrases' counts, so that hashes that
   reach the threshold are a superset of the frequent phrases, and closed under
   taking parts (Apriori). Hashes are dealt into blocks by their value: a hash
   is one entry for each task, so that no word is hot.
2. A minimal perfect hash over the candidates, with their keys stored for
   verification. One has at most ``slots`` keys, so that what is broadcast is
   bounded; with more candidates there are several, by ranges of hashes, and
   one reading of the texts for each.
3. Counts. Tasks count the occurrences of verified candidates with ``bincount``
   in arrays by slot; what isn't zero is summed block by block in a tree of
   FAN tasks' arrays at a time.
4. Cuts. A phrase carries the hashes of its parts; their counts are read by
   slot.

Words and phrases are told apart by 96 bits of two independent hashes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.hashing import mix64, ngram_hashes
from glossa.llm.perfect_hash import PerfectHash, share
from glossa.llm.shared import Workspace, among, hash_bits, slices

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \x09"
LONGEST = 4
#: Keys of a perfect hash: 12 bytes each and half a byte for the hash, so some 52 MB are broadcast at most.
SLOTS = 1 << 22
#: Slots of a block of counts, and tasks whose arrays one step of the tree sums.
BLOCK = 1 << 16
FAN = 16
#: Hashes that a task holds before it sends them.
HELD = 1 << 22

_CHUNK, _LONG = 1 << 16, 1 << 12
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.full(_CHUNK + 1, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(_CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64))


class Scan:
    """A text's words: two hashes of each, the piece it is in, and where it lies."""

    def __init__(self, raw: bytes, tables: tuple[np.ndarray, np.ndarray]):
        self.raw = raw
        found, at, piece = [], 0, 0
        blank = raw.translate(_AS_BLANK)
        while at < len(raw):
            end = at + _CHUNK
            if end < len(raw):  # cut after a separator; a chunk without one is part of a long word
                cut = blank.rfind(b" ", at, end)
                end = cut + 1 if cut >= at else (blank.find(b" ", end) + 1 or len(raw))
            part, piece = self._part(at, min(end, len(raw)), piece, tables)
            found.append(part)
            at = end
        empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.key, self.check, self.piece, self.starts, self.ends = (np.concatenate(x) for x in zip(empty, *found, strict=True))

    def _part(self, low: int, high: int, piece: int, tables: tuple[np.ndarray, np.ndarray]):
        a = np.frombuffer(self.raw, np.uint8, high - low, low)
        kind = _KIND[a]
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = kind == 0
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        pieces = np.cumsum(kind == 2, dtype=np.int64)
        size = ends - starts
        hashes = []
        for table in tables:
            if len(a) > _CHUNK:  # one word and what is around it
                out, long = np.zeros(len(starts), np.uint64), np.arange(len(starts))
            else:
                sums = np.zeros(len(a) + 1, np.uint64)
                np.cumsum(table[a] * _POWERS[: len(a)], out=sums[1:])
                out, long = mix64((sums[ends] - sums[starts]) * _INVERSES[starts] + size.astype(np.uint64)), np.flatnonzero(size >= _LONG)
            seed = int(table[0]) & 0xFFFFFFFF
            for k in long.tolist():
                out[k] = xxhash.xxh64_intdigest(self.raw[low + int(starts[k]) : low + int(ends[k])], seed)
            hashes.append(out)
        return (*hashes, piece + pieces[starts], low + starts, low + ends), piece + int(pieces[-1])

    def together(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one piece."""
        m = len(self.piece) - n + 1
        return self.piece[:m] == self.piece[n - 1 :] if m > 0 else np.empty(0, bool)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)).decode("utf-8", "replace")


_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_AS_BLANK = bytes(32 if _KIND[b] else 97 for b in range(256))


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers for each byte, for two independent hashes."""
    rng = np.random.default_rng([20240611, seed])
    return tuple(rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


class Phrases:
    """The hashes of the phrases in texts of one language."""

    def __init__(self, lang: str, texts: list[bytes], tables: tuple[np.ndarray, np.ndarray]):
        self.lang = lang
        self.scan = Scan(b"\n".join(texts).lower(), tables)
        of = np.uint64(xxhash.xxh64_intdigest(lang))
        self.words = mix64(self.scan.key + of), mix64(self.scan.check + of)

    def __len__(self) -> int:
        return len(self.words[0])

    def keys(self, n: int) -> np.ndarray:
        return ngram_hashes(self.words[0], n)

    def checks(self, n: int) -> np.ndarray:
        return (ngram_hashes(self.words[1], n) >> np.uint64(32)).astype(np.uint32)


def _by_language(batch: pa.RecordBatch, tables) -> Iterator[Phrases]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        if text:
            texts.setdefault(lang, []).append(text)
    for lang, each in texts.items():
        yield Phrases(lang, each, tables)


def _summed(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) in order of keys, with their sums, no more than ``most``."""
    if not len(keys):
        return keys, checks, counts
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    if np.any((k[1:] == k[:-1]) & (c[1:] != c[:-1])):
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    total = np.minimum(np.add.reduceat(counts[order], first, dtype=np.int64), most)
    return k[first], c[first], total.astype(counts.dtype)


_SENT = "block int, lang string, words long, keys binary, checks binary, counts binary"


def _upper_counts(seed: int, orders: tuple[int, ...], blocks: int, floor: int, bits):
    """Texts -> hashes of their phrases with counts up to ``floor``, by block; with order 1 the number of words of each language too.

    With ``bits``, only phrases all of whose word pairs may be frequent.
    """
    small = np.uint8 if floor < 256 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size, words = _tables(seed), [], 0, {}

        def sent():
            keys, checks, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)), floor)
            held[:] = [(keys, checks, counts)]
            return len(keys)

        def rows():
            keys, checks, counts = held.pop()
            at = np.searchsorted(share(keys, blocks), np.arange(blocks + 1)).tolist()
            own = [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
            for part in (own[i : i + 64] for i in range(0, len(own), 64)):
                yield _record(_SENT, [(b, None, 0, keys[i:j].tobytes(), checks[i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in part])

        for batch in slices(batches):
            for phrases in _by_language(batch, tables):
                if 1 in orders:
                    words[phrases.lang] = words.get(phrases.lang, 0) + len(phrases)
                pairs = among(bits.value, phrases.keys(2)) & phrases.scan.together(2) if bits is not None and len(phrases) > 1 else None
                for n in orders:
                    stay = phrases.scan.together(n)
                    for k in range(n - 1) if pairs is not None and len(stay) else ():
                        stay = stay & pairs[k : k + len(stay)]
                    keys = phrases.keys(n)[stay]
                    if len(keys):
                        held.append(_summed(keys, phrases.checks(n)[stay], np.ones(len(keys), small), floor))
                        size += len(held[-1][0])
            if size > HELD:
                size = sent()
                if size > HELD // 2:
                    yield from rows()
                    size = 0
        if held:
            sent()
            yield from rows()
        if words:
            block = TaskContext.get().partitionId() % blocks
            yield _record(_SENT, [(block, lang, n, b"", b"", b"") for lang, n in words.items()])

    return run


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [name for name, _ in fields])


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _frequent(floor: int):
    """A block's hashes of all tasks -> those that reach the threshold; numbers of words pass through."""
    small = np.uint8 if floor < 256 else np.int32

    def run(sent: pa.Table) -> pa.Table:
        keys, checks, counts = _summed(_joined(sent["keys"], np.uint64), _joined(sent["checks"], np.uint32), _joined(sent["counts"], small).astype(np.int32), floor)
        stay = counts >= floor
        keys, checks = keys[stay].view(np.int64), checks[stay].astype(np.int64)
        told = sent.filter(pc.is_valid(sent["lang"])).select(["lang", "words"])
        nulls = pa.nulls(len(told), pa.int64())
        return pa.concat_tables([pa.table({"key": keys, "check": checks, "lang": pa.nulls(len(keys), pa.string()), "words": pa.nulls(len(keys), pa.int64())}), pa.table({"key": nulls, "check": nulls, "lang": told["lang"], "words": told["words"]})])

    return run


def _built(table: pa.Table) -> pa.Table:
    """The keys of one range -> their perfect hash, in numpy's format."""
    made = PerfectHash(table["key"].to_numpy().view(np.uint64), table["check"].to_numpy().astype(np.uint32))
    file = io.BytesIO()
    np.savez(file, sizes=np.array(made.sizes, np.int64), words=made.words, ranks=made.ranks, keys=made.keys, checks=made.checks)
    return pa.table({"part": table["part"].slice(0, 1), "hash": pa.array([file.getvalue()], pa.binary())})


def _loaded(raw: bytes) -> PerfectHash:
    out = PerfectHash.__new__(PerfectHash)
    arrays = np.load(io.BytesIO(raw))
    out.sizes = arrays["sizes"].tolist()
    out.words, out.ranks, out.keys, out.checks = (arrays[k] for k in ("words", "ranks", "keys", "checks"))
    return out


class Hashes:
    """Perfect hashes over a table (key, check), each over one range of hashes and of about ``slots`` keys at most."""

    def __init__(self, keys: DataFrame, work: Workspace, name: str, slots: int):
        self.spark = keys.sparkSession
        self.parts = max(1, math.ceil(keys.count() / (0.9 * slots)))
        part = F.shiftrightunsigned(F.shiftrightunsigned(F.col("key"), 32) * F.lit(self.parts), 32).cast("int")
        self.table = work.table(keys.withColumn("part", part).groupBy("part").applyInArrow(_built, "part int, hash binary"), name)
        self.bits = self.spark.sparkContext.broadcast(hash_bits(keys, "key"))

    def of(self, part: int):
        """One of them, broadcast; None if its range is empty."""
        row = self.table.filter(F.col("part") == part).first()
        return self.spark.sparkContext.broadcast(_loaded(bytes(row["hash"]))) if row else None


def _found(phrases: Phrases, bits: np.ndarray, parts: int, part: int, hashed: PerfectHash, shortest: int, closed: bool):
    """Occurrences of keys: (n, where they begin, their slots), with the hashes of all phrases by n.

    If the keys are ``closed`` under taking parts, a phrase is sought only where
    its two parts of one word less may be keys.
    """
    keys = {n: phrases.keys(n) for n in range(1, LONGEST + 1)}
    may = None
    for n in range(1, LONGEST + 1):
        if not len(keys[n]):
            break
        stay = phrases.scan.together(n)
        if closed and n > 1:
            stay = stay & may[:-1] & may[1:]
        if n >= shortest:
            at = np.flatnonzero(stay)
            hit = among(bits, keys[n][at])
            at = at[hit]
            may = np.zeros(len(stay), bool)
            may[at] = True
            at = at[share(keys[n][at], parts) == part]
            if len(at):
                slots = hashed.slots(keys[n][at], phrases.checks(n)[at])
                at, slots = at[slots >= 0], slots[slots >= 0]
                if len(at):
                    yield n, at, slots, keys


def _cut_places(n: int) -> list[tuple[int, int]]:
    """(length, offset) of the parts of a phrase: first part and rest of each cut, and what else it contains."""
    out = [x for k in range(1, n) for x in ((k, 0), (n - k, k))]
    return out + [(m, k) for m in range(2, n) for k in range(n - m + 1) if (m, k) not in out]


_COUNTED = "task int, part int, block int, lang string, n int, places binary, counts binary, hashes binary"
_GROUP = ("part", "block", "lang", "n")


def _counts(seed: int, hashes: Hashes, part: int, hashed):
    """Texts -> counts of the occurrences of each key by slot, in blocks, with the hashes of the key and of its parts."""
    bits, parts = hashes.bits, hashes.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, one = _tables(seed), hashed.value
        totals, seen = np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        met: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(batches):
            for phrases in _by_language(batch, tables):
                for n, at, slots, keys in _found(phrases, bits.value, parts, part, one, 1, True):
                    totals += np.bincount(slots, minlength=len(totals))
                    new = np.flatnonzero(~seen[slots])
                    slots, first = np.unique(slots[new], return_index=True)
                    if len(slots):
                        at = at[new[first]]
                        seen[slots] = True
                        met.setdefault((phrases.lang, n), []).append((slots, np.stack([keys[n][at], *(keys[m][at + k] for m, k in _cut_places(n))], axis=1)))
        task, rows = TaskContext.get().partitionId(), []
        for (lang, n), each in met.items():
            slots, own = (np.concatenate(x) for x in zip(*each, strict=True))
            order = np.argsort(slots)
            slots, own = slots[order], own[order]
            blocks, starts = np.unique(slots // BLOCK, return_index=True)
            for b, i, j in zip(blocks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(slots)], strict=True):
                rows.append((task, part, b, lang, n, (slots[i:j] % BLOCK).astype(np.uint16).tobytes(), totals[slots[i:j]].tobytes(), own[i:j].tobytes()))
        for i in range(0, len(rows), 16):
            yield _record(_COUNTED, rows[i : i + 16])

    return run


def _tree_step(table: pa.Table) -> pa.Table:
    """Arrays of a block from up to FAN tasks, summed by slot."""
    n = table["n"][0].as_py()
    totals, own, seen = np.zeros(BLOCK, np.int64), np.zeros((BLOCK, 1 + len(_cut_places(n))), np.uint64), np.zeros(BLOCK, bool)
    for places, counts, hashes in zip(*(table[c].to_pylist() for c in ("places", "counts", "hashes")), strict=True):
        at = np.frombuffer(places, np.uint16)
        totals[at] += np.frombuffer(counts, np.int64)
        own[at] = np.frombuffer(hashes, np.uint64).reshape(len(at), -1)
        seen[at] = True
    at = np.flatnonzero(seen)
    row = (table["task"][0].as_py() // FAN, *(table[c][0].as_py() for c in _GROUP), at.astype(np.uint16).tobytes(), totals[at].tobytes(), own[at].tobytes())
    return pa.Table.from_batches([_record(_COUNTED, [row])])


def _tree_sum(counted: DataFrame, tasks: int) -> DataFrame:
    """One row for each block, language and n: the sum of all tasks' arrays."""
    while True:
        counted = counted.groupBy(*_GROUP, F.floor(F.col("task") / FAN)).applyInArrow(_tree_step, _COUNTED)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return counted


_PHRASE = "lang string, n int, a long, hashes array<long>, values array<long>"


def _list(flat: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _opened(floor: int):
    """Blocks -> a row for each phrase of two words or more that reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["counts"], np.int64)
                stay = a >= floor
                if r["n"] < 2 or not stay.any():
                    continue
                own = np.frombuffer(r["hashes"], np.uint64).reshape(len(a), -1)[stay].view(np.int64)
                rows, wide = own.shape
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * rows, pa.string()), pa.array([r["n"]] * rows, pa.int32()), pa.array(a[stay]), _list(own.ravel(), wide), _list(np.full(own.size, -1), wide)], [x.split()[0] for x in _PHRASE.split(", ")])

    return run


def _by_slot(slots: int, rows: Iterator) -> np.ndarray:
    """The counts of one perfect hash, no more than its slots, from rows with block, places and counts."""
    out = np.zeros(slots, np.int64)
    for r in rows:
        out[r["block"] * BLOCK + np.frombuffer(r["places"], np.uint16).astype(np.int64)] = np.frombuffer(r["counts"], np.int64)
    return out


def _read_by_slot(parts: int, part: int, state):
    """Fills in the counts of those hashes that lie in one range, read by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, totals = state.value
        for batch in batches:
            hashes, values = batch.column("hashes"), batch.column("values")
            keys = hashes.flatten().to_numpy().view(np.uint64)
            out = values.flatten().to_numpy().copy()
            at = np.flatnonzero(share(keys, parts) == part)
            slots = hashed.slots(keys[at])
            out[at[slots >= 0]] = totals[slots[slots >= 0]]
            ends = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(), dtype=np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "n", "a", "hashes")), pa.ListArray.from_arrays(pa.array(ends), pa.array(out))], [x.split()[0] for x in _PHRASE.split(", ")])

    return run


def _spelled(seed: int, hashes: Hashes, part: int, hashed):
    """Texts -> the words of each key, once a task."""
    bits, parts = hashes.bits, hashes.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, one = _tables(seed), hashed.value
        seen = np.zeros(len(one), bool)
        for batch in slices(batches):
            rows = []
            for phrases in _by_language(batch, tables):
                for n, at, slots, keys in _found(phrases, bits.value, parts, part, one, 2, False):
                    new = np.flatnonzero(~seen[slots])
                    slots, first = np.unique(slots[new], return_index=True)
                    seen[slots] = True
                    rows += [(int(keys[n][i].view(np.int64)), phrases.scan.phrase(i, n)) for i in at[new[first]].tolist()]
            if rows:
                yield _record("key long, phrase string", rows)

    return run


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, most: int = 2000, floor: int = 30, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language.

    A-Z are lower-cased; words are parted by blanks and phrases by marks and
    line ends. A phrase of two to four words that occurs a >= ``floor`` times
    has the score floor(2000000 * a / (l + r)) at that cut into two parts, which
    occur l and r times, where it is least, the leftmost among equals. Phrases
    within a longer one of 0.8 of their count or more are left out. n is the
    number of words of the language. Order: score and a descending, phrase by
    bytes.

    A null lang is ``und``, a null text empty; texts of any length are read
    whole; repeated rows count each; other columns are ignored; an empty table,
    or one without frequent phrases, gives none. Ties in score and count are
    all held until their phrases are read. ``seed`` varies the hashes: two
    candidates with equal 64-bit hashes end the job, and need another one.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "collocations")
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    tasks = source.rdd.getNumPartitions()
    # a block's share of all hashes is about what a task sends
    blocks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def frequent(sent: DataFrame, name: str) -> DataFrame:
        return work.table(sent.groupBy("block").applyInArrow(_frequent(floor), "key long, check long, lang string, words long"), name)

    short = frequent(source.mapInArrow(_upper_counts(seed, (1, 2), blocks, floor, None), _SENT), "short")
    low = short.filter("key is not null").select("key", "check")
    words = short.filter("lang is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    bits = spark.sparkContext.broadcast(hash_bits(low, "key"))
    high = frequent(source.mapInArrow(_upper_counts(seed, (3, 4), blocks, floor, bits), _SENT), "long")
    candidates = low.unionByName(high.select("key", "check"))

    hashes = Hashes(candidates, work, "hashes", slots)
    parts = {k: h for k in range(hashes.parts) if (h := hashes.of(k)) is not None}
    sums = {}
    for k, hashed in parts.items():
        sums[k] = work.table(_tree_sum(source.mapInArrow(_counts(seed, hashes, k, hashed), _COUNTED), tasks), f"sums{k}")
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not sums:
        return spark.createDataFrame([], schema)
    phrases = None
    for each in sums.values():
        rows = each.mapInArrow(_opened(floor), _PHRASE)
        phrases = rows if phrases is None else phrases.unionByName(rows)
    for k, hashed in parts.items():
        totals = _by_slot(len(hashed.value), sums[k].select("block", "places", "counts").toLocalIterator())
        phrases = phrases.mapInArrow(_read_by_slot(hashes.parts, k, spark.sparkContext.broadcast((hashed.value, totals))), _PHRASE)
    # the first hash is the phrase's own, then come first part and rest of each cut
    value = lambda k: F.get("values", k).cast("decimal(20,0)")
    score = lambda k: F.call_function("div", F.lit(2_000_000).cast("decimal(20,0)") * _exact("a"), value(2 * k - 1) + value(2 * k))
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(score(k).alias("score"), k.alias("k")))
    phrases = work.table(phrases.withColumn("cut", F.array_min(cuts)), "phrases")
    inside = phrases.filter("n > 2").select("a", "n", F.posexplode("hashes").alias("at", "key"))
    longer_part = " or ".join(f"(n = {n} and at in ({', '.join(str(1 + i) for i, (m, _) in enumerate(_cut_places(n)) if m > 1)}))" for n in range(3, LONGEST + 1))
    inside = inside.filter(longer_part).groupBy("key").agg(F.max("a").alias("longer"))
    at = lambda k: F.get("values", F.col("cut.k") * 2 + k)
    free = phrases.withColumn("key", F.get("hashes", F.lit(0))).join(inside, "key", "left").filter(F.coalesce(100 * _exact("longer") < 80 * _exact("a"), F.lit(True)))
    free = free.select("lang", "key", "a", at(-1).alias("l"), at(0).alias("r"), F.col("cut.score").alias("score"))
    # the best of each share of a language, then of the language: no language meets in one task before
    best = [F.desc("score"), F.desc("a")]
    for by in (["lang", F.pmod("key", F.lit(max(64, blocks)))], ["lang"]):
        free = free.withColumn("place", F.rank().over(W.partitionBy(*by).orderBy(*best))).filter(F.col("place") <= most)
    top = work.table(free.drop("place"), "top")

    spelled, wanted = None, Hashes(top.join(candidates, "key").select("key", "check"), work, "wanted", slots)
    for k in range(wanted.parts):
        if (hashed := wanted.of(k)) is not None:
            rows = source.mapInArrow(_spelled(seed, wanted, k, hashed), "key long, phrase string")
            spelled = rows if spelled is None else spelled.unionByName(rows)
    if spelled is None:
        return spark.createDataFrame([], schema)
    named = top.join(spelled.groupBy("key").agg(F.min("phrase").alias("phrase")), "key")
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).filter(F.col("rank") <= most)
    return work.table(ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "result")
