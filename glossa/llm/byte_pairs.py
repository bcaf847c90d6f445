"""Byte-level BPE over a table of distinct words.

Texts are dealt into slices, and split into words as the vocabulary's library
splits them. A slice sends each of its distinct words once, with its number in
the slice, to the words' buckets; there each distinct word of the corpus is
encoded once, and its ids go back to the slices. Texts go as the numbers of
their words, one to three bytes each, and the ids are joined back by these
positions. Decoding is a join of ids with the table id -> piece, whose size is
that of the vocabulary.

A word in a third of all texts is one row for each slice; a bucket or a slice
never holds more than its share, as buckets are taken from hashes of words and
grow in number with the shuffle partitions.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import slices

#: Bytes of text in a slice; a text above that is a slice by itself.
SLICE = 48 << 20
#: Rows of a slice.
ROWS = 1 << 17
#: Words above this many bytes are merged by a heap.
LONG = 48
#: Words of one length that are merged in one table.
TABLE = 8192
#: Buckets of words for each shuffle partition.
BUCKETS = 4
#: Code points below this are classed one by one as the library classes them; texts with others are split by it.
KNOWN = 0x3100
_NEVER = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _class(characters: list[str]) -> str:
    """Characters as ranges for a pattern's class."""
    points, out = sorted(map(ord, characters)), []
    breaks = [0, *(k for k in range(1, len(points)) if points[k] != points[k - 1] + 1), len(points)]
    for a, b in zip(breaks, breaks[1:], strict=False):
        out.append(f"{re.escape(chr(points[a]))}-{re.escape(chr(points[b - 1]))}")
    return "".join(out)


class BytePairs:
    """A byte-level BPE vocabulary: its words, merges and pieces."""

    def __init__(self, path: str, check: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is needed")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they are")
        self.check, characters = check, byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in characters]
        #: Pair -> rank and merged id, in one number, the rank first.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]
        pairs = sorted((a << 32 | b, x) for (a, b), x in self.merges.items())
        self.pair_keys, self.pair_values = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.byte_pairs = self._merged(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.added.values()]) + 1
        #: The id-to-piece table.
        self.pieces = [b""] * n
        for piece, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.added.items():
            self.pieces[i] = piece.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.split = re.compile(self._pattern()).findall
        self.foreign = re.compile(f"[{chr(KNOWN)}-\U0010ffff]")

    def _pattern(self) -> str:
        """The words of byte-level vocabularies as a pattern over classes of code points below KNOWN, as the library has them."""
        letters, numbers, blanks = [], [], [" "]
        for c in map(chr, range(KNOWN)):
            first = self._library_split(f"a{c}1{c}!{c}a") if c != " " else []
            if first and first[0] == f"a{c}":
                letters.append(c)
            elif any(f"1{c}" in w for w in first):
                numbers.append(c)
            elif first and not any(f"!{c}" in w for w in first):
                blanks.append(c)
        n, s, x = _class(numbers), _class(blanks), _class(letters)
        # tried in another order than the vocabulary's: a letter or a space begins none of the forms with a quote
        return f" ?[{x}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{n}]+| ?[^{s}{x}{n}]+|[{s}]+(?![^{s}])|[{s}]+"

    def _library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; an added token is a word. Joined, they are the text.

        Letters, numbers and blanks are those of the library's Unicode tables;
        texts with code points beyond KNOWN are split by the library itself.
        """
        split = self._library_split if self.foreign.search(text) else self.split
        if self.special is None or not self.special.search(text):
            return split(text)
        return [w for k, part in enumerate(self.special.split(text)) if part for w in ([part] if k % 2 else split(part))]

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair in one number, _NEVER where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], _NEVER)

    def _by_table(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length, a merge of each of them at a time, so that they stay of one length until they are done."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids, ranks = self.byte_ids[raw], self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        out: list[list[int]] = [[]] * len(words)
        place = np.arange(len(words))
        while len(place):
            best = ranks.min(1, initial=_NEVER)
            done = best == _NEVER
            for k, found in zip(place[done].tolist(), ids[done].tolist(), strict=True):
                out[k] = found
            place, ids, ranks, best = place[~done], ids[~done], ranks[~done], best[~done]
            if not len(place):
                break
            row, at, width = np.arange(len(place)), ranks.argmin(1), ids.shape[1]
            ids[row, at] = best & 0xFFFFFFFF
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(place), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(place), width - 2)
            for has, left in ((at > 0, at - 1), (at < width - 2, at)):
                r, c = row[has], left[has]
                ranks[r, c] = self._merged(ids[r, c], ids[r, c + 1])
        return out

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := merges.get((ids[a], ids[b]))) is not None:
                heapq.heappush(agenda, (m >> 32, a, b, ids[a], ids[b]))

        for k in range(n - 1):
            add(k, k + 1)
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or (ids[a], ids[b]) != (x, y):
                continue
            ids[a], alive[b], after[a] = merges[x, y] & 0xFFFFFFFF, False, after[b]
            if after[a] < n:
                before[after[a]] = a
            add(before[a], a)
            add(a, after[a])
        return [i for i, lives in zip(ids, alive, strict=True) if lives]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, held against the library's: of adjacent pairs, that of least rank merges first, the leftmost among equals."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, (word, x) in enumerate(zip(words, raw, strict=True)):
            if word in self.added:
                out[k] = [self.added[word]]
            elif len(x) > LONG:
                out[k] = self._by_heap([self.byte_id[b] for b in x])
            elif x:
                by_length.setdefault(len(x), []).append(k)
        for places in by_length.values():
            for a in range(0, len(places), TABLE):
                part = places[a : a + TABLE]
                for k, ids in zip(part, self._by_table([raw[k] for k in part]), strict=True):
                    out[k] = ids
        if self.check:
            for word, ours, theirs in zip(words, out, self.library.encode_batch(words, add_special_tokens=False), strict=True):
                if ours != theirs.ids:
                    raise RuntimeError(f"the merges disagree with the library on {word!r}")
        return out

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words([word])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: their pieces' bytes, end to end; what is no UTF-8 is replaced."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_VOCABULARIES: dict[str, BytePairs] = {}


def _vocabulary(path: str) -> BytePairs:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = BytePairs(path)
    return _VOCABULARIES[path]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^28 in one to four bytes each, of seven bits, the last byte of each with its high bit unset."""
    x = numbers.astype(np.uint32)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    out[ends - 1] = x & 127
    for k in range(1, 4):
        has = size > k
        out[ends[has] - 1 - k] = (x[has] >> np.uint32(7 * k)) & 127 | 128
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """What ``pack`` packed."""
    a = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(a < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = a[ends].astype(np.int64)
    for k in range(1, 4):
        has = ends - starts >= k
        out[has] |= (a[ends[has] - k].astype(np.int64) & 127) << (7 * k)
    return out


_SLICE = "part int, seq int, mark long"
_DOCS = f"{_SLICE}, doc_id long, places binary"
_WORDS = f"{_SLICE}, bucket int, numbers binary, sizes binary, words binary"
_IDS = f"{_SLICE}, numbers binary, sizes binary, ids binary"
_RESULT = "doc_id long, ids array<int>, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(fields)], [name for name, _ in fields])


def _in_buckets(number: dict[str, int], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, numbers, sizes, words) of a slice's words, packed; numbers as steps from one to the next."""
    raw = [w.encode() for w in number]
    bucket = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    kinds, starts = np.unique(bucket[order], return_index=True)
    for b, at in zip(kinds.tolist(), np.split(order, starts[1:]), strict=True):
        words = [raw[k] for k in at.tolist()]
        yield b, pack(np.diff(at, prepend=0)), pack(np.fromiter(map(len, words), np.int64, len(words))), b"".join(words)


def _split(path: str, buckets: int, want_words: bool):
    """Texts -> the words of each slice by bucket, or each text as its words' numbers.

    A slice is named by its partition, its place there and a hash of its texts,
    so that both readings of the input must agree on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part = _vocabulary(path), TaskContext.get().partitionId()
        number: dict[str, int] = {}
        ids, places, mark, size, rows, seq = [], [], xxhash.xxh64(), 0, 0, 0

        def ended() -> Iterator[pa.RecordBatch]:
            key = (part, seq, mark.intdigest() - (1 << 63))
            if not want_words:
                for a in range(0, len(ids), 1024):
                    yield _table(_DOCS, [(*key, *x) for x in zip(ids[a : a + 1024], places[a : a + 1024], strict=True)])
            elif number:
                yield _table(_WORDS, [(*key, *x) for x in _in_buckets(number, buckets)])

        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            more = sum(map(len, texts))
            if rows and (size + more > SLICE or rows + len(texts) > ROWS):
                yield from ended()
                number, ids, places, mark, size, rows, seq = {}, [], [], xxhash.xxh64(), 0, 0, seq + 1
            size, rows = size + more, rows + len(texts)
            for text in texts:
                mark.update(text.encode())
                mark.update(b"\xff")
                words = vocabulary.words(text)
                for w in dict.fromkeys(words):
                    if w not in number:
                        number[w] = len(number)
                if not want_words:
                    places.append(pack(np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
            if not want_words:
                ids += batch.column("doc_id").to_pylist()
        if rows:
            yield from ended()

    return run


def _parts(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _encoded(path: str):
    """Words of the buckets, sorted by bucket -> the ids of each slice's words; each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, bucket, known = _vocabulary(path), None, {}
        for batch in slices(batches, 4096, 16 << 20):
            rows, words = batch.to_pylist(), []
            fresh: dict[int, dict[bytes, None]] = {}
            for r in rows:
                words.append(_parts(r["words"], unpack(r["sizes"])))
                have = known if r["bucket"] == bucket else {}
                fresh.setdefault(r["bucket"], {}).update((w, None) for w in words[-1] if w not in have)
            # the new words of all these rows in one go: tables are for many words
            new = [(b, w) for b, each in fresh.items() for w in each]
            found: dict[int, dict[bytes, tuple[int, bytes]]] = {bucket: known}
            for (b, w), ids in zip(new, vocabulary.encode_words([w.decode() for _, w in new]), strict=True):
                found.setdefault(b, {})[w] = (len(ids), ids)
            out = []
            for r, own in zip(rows, words, strict=True):
                of = found.get(r["bucket"], {})
                each = [of[w] for w in own]
                out.append((r["part"], r["seq"], r["mark"], r["numbers"], pack(np.array([n for n, _ in each])), pack(np.fromiter(chain.from_iterable(x for _, x in each), np.int64))))
            if rows:
                yield _table(_IDS, out)
                bucket = rows[-1]["bucket"]
                known = found.get(bucket, {})

    return run


def _assembled(path: str, keep_ids: bool):
    """The texts of a slice and the ids of its words -> ids by position, and what they decode to."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        pieces, found = _vocabulary(path).pieces, {}
        for numbers, sizes, ids in zip(*(words.column(c).to_pylist() for c in ("numbers", "sizes", "ids")), strict=True):
            flat, ends = unpack(ids).tolist(), np.cumsum(unpack(sizes)).tolist()
            for k, a, b in zip(np.cumsum(unpack(numbers)).tolist(), [0, *ends], ends, strict=False):
                found[k] = flat[a:b]
        if sorted(found) != list(range(len(found))):
            raise RuntimeError("some words of a slice are missing: the input was read twice and differs, write it first")
        listed = [found[k] for k in range(len(found))]
        counts = np.fromiter(map(len, listed), np.int64, len(listed))
        decimal = [",".join(map(str, x)) for x in listed]
        # ids and pieces are joined once for each word of the slice: a text's bytes are those of its words
        spelled = [b"".join(map(pieces.__getitem__, x)) for x in listed]
        rows = []
        for doc_id, places in zip(texts.column("doc_id").to_pylist(), texts.column("places").to_pylist(), strict=True):
            at = unpack(places)
            if len(at) and int(at.max()) >= len(listed):
                raise RuntimeError("a slice has words of another: the input was read twice and differs, write it first")
            n, at = int(counts[at].sum()), at.tolist()
            text = b"".join(map(spelled.__getitem__, at)).decode("utf-8", "replace")
            if keep_ids:
                rows.append((doc_id, [i for k in at for i in listed[k]], text))
            else:
                rows.append((doc_id, n, hashlib.sha256(",".join(map(decimal.__getitem__, at)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return pa.Table.from_batches([_table(_RESULT if keep_ids else _DIGESTS, rows)])

    return run


def encode_and_decode_words(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` doc_id, ids, decoded.

    Ids are the library's, without added begin or end tokens; strings of added
    tokens in a text are these tokens. A null text is as an empty one: no ids,
    decoded to the empty text. Rows are independent, so repeated rows and null
    ids pass through; other columns are ignored; an empty table gives none.

    The input is read twice and must then give equal partitions, as tables on
    disk do; a slice that differs ends the job. A worker holds a slice (48 MB of
    text, or one text above that) with its distinct words, or a bucket's
    distinct words.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = source.mapInArrow(_split(path, buckets, True), _WORDS)
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(path), _IDS)
    texts = source.mapInArrow(_split(path, buckets, False), _DOCS)
    keys = ["part", "seq", "mark"]
    return texts.groupBy(*keys).cogroup(ids.groupBy(*keys)).applyInArrow(_assembled(path, keep_ids), _RESULT if keep_ids else _DIGESTS)
