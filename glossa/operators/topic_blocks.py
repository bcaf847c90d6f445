"""Counts of labelled documents in packed blocks, for ``models.labeled_topics`` (K1).

A block has documents of one label set. Its rows are messages, one for each part
of the words (by a hash), with the block's words of that part in order and a
number for each label and word; and its documents in pieces, where a word is
its place among the block's words. Numbers and words are compressed, so what is
shuffled in a step is a few bytes for each word of a block and each word of a
document, and a task has one block or one part of the words in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of a block and counts of a piece of its documents, at most but for the last document.
TOKENS, COUNTS = 1 << 22, 1 << 18

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Row = tuple[int, int, list[str], bytes | None, bytes, list | None]


def columns(doc: str) -> str:
    """Schema of a block's rows: messages have a part from 0 and words, shares of documents and then their counts the parts from ``parts`` in turn."""
    return f"_block long, _part int, _labels array<string>, _words binary, _data binary, _docs array<{doc}>"


def _zipped(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first bytes of all numbers before the second ones: numbers of a kind compress better so."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), a.size)]], np.int64).tobytes()
    return len(head + body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(head + body, asbytes=True)


def _unzipped(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    heads, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2), 8 + 16 * count, []
    for kind, size in heads.tolist():
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def _of_words(words: list[str]) -> bytes:
    said = [w.encode() for w in words]
    return _zipped(np.array([len(w) for w in said], np.int32), np.frombuffer(b"".join(said), np.uint8))


def _words_of(data: bytes) -> pa.Array:
    size, body = _unzipped(data)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(body.tobytes()))


def _rows(batches: Iterator[pa.RecordBatch], kind: list[pa.DataType]) -> Iterator[Row]:
    for b in batches:
        kind[:] = [b.schema.field(b.num_columns - 1).type]
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in b.columns)


def _batch(rows: list[Row], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), kind)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["_block", "_part", "_labels", "_words", "_data", "_docs"])


def packed(parts: int, alpha: float) -> Run:
    """Blocks of rows (block, labels, document, its words) in this order; equal documents of a block are one. Words are shared evenly among the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        key, kind = None, pa.list_(pa.int64())
        vocabulary: dict[str, int] = {}
        docs: list = []
        found: list[tuple[np.ndarray, np.ndarray]] = []  # place of a token's document, its word
        tokens = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block, tokens
            labels, size, names = key[1], len(vocabulary), pa.array(list(vocabulary), pa.string())
            part = np.array([zlib.crc32(w.encode()) % parts for w in vocabulary], np.int32)
            order = pc.sort_indices(pa.table({"p": part, "w": names}), [("p", "ascending"), ("w", "ascending")]).to_numpy()
            place = np.empty(size, np.int64)
            place[order] = np.arange(size)
            counts, n = np.unique(np.concatenate([d * size + place[w] for d, w in found]), return_counts=True)
            of, w = np.divmod(counts, size)
            even = np.bincount(w, n, size) / len(labels)
            starts, names = np.searchsorted(part[order], np.arange(parts + 1)), names.take(pa.array(order))
            for p in range(parts):
                a, z = starts[p : p + 2]
                yield _batch([(block, p, labels, _of_words(names[a:z].to_pylist()), _zipped(np.tile(even[a:z], len(labels))), None)], kind)
            ends, first, k = np.searchsorted(of, np.arange(len(docs) + 1)), 0, parts
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + COUNTS, "right")) - 1)
                a, z = ends[first], ends[last]
                all_ = np.add.reduceat(n[a:z], ends[first:last] - a) if z > a else np.zeros(0)
                share = np.repeat((all_ / len(labels) + alpha) / (all_ + alpha * len(labels)), len(labels))
                yield _batch([(block, k, labels, None, _zipped(share), docs[first:last]), (block, k + 1, labels, None, _zipped(np.diff(ends[first : last + 1]).astype(np.int32), np.diff(w[a:z], prepend=0).astype(np.int32), n[a:z].astype(np.int32)), None)], kind)
                first, k = last, k + 2
            block, tokens = block + 1, 0
            vocabulary.clear(), docs.clear(), found.clear()

        for b in batches:
            kind = pa.list_(b.schema.field(2).type)
            b = b.filter(pc.greater(pc.list_value_length(b.column(3)), 0))
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            ids, lengths = b.column(2).to_pylist(), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            at, full = 0, np.cumsum(lengths)
            while at < len(keys):
                end = at + 1
                if docs and (keys[at] != key or tokens >= TOKENS and ids[at] != docs[-1]):
                    yield from closed()
                key, room = keys[at], TOKENS - tokens + full[at] - lengths[at]
                while end < len(keys) and keys[end] == key and (full[end - 1] < room or ids[end] == ids[end - 1]):
                    end += 1
                said = b.column(3).slice(at, end - at).flatten().dictionary_encode()
                known = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in said.dictionary.to_pylist()], np.int64)
                place = []
                for x in ids[at:end]:
                    if not docs or docs[-1] != x:
                        docs.append(x)
                    place.append(len(docs) - 1)
                found.append((np.repeat(np.array(place, np.int64), lengths[at:end]), known[said.indices.to_numpy()].astype(np.int32)))
                tokens, at = tokens + int(lengths[at:end].sum()), end
        if docs:
            yield from closed()

    return run


def _met(members: list[Row]) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of one part's messages: its words, the labels, (word, label) as one number, of each number of the messages which of these it adds to, and the sums."""
    words = pa.chunked_array([_words_of(m[3]) for m in members]).combine_chunks().dictionary_encode()
    labels = {x: k for k, x in enumerate(sorted({x for m in members for x in m[2]}))}
    numbers = [_unzipped(m[4])[0] for m in members]
    code, keys, at = words.indices.to_numpy().astype(np.int64), [], 0
    for m, x in zip(members, numbers, strict=True):
        size = len(x) // len(m[2])
        keys += [code[at : at + size] * len(labels) + labels[y] for y in m[2]]
        at += size
    pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
    return words.dictionary, list(labels), pairs, which, np.bincount(which, np.concatenate(numbers), len(pairs)).astype(np.float64)  # of nothing, the counts are integers


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages, by part: the numbers of all blocks summed for each label and word, with the label's sum over the part and the part's number of words."""
    kind: list[pa.DataType] = []
    for _, members in groupby(_rows(batches, kind), lambda r: r[1]):
        words, labels, pairs, which, sums = _met(members := list(members))
        total, at = dict(zip(labels, np.bincount(pairs % max(1, len(labels)), sums, len(labels)), strict=True)), 0
        for b, p, own, said, data, _ in members:
            size = _unzipped(data)[0].size
            yield _batch([(b, p, own, said, _zipped(sums[which[at : at + size]], np.array([total[x] for x in own]), np.array([len(words)], np.int64)), None)], kind[0])
            at += size


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages, by part, to label, word and sum."""
    for _, members in groupby(_rows(batches, []), lambda r: r[1]):
        words, labels, pairs, _, sums = _met(list(members))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()).take(pa.array(pairs % max(1, len(labels)))), words.cast(pa.string()).take(pa.array(pairs // max(1, len(labels)))), pa.array(sums)], ["l", "w", "c"])


def stepped(parts: int, alpha: float, eta: float) -> Run:
    """Blocks' rows, with ``summed`` messages, by block and part: a document's words shared anew among its labels, as new messages and shares of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []
        for block, members in groupby(_rows(batches, kind), lambda r: r[0]):
            told, p, mine, share, labels = [], None, None, None, []
            for _, part, labels, said, data, ids in members:
                if part < parts:
                    told.append((said, *_unzipped(data)))
                    continue
                if p is None:
                    n = len(labels)
                    sums = np.concatenate([x[1].reshape(n, -1) for x in told], axis=1)
                    p = (sums + eta) / (sum(x[2] for x in told) + eta * sum(int(x[3][0]) for x in told))[:, None]
                    mine, sums = np.zeros_like(p), None
                if (part - parts) % 2 == 0:
                    share, docs = _unzipped(data)[0].reshape(-1, len(labels)), ids
                    continue
                size, w, n = _unzipped(data)
                of, w = np.repeat(np.arange(len(size)), size), np.cumsum(w, dtype=np.int64)
                q = p[:, w] * share.T[:, of]
                q *= n / q.sum(axis=0)
                for x, y in zip(mine, q, strict=True):
                    x += np.bincount(w, y, len(x))
                c = np.stack([np.bincount(of, y, len(size)) for y in q], axis=1)
                share = (c + alpha) / (c.sum(axis=1, keepdims=True) + alpha * len(labels))
                yield _batch([(block, part - 1, labels, None, _zipped(share.reshape(-1)), docs)], kind[0])
            at = 0
            for part, x in enumerate(told):
                size = x[1].size // len(labels)
                yield _batch([(block, part, labels, x[0], _zipped(mine[:, at : at + size].reshape(-1)), None)], kind[0])
                at += size

    return run


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of documents to document, label, share."""
    kind: list[pa.DataType] = []
    for _, _, labels, _, data, docs in _rows(batches, kind):
        out = [pa.array(docs, kind[0].value_type).take(pa.array(np.repeat(np.arange(len(docs)), len(labels)))), pa.array(labels * len(docs), pa.string()), pa.array(_unzipped(data)[0])]
        yield pa.RecordBatch.from_arrays(out, ["d", "l", "share"])
