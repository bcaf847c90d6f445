"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they merge into, leftmost first among equals, and merges the best pair
until no pair is a piece. Two forms of the agenda give the same pieces:

* short fragments: a table of many fragments at once, each step of which merges
  the best pair of every fragment (numpy, no loop over symbols);
* long fragments: a heap over a linked list of symbols.

A text is cut into fragments where no piece of the vocabulary can span the cut,
so fragments are encoded once and remembered. Each new fragment is checked
against the sentencepiece library before it is used, and decoded texts are
checked batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import slices

SPACE = "▁"
#: Marks a fragment that follows no space of its own.
PLAIN = "\x01"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
#: Fragments above this many characters go to the heap.
LONG = 64
#: Fragments in a table: about what a core's cache holds.
TABLE = 8_000
_NEVER = np.int64(1 << 38)


class PieceModel:
    """The vocabulary of a merge-type model and its two codecs."""

    def __init__(self, path: str, cache_limit: int = 150_000, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check, self.cache_limit = check, cache_limit
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback or {_USER, _UNUSED} & set(kinds):
            raise ValueError("a BPE model with byte fallback, an identity normaliser and a dummy prefix is needed")
        pieces = [p.piece for p in proto.pieces]
        self.symbol = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == _BYTE}
        self.n_pieces = len(pieces)
        for c in sorted({c for p in self.symbol for c in p} - self.symbol.keys()):
            self.symbol[c] = len(self.symbol) + self.n_pieces
        whole = {p: i for p, i in self.symbol.items() if i < self.n_pieces and len(p) > 1}
        order = {s: r for r, s in enumerate(sorted({-proto.pieces[i].score for i in whole.values()}))}
        self.rank = np.full(self.n_pieces, _NEVER, np.int64)
        for i in whole.values():
            self.rank[i] = order[-proto.pieces[i].score]
        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in whole.items():
            for k in range(1, len(p)):
                if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None:
                    self.pairs[a, b] = i
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        at = np.argsort(keys)
        self._table(keys[at], np.array(list(self.pairs.values()), np.int64)[at])
        # a cut before a space is safe if no piece has a space after another character
        if any(SPACE in p.lstrip(SPACE) for p in whole):
            raise ValueError("pieces span words")
        self.line_cut = not any("\n" in p for p in whole)
        self.char_symbol = np.full(0x110000, -1, np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i
        self.surface = [b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.code = np.dtype(np.uint16 if self.n_pieces <= 1 << 16 else np.uint32)
        self.ids_of: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(self.n_pieces)]

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs."""
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int64)
        left, step, self.probes = np.arange(len(keys)), 0, 0
        home = self._home(keys)
        while len(left):
            at = (home[left] + step) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            take = first[free[first]]
            self.slots[at[take]], self.merged[at[take]] = keys[left[take]], values[left[take]]
            left = np.delete(left, take)
            step += 1
        self.probes = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair merges into, or -1."""
        keys = a << 32 | b
        at = self._home(np.where((a < 0) | (b < 0), 0, keys))
        out = np.full(len(a), -1, np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            here = self.slots[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[~hit & (here >= 0)]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        return out

    def _agenda_table(self, fragments: list[str]) -> list[bytes]:
        points = np.frombuffer("".join(fragments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(f) for f in fragments])
        word = np.repeat(np.arange(len(fragments)), lengths)
        sym, origin = self.char_symbol[points], np.arange(len(points))
        best = np.full(len(points), _NEVER, np.int64)
        into = np.full(len(points), -1, np.int64)

        def score(at: np.ndarray) -> None:
            into[at] = m = self._merge_of(sym[at], sym[at + 1])
            best[at] = np.where(m >= 0, self.rank[np.maximum(m, 0)], _NEVER)

        score(np.flatnonzero(word[1:] == word[:-1]))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        while len(sym):
            low = np.minimum.reduceat(best << 24 | np.arange(len(best)), starts)
            more = low < _NEVER << 24
            if not more.all():
                stay = np.repeat(more, np.diff(np.r_[starts, len(word)]))
                done.append((word[~stay], sym[~stay], origin[~stay]))
                low = low[more] - (np.cumsum(~stay)[low[more] & 0xFFFFFF])
                sym, word, origin, best, into = (x[stay] for x in (sym, word, origin, best, into))
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            at = low & 0xFFFFFF
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fewer = np.arange(len(at))  # each earlier fragment has lost one symbol
            at, starts = at - fewer, starts - fewer
            sym, word, origin, best, into = (x[keep] for x in (sym, word, origin, best, into))
            best[at] = _NEVER
            score(at[(at + 1 < len(sym)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])])
            score(at[at > starts] - 1)
        word, sym, origin = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(origin)
        word, sym, origin = word[order], sym[order], origin[order]
        bounds = (np.searchsorted(word, np.arange(len(fragments) + 1)) * self.code.itemsize).tolist()
        raw = (sym < 0) | (sym >= self.n_pieces)
        packed = sym.astype(self.code).tobytes()
        out = [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for f in set(word[raw].tolist()):
            own = range(*(x // self.code.itemsize for x in bounds[f : f + 2]))
            out[f] = self._pack([x for k in own for x in (self._bytes(chr(points[origin[k]])) if raw[k] else (sym[k],))])
        return out

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.code).tobytes()

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id[x] for x in char.encode("utf-8", "surrogatepass")]

    def _agenda_heap(self, fragment: str) -> bytes:
        sym = [self.symbol.get(c, -1) for c in fragment]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := self.pairs.get((sym[a], sym[b]))) is not None:
                heapq.heappush(agenda, (int(self.rank[m]), a, b, sym[a], sym[b]))

        for k in range(n - 1):
            add(k, k + 1)
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or (sym[a], sym[b]) != (x, y):
                continue
            sym[a], alive[b], after[a] = self.pairs[x, y], False, after[b]
            if after[a] < n:
                before[after[a]] = a
            add(before[a], a)
            add(a, after[a])
        return self._pack([x for k in range(n) if alive[k] for x in ((sym[k],) if 0 <= sym[k] < self.n_pieces else self._bytes(fragment[k]))])

    def encode_fragments(self, fragments: list[str]) -> list[bytes]:
        """Packed ids of fragments, in which a space is SPACE; no prefix is added."""
        out = [b""] * len(fragments)
        short = [k for k, f in enumerate(fragments) if 0 < len(f) <= LONG]
        short.sort(key=lambda k: len(fragments[k]))  # equal lengths end together
        for a in range(0, len(short), TABLE):
            part = short[a : a + TABLE]
            for k, ids in zip(part, self._agenda_table([fragments[k] for k in part]), strict=True):
                out[k] = ids
        for k, f in enumerate(fragments):
            if len(f) > LONG:
                out[k] = self._agenda_heap(f)
        if self.check and fragments:
            self._compare(fragments, out)
        return out

    def _compare(self, fragments: list[str], ours: list[bytes]) -> None:
        """The library adds a prefix of its own: a fragment's own first space stands for it, else a line break divides them."""
        cut = 1 + len(self._bytes("\n"))
        own = [f[0] == SPACE and len(f) > 1 for f in fragments]
        given = [f[1:].replace(SPACE, " ") if x else "\n" + f.replace(SPACE, " ") for f, x in zip(fragments, own, strict=True)]
        theirs = [ids if x else ids[cut:] for ids, x in zip(self.library.encode(given, num_threads=1), own, strict=True)]
        size = self.code.itemsize
        if [len(x) for x in ours] != [len(x) * size for x in theirs] or b"".join(ours) != np.fromiter(chain.from_iterable(theirs), self.code).tobytes():
            wrong = next(f for f, x, y in zip(fragments, ours, theirs, strict=True) if x != self._pack(y))
            raise RuntimeError(f"the agenda disagrees with the library on {wrong!r}")

    def fragments(self, text: str) -> list[str]:
        """Words of a text; each follows a space, but for those that begin with PLAIN."""
        text = text.replace(SPACE, " ")
        if "  " in text or PLAIN in text or text[0] == " " or text[-1] == " ":
            return [PLAIN + x for x in re.findall("\n| +[^ \n]*|[^ \n]+" if self.line_cut else " +[^ ]*|[^ ]+", " " + text)]
        return (text.replace("\n", f" {PLAIN}\n") if self.line_cut else text).split(" ")

    def encode_batch(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same in decimal joined by commas; null is as empty."""
        if len(self.ids_of) > self.cache_limit:
            # what is met again moves back from the older half, the rest goes with the next turn
            self.older, self.ids_of = self.ids_of, {}
        cut = [self.fragments(t) if t else [] for t in texts]
        found = [list(map(self.ids_of.get, words)) for words in cut]
        open_ = [k for k, ids in enumerate(found) if None in ids]
        new = {w for k in open_ for w, ids in zip(cut[k], found[k], strict=True) if ids is None}
        for w in new.intersection(self.older):
            self.ids_of[w] = self.older[w]
        ordered = list(new.difference(self.older))
        fresh = dict(zip(ordered, self.encode_fragments([w[1:].replace(" ", SPACE) if w[:1] == PLAIN else SPACE + w for w in ordered]), strict=True))
        for k in open_:
            found[k] = [(fresh[w] if w in fresh else self.ids_of[w]) if ids is None else ids for w, ids in zip(cut[k], found[k], strict=True)]
        # a long fragment may be a whole text, and is hardly met again: it isn't remembered
        self.ids_of.update((w, ids) for w, ids in fresh.items() if len(w) <= LONG)
        out = []
        for each in found:
            ids = np.frombuffer(b"".join(each), self.code).tolist()
            out.append((ids, ",".join(map(self.decimal.__getitem__, ids))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the prefix space goes, byte pieces join to characters; bytes that are no UTF-8 are left to the library."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)
        return text[1:] if text[:1] == " " and self.surface[ids[0]][:1] == b" " and len(self.surface[ids[0]]) and ids[0] not in self.byte_id.values() else text


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _coded(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in slices(batches):
            coded = model.encode_batch(batch.column("text").to_pylist())
            texts = [model.decode(ids) for ids, _ in coded]
            for ours, theirs in zip(texts, model.library.decode([ids for ids, _ in coded], num_threads=1), strict=True):
                if ours != theirs:
                    raise RuntimeError(f"decoding disagrees with the library on {theirs[:80]!r}")
            columns = [
                batch.column("doc_id"),
                pa.array([len(ids) for ids, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([ids for ids, _ in coded], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_and_decode(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` ids and decoded.

    No begin or end ids. A null text is as an empty one: no ids, decoded to the
    empty text. Rows are independent, so repeated rows, ties and null ids pass
    through as they are; other columns are ignored; an empty table gives none.
    Memory is bounded by a slice of texts (4 MB, or one text above that) and the
    fragment table, which has at most two times 150,000 and a slice's fragments
    of up to LONG characters; very long texts without spaces go to the heap, in
    n log n steps, and aren't remembered.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_coded(model_path, keep_ids), schema)
