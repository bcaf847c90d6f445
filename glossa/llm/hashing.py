"""Word and shingle hashing shared by the text operators.

``Words`` hashes all words of a text at once, by differences of a running sum
over its bytes; ``WordHashes`` hashes words that are at hand one by one and
keeps them in a bounded table. Runs of words are hashed by combining these
values with wrapping 64-bit arithmetic, so that every step over a document is a
few numpy calls.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = 0x9E3779B97F4A7C15
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """bytes -> xxh64, filled on demand and emptied beyond ``limit`` entries; words of more than ``longest`` bytes aren't kept."""

    longest = 64

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes that are hashed at once, and the length from which a word is hashed by itself.
_CHUNK, _LONG = 1 << 16, 1 << 12
#: Multiplier of the running sum: odd, so that it has an inverse, and 5 mod 8, so that its powers differ in their low bits.
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.full(_CHUNK + 1, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(_CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64))


class Words:
    """Text -> 64-bit hashes of its words, in order: runs of bytes of its UTF-8 that aren't separators, A-Z in lower case.

    A byte has a random number, by which the power of its place is multiplied;
    the sum over a word, taken back to place 0, depends on the word alone. Words
    of _LONG bytes or more are hashed with xxh64.
    """

    def __init__(self, separators: bytes):
        values = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.values = np.where(self.word, values, np.uint64(0))
        self.blanks = bytes(b if self.word[b] else 32 for b in range(256))

    def __call__(self, text: str | None) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if len(raw) <= _CHUNK:
            return self._hashed(raw)
        found, at, blank = [], 0, raw.translate(self.blanks)
        while at < len(raw):
            end = at + _CHUNK
            if end < len(raw):  # cut at a separator; a chunk without one is part of a long word
                cut = blank.rfind(b" ", at, end)
                end = cut + 1 if cut >= at else (blank.find(b" ", end) + 1 or len(raw))
            found.append(self._hashed(raw[at:end]))
            at = end
        return np.concatenate(found)

    def _hashed(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.empty(0, np.uint64)
        a = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = self.word[a]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        size = ends - starts
        if len(a) > _CHUNK:  # one word and what is around it
            return self._alone(raw, starts, ends)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.values[a] * _POWERS[: len(a)], out=sums[1:])
        out = mix64((sums[ends] - sums[starts]) * _INVERSES[starts] + size.astype(np.uint64) * np.uint64(_MULT))
        long = np.flatnonzero(size >= _LONG)
        if len(long):
            out[long] = self._alone(raw, starts[long], ends[long])
        return out

    @staticmethod
    def _alone(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(raw[i:j].lower()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    mult = np.uint64(_MULT)
    acc = words[:m] + np.uint64(n)
    for j in range(1, n):
        acc = acc * mult + words[j : j + m]
    return mix64(acc)


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, no words none."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return distinct(ngram_hashes(words, min(n, len(words))))
