"""A minimal perfect hash over 64-bit keys, as a few numpy arrays.

Keys fall into the bits of a first level; those that fall alone keep their bit,
the others go on to the next, smaller level. A key's slot is the number of bits
before its own, so that n keys have the slots 0 to n - 1. What isn't a key may
have a slot too, so the keys are stored by slot, with a second hash of what they
stand for, and every answer is verified.
"""

from __future__ import annotations

import numpy as np

from glossa.llm.hashing import mix64

_STEP = 0x9E3779B97F4A7C15
#: Bits of a level for each key that reaches it.
GAMMA = 2
_LEVELS = 64


def share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """In which of ``parts`` equal ranges of all 64-bit values each hash lies."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


class PerfectHash:
    """(key, check) pairs with distinct keys -> slots."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray):
        self.sizes: list[int] = []
        flags, left = [], keys
        while len(left):
            if len(self.sizes) == _LEVELS:
                raise ValueError("keys repeat: two phrases have the same 64-bit hash, another seed is needed")
            size = -(-max(GAMMA * len(left), 64) // 64) * 64
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            flags.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(flags) if flags else np.zeros(64, bool)
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.keys, self.checks = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        slots = self._unverified(keys)
        self.keys[slots], self.checks[slots] = keys, checks

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return share(mix64(keys + np.uint64(_STEP * (level + 1) % (1 << 64))), size).astype(np.int64)

    def _unverified(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(keys[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            is_set = (word >> bit) & np.uint64(1) == 1
            before = word[is_set] & ((np.uint64(1) << bit[is_set]) - np.uint64(1))
            out[left[is_set]] = self.ranks[at[is_set] >> 6] + np.bitwise_count(before)
            left, base = left[~is_set], base + size
            if not len(left):
                break
        return out

    def slots(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Slot of each key, -1 for what isn't one; without checks, keys alone are compared."""
        out = self._unverified(keys)
        wrong = out < 0
        if len(self.keys):
            wrong |= self.keys[out] != keys
            if checks is not None:
                wrong |= self.checks[out] != checks
        out[wrong] = -1
        return out
