"""A minimal perfect hash of distinct 64-bit keys, with the keys stored by slot, so that a key which isn't among them is known."""

from __future__ import annotations

import numpy as np

from planwatch.llm.grams import U, mixed

_STEP = 0x9FB21C651E98DF25  # between the levels' hashes


class PerfectHash:
    """Slots 0 .. n - 1 of n keys, by a cascade of bit arrays.

    Each level has twice as many bits as keys are left. A key that meets no other at its place takes it, the others go to the next level; the slot is
    the number of places taken before. What 40 levels leave (keys are distinct, so nothing in practice) is looked up by order. A slot's
    key is stored, with a second 64-bit check if there is one, and compared on each look-up.
    """

    LEVELS = 40

    def __init__(self, keys: np.ndarray, checks: np.ndarray | None = None):
        self.levels, left = [], keys
        while len(left) and len(self.levels) < self.LEVELS:
            size = 2 * len(left) + 7
            at = self._places(left, len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            self.levels.append((size, np.packbits(taken)))
            left = left[~taken[at]]
        self.rest = np.sort(left)
        self._ranks: list | None = None
        self.stored, self.checks = np.empty(len(keys), U), None if checks is None else np.empty(len(keys), U)
        slots = self._slots(keys)
        self.stored[slots] = keys
        if checks is not None:
            self.checks[slots] = checks

    def __len__(self) -> int:
        return len(self.stored)

    def __getstate__(self):
        return self.__dict__ | {"_ranks": None}

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + U((level + 1) * _STEP % (1 << 64))) % U(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot of each key, or -1; that of a key which isn't among them means nothing."""
        if self._ranks is None:
            self._ranks, taken = [], 0
            for size, bits in self.levels:
                there = np.unpackbits(bits, count=size)
                self._ranks.append((there.astype(bool), (np.cumsum(there, dtype=np.int64) + (taken - 1)).astype(np.int32)))
                taken += int(there.sum())
        out, at = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ((size, _), (there, rank)) in enumerate(zip(self.levels, self._ranks)):
            place = self._places(keys[at], level, size)
            hit = there[place]
            out[at[hit]] = rank[place[hit]]
            at = at[~hit]
            if not len(at):
                break
        if len(self.rest) and len(at):
            place = np.minimum(np.searchsorted(self.rest, keys[at]), len(self.rest) - 1)
            same = self.rest[place] == keys[at]
            out[at[same]] = len(self.stored) - len(self.rest) + place[same]
        return out

    def lookup(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key that is among the stored ones, else -1."""
        if not len(self.stored):
            return np.full(len(keys), -1, np.int64)
        out = self._slots(keys)
        same = self.stored[out] == keys
        if checks is not None:
            same &= self.checks[out] == checks
        return np.where(same & (out >= 0), out, -1)
