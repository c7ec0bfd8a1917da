"""Minimal perfect hashing of 64-bit keys in numpy.

Level by level the keys still without a place fall into a bit array of about
``GAMMA`` bits a key; a key alone on its bit has its place, the others go to
the next level under another seed. A key's slot is the rank of its bit, so n
keys have the slots 0 .. n-1 at some 3 to 4 bits a key. The hash says nothing
about foreign keys, so ``Slots`` keeps the key of every slot and verifies."""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 64

# The multipliers of the 64-bit finaliser of splitmix64.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((_STEP * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray) -> list[np.ndarray]:
    """The bit arrays (packed in 64-bit words) of distinct ``keys``."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        words = max(1, int(len(left) * GAMMA / 64) + 1)
        at = mix(left, len(levels)) % np.uint64(words * 64)
        alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at.astype(np.int64)]]
    return levels


class Slots:
    """Verified slots of a set of keys: ``levels`` from ``places``, and the
    keys in the order of their slots."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray | None = None):
        self.levels, self.before, total = levels, [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size, self.keys = total, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> Slots:
        keys = keys.astype(np.int64)
        out = cls(places(keys))
        out.keys = np.empty(out.size, np.int64)
        out.keys[out.raw(keys)] = keys
        return out

    def raw(self, keys: np.ndarray) -> np.ndarray:
        """Slots without verification; -1 where no level has a bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            low = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for keys that are not in the set."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        slot = self.raw(keys)
        slot[self.keys[slot] != keys] = -1
        return slot

    def pack(self) -> bytes:
        """The bit arrays as bytes: their number, their lengths, their words."""
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + b"".join(words.tobytes() for words in self.levels)

    @classmethod
    def unpack(cls, data: bytes, keys: np.ndarray) -> Slots:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        lengths = np.frombuffer(data, np.int64, n, 8)
        words = np.frombuffer(data, np.uint64, -1, 8 * (n + 1))
        return cls(np.split(words, np.cumsum(lengths)[:-1]) if n else [], keys)
