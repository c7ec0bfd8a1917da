"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

CHUNK = 4 << 20
# White space bytes 0x20 and 0x09-0x0D part words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            ups, downs = np.full(n, _BASE), np.full(n, inverse)
            ups[0] = downs[0] = 1
            self.up, self.down = np.cumprod(ups), np.cumprod(downs)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i], times the inverse power of i, identifies data[i:j]."""
    up, _ = POWERS.upto(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte array."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = prefix_sums(data)
    _, down = POWERS.upto(len(data) + 1)
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _SALTS[5])


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text (lower-cased A-Z) the sorted distinct hashes of its
    shingles of ``size`` words; fewer words make one shingle, none makes none."""
    group, weight = [], 0
    for t in texts:
        group.append(t)
        weight += len(t) if t else 0
        if weight >= CHUNK:
            yield from _sets(group, size)
            group, weight = [], 0
    if group:
        yield from _sets(group, size)


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join([(t or b"").lower() for t in texts]), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    starts, words = word_hashes(data)
    bounds = np.searchsorted(starts, offsets)
    n = max(0, len(words) - size + 1)
    all_shingles = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        all_shingles += words[k:k + n] * (_SALTS[k % 8] + np.uint64(2 * (k // 8)))
    all_shingles = mix(all_shingles)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_shingles[a:b - size + 1])
        elif b > a:
            few = np.full(1, b - a, dtype=np.uint64) * _SALTS[7]
            for k in range(b - a):
                few += words[a + k:a + k + 1] * (_SALTS[k % 8] + np.uint64(2 * (k // 8)))
            yield mix(few)
        else:
            yield np.empty(0, dtype=np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit id of a sorted token array."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h
