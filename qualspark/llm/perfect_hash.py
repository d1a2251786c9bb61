"""Minimal perfect hash over 64-bit keys, vectorised: levels of bit sets, each holding the keys that do not collide.

A key's slot is the number of set bits before its own; n distinct keys fill slots 0..n-1. Keys that were not built
in may land on any slot, so callers store a fingerprint per slot and compare.
"""

from __future__ import annotations

import numpy as np

_MOST_LEVELS = 40


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits that tell a stored key from most others."""
    return (mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """levels: one 0/1 array each. Keys still colliding after the last level are kept sorted in `rest`."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._before = []
        self.placed = 0
        for bits in levels:
            self._before.append(self.placed + np.cumsum(bits, dtype=np.int64) - bits)
            self.placed += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """keys: distinct uint64."""
        levels, rest = [], keys
        while len(rest) and len(levels) < _MOST_LEVELS:
            size = max(64, int(gamma * len(rest)))
            at = (mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            rest = rest[~alone[at]]
        return cls(levels, np.sort(rest))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it (then it was not built in)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for k, (bits, before) in enumerate(zip(self.levels, self._before, strict=True)):
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], dtype="<u8")
        return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in self.levels), self.rest.astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, rest = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        sizes, at, levels = np.frombuffer(raw, "<u8", n, 16), 16 + 8 * n, []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size))
            at += (size + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u8", rest, at).astype(np.uint64))
