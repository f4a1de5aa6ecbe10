"""Minimal perfect hash functions of sets of 64-bit keys, built level by level.

Every key claims one place of a level; keys that share a place go to the next
level.  A key's number is the count of claimed places before its own, so n keys
get the numbers 0..n-1, with about three bits a key.  Other keys may get a
number too: callers keep the keys by number and compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import U64, mix, pack, position_keys, unpack

_ROOM = 2        # places of a level for each key that is left


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                                   # bool arrays
        self.before, at = [], 0
        for bits in levels:
            self.before.append(at + np.cumsum(bits, dtype=np.int64) - bits)
            at += int(bits.sum())
        self.size = at

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ position_keys(1, 1000 + level)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Function of the distinct ``keys`` (int64)."""
        left, levels = keys.view(U64), []
        while len(left):
            size = max(_ROOM * len(left), 8)
            spot = cls._spot(left, len(levels), size)
            claims = np.bincount(spot, minlength=size)
            levels.append(claims == 1)
            left = left[claims[spot] != 1]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key; -1 for keys that claim no place."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        values = keys.view(U64)
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            spot = self._spot(values[left], level, len(bits))
            hit = bits[spot]
            out[left[hit]] = self.before[level][spot[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return pack(pa.record_batch([pa.array([np.packbits(b).tobytes() for b in self.levels], pa.binary()),
                                     pa.array([len(b) for b in self.levels], pa.int64())], ["bits", "size"]))

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        b = unpack(blob)
        return cls([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
                    for x, n in zip(b.column("bits").to_pylist(), b.column("size").to_pylist())])
