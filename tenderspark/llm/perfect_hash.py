"""Minimal perfect hash of integer keys, with fingerprints (levelled bit arrays, Limasset et al., 2017).

Level by level, keys that are alone at their place of a bit array settle there; the others go on to the next level. A
key's slot is the number of set bits before its own. All steps are array operations.
"""

from __future__ import annotations

import io

import numpy as np

from tenderspark.llm.shingles import mix

GAMMA = 2.0
_LEVELS = 48


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x5BF03635)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """levels: packed bits and sizes; ranks: set bits before each byte over all levels."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum((sizes + 7) // 8)]).astype(np.int64)
        self.counts = np.array([bin(i).count("1") for i in range(256)], np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(self.counts[bits])])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64 values."""
        left, sizes, parts = keys.astype(np.int64).view(np.uint64), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(8, int(GAMMA * len(left)))
            place = _places(left, level, size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place.astype(np.int64)]]
        if len(left):
            raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, a bijection onto 0..n-1 for the keys of build(); -1 or any slot for others."""
        k = keys.astype(np.int64).view(np.uint64)
        out, open_ = np.full(len(k), -1, np.int64), np.arange(len(k))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = _places(k[open_], level, int(size)).astype(np.int64)
            byte = self.starts[level] + place // 8
            value = self.bits[byte]
            hit = (value >> (place % 8).astype(np.uint8)) & 1 == 1
            below = self.counts[value & ((1 << (place % 8)) - 1).astype(np.uint8)]
            out[open_[hit]] = (self.ranks[byte] + below)[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, bits=self.bits)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        z = np.load(io.BytesIO(data))
        return cls(z["sizes"], z["bits"])
