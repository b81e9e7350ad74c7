"""Minimal perfect hashing of distinct 64-bit keys.

Keys go down levels of bits: at each level a key hashes to a bit, which is set if no other key
hashes there; keys that share one go on to the next level.  A key's index is the number of set
bits before its own.  There are about three bits a key, whatever the keys are.  Keys that were
not hashed get some index or none, so whoever looks up compares the key stored there.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

ROOM = 2.0
MAX_LEVELS = 200


def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of every key at a level of ``size`` bits: a mix of key and level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """The levels for distinct ``keys`` (uint64), as bytes."""
    levels, left = [], keys
    while len(left):
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys repeat")
        size = max(64, int(ROOM * len(left)))
        at = slots(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    head = np.array([len(levels), *map(len, levels)], "<i8").tobytes()
    return head + (np.packbits(np.concatenate(levels)).tobytes() if levels else b"")


class Index:
    """Lookup of keys in levels made by :func:`build`."""

    def __init__(self, levels: bytes):
        n = int(np.frombuffer(levels, "<i8", 1)[0])
        self.sizes = np.frombuffer(levels, "<i8", n, 8).tolist()
        self.bits = np.unpackbits(np.frombuffer(levels, np.uint8, offset=8 * (n + 1)), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; -1 for some of those that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        open_, begin = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = slots(keys[open_], level, size) + begin
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            begin += size
        return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
