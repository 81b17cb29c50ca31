"""Tokens of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

# 0: white space; 1: letters, digits and all beyond ASCII; 2: other signs
_CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_FACTOR = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed_tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens (runs of word characters, runs of signs) in order, and each text's first token's number (and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= kind > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    value = (_LOWER[data] + np.uint64(1)) * _FACTOR[place & 63]
    value[(kind == 0) | (number < 0)] = 0
    mixed = np.add.reduceat(value, starts)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(starts, offsets)
