"""Hashed byte n-gram frequencies of whole texts, as array work on Arrow batches."""

from __future__ import annotations

import numpy as np

#: ASCII letters in lower case and bytes of other scripts stay; all else is a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigram_slots(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the slot of the folded trigram that starts there, and whether it counts.

    slots must be a power of two.  A trigram counts unless it crosses the end of
    its row or holds two spaces in a row.
    """
    x = _FOLD[data].astype(np.uint32)
    n = len(x)
    if n < 3:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    key = np.zeros(n, np.uint32)
    key[:-2] = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    space = x == 0x20
    good = np.ones(n, bool)
    good[:-1] &= ~(space[:-1] & space[1:])
    good[:-2] &= ~(space[1:-1] & space[2:])
    good[-2:] = False
    ends = offsets[1:]
    for back in (1, 2):
        at = ends - back
        good[at[at >= offsets[:-1]]] = False
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots.bit_length() + 1)).astype(np.int64), good


def frequencies(data: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Rows x slots: the shares of each row's trigrams (zeros where it has none)."""
    slot, good = trigram_slots(data, offsets, slots)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount((row * slots + slot)[good], minlength=n * slots).reshape(n, slots).astype(np.float64)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)

