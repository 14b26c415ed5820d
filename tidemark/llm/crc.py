"""CRC-32 of many byte ranges at once, and of their concatenations.

The checksum is that of ``zlib.crc32``.  It is linear over bits, so the checksum of two
joined ranges follows from theirs and the length of the second one.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

SHORT = 64  # longer ranges go through zlib one by one
STEP = 255  # the longest shift that one table lookup makes
_POLYNOMIAL = 0xEDB88320


@functools.cache
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), out >> np.uint32(1))
    return out


@functools.cache
def _shifts() -> np.ndarray:
    """What `length` zero bytes make of each byte of a checksum: (length, byte, value)."""
    table = _table()
    out = np.empty((STEP + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, STEP + 1):
        out[k] = table[out[k - 1] & np.uint32(255)] ^ (out[k - 1] >> np.uint32(8))
    return out


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksum of every data[start:end]."""
    table = _table()
    state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    length = end - start
    at = np.flatnonzero(length > 0)
    for j in range(SHORT):
        if not len(at):
            return ~state
        now = state[at]
        state[at] = table[(now ^ data[start[at] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
        at = at[length[at] > j + 1]
    out = ~state
    for i in at.tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def joined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """Checksums of concatenations, from those of both parts."""
    shifts = _shifts()
    out = np.array(np.broadcast_to(first, np.shape(second)), dtype=np.uint32)
    left = np.array(second_length, dtype=np.int64)
    at = np.arange(len(out))
    while len(at):
        step, now = np.minimum(left[at], STEP), out[at]
        moved = shifts[step, 0, now & np.uint32(255)]
        for b in (1, 2, 3):
            moved ^= shifts[step, b, (now >> np.uint32(8 * b)) & np.uint32(255)]
        out[at] = moved
        left[at] -= step
        at = at[left[at] > 0]
    return out ^ second
