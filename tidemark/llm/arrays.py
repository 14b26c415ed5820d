"""Vectorised text arithmetic used inside Arrow tasks.

A batch of texts is looked at as one byte buffer.  Words are byte ranges of it
and every hash is computed with wrapping 64-bit numpy arithmetic, so that no
Python object is made per word.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_U64 = (1 << 64) - 1


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Lookup table of the bytes that end a word."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
SPACE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text).
NON_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (bijective)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.lru_cache(maxsize=16)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers_for(base: int, n: int) -> np.ndarray:
    return _powers(base & _U64, 1 << max(10, int(n).bit_length()))[:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _R) -> np.ndarray:
    """Polynomial hash of every values[start:end], independent of its place."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers_for(base, n), out=sums[1:])
    inverse = _powers_for(pow(base, -1, 1 << 64), n + 1)
    return (sums[ends] - sums[starts]) * inverse[starts]


@dataclass
class Words:
    """Words of a batch: byte ranges, and the place of each document's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[d] : first[d + 1] are the words of document d
    text_start: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @functools.cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from its bytes eight at a time."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64))
        if not len(length):
            return out
        padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
        padded[:-8] = self.data
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        at, left, start = np.arange(len(length)), length, self.start
        for _ in range(64):
            part = eight[start] & _MASKS[np.minimum(left, 8)]
            out[at] = mix((out[at] ^ part) * np.uint64(_R))
            more = left > 8
            if not more.any():
                return out
            at, left, start = at[more], left[more] - 8, start[more] + 8
        for i in at.tolist():  # words of over 512 bytes
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
        return out

    def windows(self, n: int, base: int = _Q, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each place, and whether they lie in one document."""
        h = self.hashes
        size = len(h)
        ok = np.zeros(size, dtype=bool)
        if size >= n:
            at = np.arange(size - n + 1)
            out = np.zeros(size, dtype=np.uint64)
            out[: size - n + 1] = mix(range_hash(h, at, at + n, base) + np.uint64(salt))
            ok[: size - n + 1] = self.doc[: size - n + 1] == self.doc[n - 1 :]
            return out, ok
        return np.zeros(size, dtype=np.uint64), ok


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def words_of(column, table: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    return words_inside(data, offsets, ~table[data])


def words_inside(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words as the maximal runs of bytes inside, within each document."""
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def within_docs(flags: np.ndarray, words: Words) -> np.ndarray:
    """How many flags each document has."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]


def spread(starts_flag: np.ndarray, n: int) -> np.ndarray:
    """Positions covered by an n-long range that starts at a flagged one."""
    change = np.zeros(len(starts_flag) + n + 1, dtype=np.int32)
    at = np.flatnonzero(starts_flag)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change)[: len(starts_flag)] > 0


def fast_join(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """All documents' words joined by one space: one buffer, and its offsets."""
    length = words.end - words.start
    use = np.ones(len(length), dtype=bool) if keep is None else keep
    size = np.where(use, length + 1, 0)
    total = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=total[1:])
    # which bytes of the input are kept, plus one separator after each kept word
    delta = np.zeros(len(words.data) + 2, dtype=np.int8)
    np.add.at(delta, words.start[use], 1)
    np.add.at(delta, words.end[use], -1)
    mask = np.cumsum(delta, dtype=np.int8)[: len(words.data)] > 0
    body = np.full(int(total[-1]), 0x20, dtype=np.uint8)
    sep = np.zeros(int(total[-1]), dtype=bool)
    ends = total[1:][use] - 1
    sep[ends] = True
    body[~sep] = words.data[mask]
    bounds = total[words.first]
    return body.tobytes(), bounds


def unique_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if not len(values):
        return values
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1_000_000):
    """Tables of about `limit` bytes of text each, so that a task's memory stays small."""
    size = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)]))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + limit, side="right")) - 1)
        yield pa.Table.from_batches([batch.slice(lo, hi - lo)])
        lo = hi
    release()


def release() -> None:
    """Give freed Arrow memory back: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
