"""Removal of repeated passages by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``window // 2`` words at the
multiples of that length.  Any repeat of ``window`` words holds at least one whole
reference block of each document that has it, so probing the index of blocks with
every rolling run finds every place where a repeat can be.  Only those places are
extended: a hash of 128 bits of the full window around a hit goes to its bucket, which
answers whether a document with a smaller id has it, and the union of such windows
is the maximal repeated range that is removed.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: a null, empty or short text has
nothing removed; rows with a null ``doc_id`` never count as smaller and lose what any
other document has; rows that repeat a ``doc_id`` do not remove each other's words;
columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .arrays import Words, fast_join, spread, within_docs, words_of

WINDOW = 50
_NO_ID = np.iinfo(np.int64).max
_SECOND = 0xD6E8FEB86659FD93  # odd: the base of the second polynomial
_WIDTH = 5  # bytes of a block's fingerprint besides its bucket; its two lowest bits are flags


class _Runs:
    """Distinct run fingerprints of one group, in order, and where each occurs; `second` are further bits of each."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> None:
        order = np.argsort(hashes[at], kind="stable") if second is None else np.lexsort((second[at], hashes[at]))
        self.at = at[order]
        ordered = hashes[self.at]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if second is not None:
            new[1:] |= second[self.at][1:] != second[self.at][:-1]
        self.heads = np.flatnonzero(new)
        self.keys = ordered[self.heads]
        self.more = None if second is None else second[self.at][self.heads]
        self.number = np.cumsum(new) - 1

    def reduce(self, op: np.ufunc, values: np.ndarray) -> np.ndarray:
        return op.reduceat(values[self.at], self.heads) if len(self.heads) else values[:0]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _block_runs(words: Words, block: int) -> tuple[_Runs, np.ndarray]:
    hashes, ok = words.windows(block)
    return _Runs(hashes, np.flatnonzero(ok)), hashes


def _send_blocks(table: pa.Table, block: int, bits: int) -> pa.Table:
    words = words_of(table.column("text"))
    runs, _ = _block_runs(words, block)
    place = np.arange(len(words.start)) - words.first[words.doc]
    docs = _ids(table)[words.doc]
    indexed = runs.reduce(np.maximum, (place % block == 0).astype(np.uint8))
    several = (runs.reduce(np.minimum, docs) != runs.reduce(np.maximum, docs)).astype(np.uint8)
    # rows that repeat one document id are told apart by place in the group, not by id
    g = table.column("g")[0].as_py()
    rows = []
    for bucket, _, keys, flags in ex.pack(g, runs.keys, bits, indexed | (several << 1)):
        cells = np.frombuffer(ex.shorten(keys, bits, _WIDTH), dtype=np.uint8).reshape(-1, _WIDTH).copy()
        cells[:, -1] = (cells[:, -1] & 0xFC) | flags
        rows.append((bucket, g, cells.tobytes(), None))
    return ex.blob_table(rows, ex.BLOB_SCHEMA)


def _merge_blocks(table: pa.Table) -> pa.Table:
    raws, groups = table.column("keys").to_pylist(), table.column("g").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    offsets = np.concatenate([[0], np.cumsum([len(r) // _WIDTH for r in raws])])
    cells = ex.lengthen(b"".join(raws), _WIDTH)
    shift = np.uint64(64 - 8 * _WIDTH)
    flags = ((cells >> shift) & np.uint64(3)).astype(np.uint8)
    keys = cells & ~(np.uint64(3) << shift)
    sender = np.repeat(np.arange(len(groups)), np.diff(offsets))
    runs = _Runs(keys, np.arange(len(keys)))
    seen = runs.reduce(np.bitwise_or, flags)
    apart = runs.reduce(np.minimum, sender) != runs.reduce(np.maximum, sender)
    hit = ((seen & 1) > 0) & (((seen & 2) > 0) | apart)
    answer = np.zeros(len(keys), dtype=bool)
    answer[runs.at] = hit[runs.number]
    rows = [(g, bucket, 1, np.packbits(answer[a:b]).tobytes()) for g, a, b in zip(groups, offsets[:-1], offsets[1:], strict=True) if answer[a:b].any()]
    return ex.blob_table(rows, ex.REPLY_SCHEMA)


def _bits_of(replies: dict[int, bytes], packed: list[tuple], size: int) -> np.ndarray:
    """Answered bits in the order of the group's distinct keys."""
    out, at = np.zeros(size, dtype=bool), 0
    for bucket, _, keys, _ in packed:
        if (raw := replies.get(bucket)) is not None:
            out[at : at + len(keys)] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=len(keys)).astype(bool)
        at += len(keys)
    return out


def _candidates(docs: pa.Table, replies: pa.Table, window: int, bits: int) -> tuple[Words, _Runs, np.ndarray]:
    """Windows around a hit block, by fingerprint, and the smallest id that has each here."""
    block = window // 2
    words = words_of(docs.column("text"))
    runs, hashes = _block_runs(words, block)
    hit_key = _bits_of(ex.replies_of(replies, 1), ex.pack(0, runs.keys, bits), len(runs.keys))
    hit = np.zeros(len(hashes) + block + 1, dtype=np.int64)
    hit[runs.at] = hit_key[runs.number]
    total = np.concatenate([[0], np.cumsum(hit)])
    n = len(hashes)
    near = total[np.arange(n) + window - block + 1 if n else np.zeros(0, dtype=int)] - total[:n] > 0 if n else np.zeros(0, dtype=bool)
    whole, ok = words.windows(window)
    second, _ = words.windows(window, base=_SECOND)
    found = _Runs(whole, np.flatnonzero(ok & near), second)
    least = found.reduce(np.minimum, _ids(docs)[words.doc])
    return words, found, least


def _send_windows(docs: pa.Table, replies: pa.Table, window: int, bits: int) -> pa.Table:
    if not docs.num_rows:
        return ex.BLOB_SCHEMA.empty_table()
    g = docs.column("g")[0].as_py()
    _, found, least = _candidates(docs, replies, window, bits)
    vals = np.stack([least, found.more.view(np.int64)], axis=1) if len(found.keys) else least
    rows = [(bucket, g, ex.shorten(keys, bits, 8), np.ascontiguousarray(v).tobytes()) for bucket, _, keys, v in ex.pack(g, found.keys, bits, vals)]
    return ex.blob_table(rows, ex.BLOB_SCHEMA)


def _merge_windows(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    raws, groups = table.column("keys").to_pylist(), table.column("g").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raws])])
    ids, second = np.frombuffer(b"".join(table.column("vals").to_pylist()), dtype=np.int64).reshape(-1, 2).T
    runs = _Runs(ex.lengthen(b"".join(raws), 8), np.arange(len(ids)), second)
    answer = np.zeros(len(ids), dtype=bool)
    answer[runs.at] = runs.reduce(np.minimum, ids)[runs.number] < ids[runs.at]
    rows = [(g, bucket, 2, np.packbits(answer[a:b]).tobytes()) for g, a, b in zip(groups, offsets[:-1], offsets[1:], strict=True) if answer[a:b].any()]
    return ex.blob_table(rows, ex.REPLY_SCHEMA)


_OUT = "doc_id long, n_words long, n_removed long, kept_text string, copies long"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("copies", pa.int64())])


def _remove(docs: pa.Table, replies: pa.Table, window: int, bits: int) -> pa.Table:
    if not docs.num_rows:
        return _OUT_SCHEMA.empty_table()
    words, found, least = _candidates(docs, replies, window, bits)
    smaller = _bits_of(ex.replies_of(replies, 2), ex.pack(0, found.keys, bits), len(found.keys))
    ids = _ids(docs)
    starts = np.zeros(len(words.start), dtype=bool)
    starts[found.at] = smaller[found.number] | (ids[words.doc[found.at]] > least[found.number])
    gone = spread(starts, window)
    raw, bounds = fast_join(words, ~gone)
    kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.table(
        {"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": np.diff(words.first).astype(np.int64), "n_removed": within_docs(gone, words), "kept_text": pa.array(kept, type=pa.binary()).cast(pa.string()), "copies": docs.column("copies")},
        schema=_OUT_SCHEMA,
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, plan: ex.Plan | None = None) -> DataFrame:
    """One row per document: its words without those that an earlier document has too.

    A word goes if a run of ``window`` words of its document covers it and the same
    run starts anywhere in a document with a smaller ``doc_id``.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of at least 4 words")
    plan = plan or ex.Plan(docs)
    block, bits = window // 2, plan.bits
    grouped = plan.grouped(docs)
    hits = ex.answer(ex.ask(grouped, ex.one(_send_blocks, block=block, bits=bits)), _merge_blocks)
    by_group = grouped.groupBy("g")
    windows = by_group.cogroup(hits.groupBy("g")).applyInArrow(ex.two(_send_windows, window=window, bits=bits), schema=ex.BLOB)
    replies = hits.unionByName(ex.answer(windows, _merge_windows))
    return ex.expanded(by_group.cogroup(replies.groupBy("g")).applyInArrow(ex.two(_remove, window=window, bits=bits), schema=_OUT))


def digest(kept: DataFrame) -> DataFrame:
    """The checksum form of `remove_repeats`."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
