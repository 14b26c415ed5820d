"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Each document becomes its token ids and an end id, cut at multiples of the sequence
length; only the pieces' lengths matter for packing, so the driver sees one count
per length and nothing else.  Lengths are placed longest first: into copies of the
pattern with the most room (the shortest pack), updating how often each pattern
occurs, or into a new pattern.  Patterns then go back to documents by rank: a
document's rank among those of its length tells its pattern, copy and offset.

Defined results: null and empty texts are one piece that holds only the end id; rows
that repeat are packed each for itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import release
from .exchange import materialise
from .tokens import default_tokenizer, encoder

LENGTH = 1024
END = 0

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("k", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, k long"


def _cut(batches, path: str, length: int, with_ids: bool):
    encode = encoder(path)
    part_id, seen = TaskContext.get().partitionId(), [0] * (length + 1)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), END).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].tobytes()
                    size = len(piece) // 4
                    rows.append((doc, start, size, zlib.crc32(piece), len(ids), part_id, seen[size], *([piece] if with_ids else [])))
                    seen[size] += 1
            schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)
        release()


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `length` ids, without any shuffle; k counts those of a length within their partition."""
    cut = functools.partial(_cut, path=tokenizer or default_tokenizer(), length=length, with_ids=with_ids)
    return docs.select("doc_id", "text").mapInArrow(cut, _DDL + (", ids binary" if with_ids else ""))


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for counts of piece lengths."""
    open_: dict[int, list[list]] = {}  # room -> patterns with that room and their counts
    done: list[tuple[tuple[int, ...], int]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        placed: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            room = max((r for r in open_ if r >= size), default=None)
            if room is None:
                # one pattern of several equal pieces for most, another for the rest
                fit = min(left, length // size)
                copies = left // fit
                placed.append((length - fit * size, (size,) * fit, copies))
                left -= fit * copies
                continue
            pattern, count = open_[room][-1]
            fit = min(left, room // size)
            use = min(count, left // fit)
            placed.append((room - fit * size, (*pattern, *(size,) * fit), use))
            left -= fit * use
            if use == count:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                open_[room][-1][1] -= use
        for room, pattern, count in placed:
            if room:
                open_.setdefault(room, []).append([pattern, count])
            else:
                done.append((pattern, count))
    return done + [(p, c) for group in open_.values() for p, c in group]


def _places(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, in order of rank: first rank, first sequence, offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, count in sorted(found, reverse=True):
        offset = 0
        for size in pattern:
            out.setdefault(size, []).append((used.get(size, 0), first, offset))
            used[size] = used.get(size, 0) + count
            offset += size
        first += count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _place(batches, places: dict[int, np.ndarray], columns: list[str]):
    for batch in batches:
        size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            table = places[int(s)]
            k = np.searchsorted(table[:, 0], rank[at], side="right") - 1
            sequence[at] = table[k, 1] + rank[at] - table[k, 0]
            offset[at] = table[k, 2]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])


def assign(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequence and offset of every row of `pieces` (a table that reads the same each time)."""
    spark = cut.sparkSession
    cells = materialise(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    places = spark.sparkContext.broadcast(_places(patterns(histogram, length)))  # its size depends on `length` alone
    # ranks within a length go on from partition to partition, so that a common length is no hot group
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = cells.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    columns = [c for c in cut.columns if c not in ("part", "k")]
    ranked = cut.join(base, ["length", "part"]).select(*columns, (F.col("base") + F.col("k")).alias("rank"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in columns)

    def place(batches):
        return _place(batches, places.value, columns)

    return ranked.mapInArrow(place, ddl + ", sequence_id long, offset long")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, its checksum (or ids), and where it goes."""
    cut = materialise(pieces(docs, length, tokenizer, with_ids), "pieces")
    return assign(cut, length)
