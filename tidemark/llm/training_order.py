"""Training-order materialisation of token sequences as fixed-stride shards.

Documents are tokenised, ended and joined, input split by input split, into sequences
of a fixed length.  Each split owns a range of indices that its bytes bound (a token
takes at least one byte), and a keyed Feistel permutation of all indices, which walks
its cycles until it falls in range, gives each sequence its place.  Places are dealt by
range to shards, one file each, of records of equal size in order of place; a
sequence's global slot is the number of sequences with a smaller place: the records of
the shards before, which the manifest holds, and its rank in its own.

Texts are tokenised once: exact counts before the permutation would need a second pass
or a stored copy of all ids.  A record is two bytes an id for vocabularies of up to
65,536.

The sequences of a table, and with them the order, are those of its input splits: tokens
run on within a split, and its last sequence is padded.  Reading the table again with the
same files and ``maxPartitionBytes`` gives the same shards; what is written stays as it is.

Defined results: null and empty texts give only the end id; repeated rows are kept, each
in its place; no two sequences have the same place, so there are no ties; an empty table
gives no shards; other columns are ignored.  A run at the same root replaces shard by
shard and then the manifest, which is written last, so a run that broke off can be
repeated there.  ``docs`` has to read the same twice (a table or a materialised frame).
"""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix
from .exchange import materialise, one
from .tokens import default_tokenizer, encoder

LENGTH = 1024
PER_SHARD = 8192  # places of a shard; a third to a half of them hold a sequence
ROUNDS = 6
END = 0


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    return mix(half ^ mix(np.array([key * ROUNDS + r], dtype=np.uint64))) & mask


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0 .. n-1, of every element of `index`."""
    half = _half_bits(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> shift, x & mask
        if inverse:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ _round(a, key, r, mask), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ _round(b, key, r, mask)
        out[todo] = (a << shift) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _streams(batches, path: str):
    encode = encoder(path)
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield doc, np.append(encode(text), END).astype(encode.kind)


_RECORD = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary())])


def _sequences(batches, path: str, length: int, bases, n: int, key: int, per_shard: int):
    """Records of one partition; memory holds a few hundred at a time."""
    from pyspark import TaskContext

    parts, ends = bases.value
    at = int(np.searchsorted(parts, TaskContext.get().partitionId()))
    number, stop = (int(ends[at]), int(ends[at + 1])) if at < len(parts) and parts[at] == TaskContext.get().partitionId() else (0, 0)
    rows: list[tuple[list, bytes]] = []
    docs, buffer, have = [], [], 0

    def emit(rows: list[tuple[list, bytes]], first: int) -> pa.RecordBatch:
        import zstandard

        if first + len(rows) > stop:
            raise RuntimeError("an input split did not read the same twice")
        place = permute(np.arange(first, first + len(rows)), n, key)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        width = np.dtype(encoder(path).kind).itemsize
        return pa.RecordBatch.from_arrays([pa.array(place // per_shard), pa.array(place), pa.array([len(x) // width for _, x in rows], pa.int32()), pa.array([d for d, _ in rows], pa.list_(pa.int64())), pa.array([squeeze(x) for _, x in rows], pa.binary())], schema=_RECORD)

    for doc, ids in _streams(batches, path):
        at = 0
        while at < len(ids):
            take = min(length - have, len(ids) - at)
            buffer.append(ids[at : at + take])
            docs.append(doc)
            have, at = have + take, at + take
            if have == length:
                rows.append((docs, np.concatenate(buffer).tobytes()))
                docs, buffer, have = [], [], 0
                if len(rows) == 256:
                    yield emit(rows, number)
                    number, rows = number + len(rows), []
    if have:
        rows.append((docs, np.concatenate(buffer).tobytes()))
    if rows:
        yield emit(rows, number)


_DDL = "shard long, rank long, place long, position long, n_tokens int, doc_ids array<long>, ids_crc32 long"
_OUT = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("place", pa.int64()), ("position", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids_crc32", pa.int64())])


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(table: pa.Table, root: str, stride: int) -> pa.Table:
    """One shard: written beside its place, then moved there, so that a task can run again."""
    import zstandard

    shard = table.column("shard")[0].as_py()
    table = table.sort_by("place")
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    part, final = f"{base}/.{shard_name(shard)}-{uuid.uuid4().hex}", f"{base}/{shard_name(shard)}"
    restore = zstandard.ZstdDecompressor().decompress
    sums = []
    with files.open_output_stream(part) as out:
        for raw in table.column("ids").to_pylist():
            ids = restore(raw)
            sums.append(zlib.crc32(ids))
            out.write(ids.ljust(stride, b"\0"))
    files.move(part, final)
    rank = np.arange(table.num_rows)
    return pa.table([table.column("shard"), pa.array(rank), table.column("place"), pa.array(rank * stride), table.column("n_tokens"), table.column("doc_ids"), pa.array(sums, pa.int64())], schema=_OUT)


def materialise_order(docs: DataFrame, root: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, tokenizer: str | None = None) -> DataFrame:
    """Writes shards and manifest under `root`, a URI that all executors reach.

    One row per sequence: slot, shard, byte position in it, permuted place, ids before
    padding, ids of the documents that it holds parts of, and its checksum.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select("doc_id", "text")
    size = F.ceil((F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)) + F.count(F.lit(1))) / F.lit(length)).cast("long")
    bounds = source.groupBy(F.spark_partition_id().alias("part")).agg(size.alias("n")).orderBy("part").collect()  # one row per input split
    ends = np.concatenate([[0], np.cumsum([r["n"] for r in bounds], dtype=np.int64)])
    n = int(ends[-1])
    bases = docs.sparkSession.sparkContext.broadcast((np.array([r["part"] for r in bounds], dtype=np.int64), ends))  # sixteen bytes per input split
    made = functools.partial(_sequences, path=path, length=length, bases=bases, n=n, key=key, per_shard=per_shard)
    records = source.mapInArrow(made, "shard long, place long, n_tokens int, doc_ids array<long>, ids binary")
    stride = length * np.dtype(encoder(path).kind).itemsize
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    written = materialise(records.groupBy("shard").applyInArrow(one(_write, root=root, stride=stride), schema=_DDL), "shards")
    counts = written.groupBy("shard").agg(F.count(F.lit(1)).alias("records"))
    before = F.sum("records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    counts.withColumn("first_slot", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest.parquet")
    manifest = docs.sparkSession.read.schema("shard long, records long, first_slot long").parquet(f"{root}/manifest.parquet")
    return written.join(manifest, "shard").select((F.col("first_slot") + F.col("rank")).alias("slot"), "shard", "position", "place", "n_tokens", "doc_ids", "ids_crc32")


def read_slots(root: str, manifest: list[tuple[int, int, int]], first: int, count: int, length: int = LENGTH, kind: str = "<u2") -> np.ndarray:
    """`count` consecutive records from slot `first` on: one seek per shard of (shard, records, first_slot)."""
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    stride = length * np.dtype(kind).itemsize
    out = [np.zeros((0, length), dtype=kind)]
    for shard, records, start in sorted(manifest, key=lambda m: m[2]):
        lo, hi = max(first, start), min(first + count, start + records)
        if lo < hi:
            with files.open_input_file(f"{base}/{shard_name(shard)}") as f:
                f.seek((lo - start) * stride)
                out.append(np.frombuffer(f.read((hi - lo) * stride), dtype=kind).reshape(-1, length))
    return np.concatenate(out)
