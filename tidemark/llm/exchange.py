"""Two-way exchange of packed fingerprints between document groups and key buckets.

Corpus-wide questions about a fingerprint (in how many documents, in which
smallest one, how often) would take one shuffled row per word.  Here each group
of documents (about a megabyte of text in a corpus of a gigabyte) sends its *distinct* fingerprints as sorted packed
arrays, one blob per key bucket; a bucket merges the blobs and answers each group
with an array in the same order.  A fingerprint that a third of all documents
hold arrives once per group, so no bucket grows with its frequency.  Nothing is
broadcast or collected, and every step is a shuffle that recovers from lineage.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import release

#: Bytes of text of a group are the square root of this times the corpus, and of a bucket likewise, so that the
#: number of blobs, groups times buckets, grows as the corpus does; what a task holds bounds both.
GROUP_SCALE, GROUP_LEAST, GROUP_MOST = 2_000, 250_000, 48_000_000
BUCKET_SCALE, BUCKET_LEAST, BUCKET_MOST = 72_000, 1_000_000, 96_000_000
PART_BYTES, PARTS_MOST = 8_000_000, 50_000
#: Equal rows are counted instead of kept where there are more of them than this, and than a group has rows.
REPEATS_LEAST = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one machine, where none is set, takes a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/tidemark-shared"
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of `materialise` that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tidemark/"
    below = {f.split("/tidemark/", 1)[1].split("/", 1)[0] for f in df.inputFiles()[:1] if "/tidemark/" in f}
    for name in below:
        path = spark._jvm.org.apache.hadoop.fs.Path(root + name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_groups(grouped: DataFrame, parts: int, name: str) -> DataFrame:
    """Rows with their group `g`, dealt once and stored in buckets by it: grouping by `g` needs no shuffle any more."""
    spark = grouped.sparkSession
    table = f"tidemark_{uuid.uuid4().hex}"
    grouped.repartition(parts, "g").write.bucketBy(parts, "g").option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


class Plan:
    """Sizes for one corpus: how many document groups, key buckets and partitions."""

    def __init__(self, docs: DataFrame, text: str = "text", group_bytes: int | None = None, bucket_bytes: int | None = None) -> None:
        row = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
        self.bytes, self.rows = int(row["b"]), int(row["n"])
        group = group_bytes or min(max(math.sqrt(GROUP_SCALE * self.bytes), GROUP_LEAST), GROUP_MOST)
        bucket = bucket_bytes or min(max(math.sqrt(BUCKET_SCALE * self.bytes), BUCKET_LEAST), BUCKET_MOST)
        self.groups = max(64, math.ceil(self.bytes / group))
        self.bits = max(6, math.ceil(math.log2(max(1, self.bytes / bucket))))
        self.parts = min(max(12, math.ceil(self.bytes / PART_BYTES)), PARTS_MOST)

    def reduced(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, text, ...) with `copies`: rows equal in all columns that would fill a group are one row.

        Fewer rows than there are groups are that often repeated, so their hashes may be
        broadcast; each of them is counted before it is shuffled.  All other rows stand
        for themselves.
        """
        h = F.xxhash64("doc_id", "text").alias("_h")
        many = rows.select(h).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(REPEATS_LEAST, self.rows / self.groups))
        many = materialise(many.select("_h"), "repeats")
        single = rows.withColumn("copies", F.lit(1).cast("long"))
        if many.isEmpty():
            return single
        keyed = rows.select("*", h)
        light = keyed.join(F.broadcast(many), "_h", "left_anti").select(*rows.columns, F.lit(1).cast("long").alias("copies"))
        heavy = keyed.join(F.broadcast(many), "_h", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
        return light.unionByName(materialise(heavy, "repeated"))

    def grouped(self, docs: DataFrame, *columns) -> DataFrame:
        """Documents with `copies` and their group, which follows from id and text; `expanded` undoes `copies`."""
        rows = self.reduced(docs.select("doc_id", "text", *columns))
        g = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.groups)).cast("int").alias("g")
        return rows.select(g, "*").repartition(self.parts, "g")


def expanded(rows: DataFrame) -> DataFrame:
    """Each row as often as its `copies` say."""
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return rows.withColumn("_copy", again).drop("_copy", "copies")


BLOB = "bucket int, g int, keys binary, vals binary"
REPLY = "g int, bucket int, kind int, vals binary"


def pack(g: int, keys: np.ndarray, bits: int, vals: np.ndarray | None = None, bucket_base: int = 0) -> list[tuple]:
    """Sorted distinct 64-bit keys as one blob per bucket (their top bits)."""
    edges = np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)))
    edges = np.concatenate([[0], edges, [len(keys)]])
    out = []
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        out.append((bucket_base + int(b), g, keys[lo:hi], None if vals is None else vals[lo:hi]))
    return out


def shorten(keys: np.ndarray, bits: int, width: int) -> bytes:
    """The `width` bytes of each key that follow its bucket bits, big end first."""
    left = (keys << np.uint64(bits)).astype(">u8")
    return np.ascontiguousarray(left.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def lengthen(raw: bytes, width: int) -> np.ndarray:
    """Inverse of shorten up to the bucket bits: comparable 64-bit values."""
    cells = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(cells), 8), dtype=np.uint8)
    out[:, :width] = cells
    return out.view(">u8").ravel().astype(np.uint64)


def blob_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    if not rows:
        return schema.empty_table()
    return pa.table({f.name: pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)}, schema=schema)


BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY_SCHEMA = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("vals", pa.binary())])


def ask(grouped: DataFrame, send: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Blobs of every group."""
    return grouped.groupBy("g").applyInArrow(send, schema=BLOB)


def answer(blobs: DataFrame, merge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Replies of every bucket."""
    return blobs.groupBy("bucket").applyInArrow(merge, schema=REPLY)


def merged(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Keys of one bucket: (which distinct key each entry is, distinct keys, groups, entry offsets)."""
    raws = table.column("keys").to_pylist()
    groups = table.column("g").to_pylist()
    sizes = np.array([len(r) // width for r in raws], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keys = lengthen(b"".join(raws), width)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    index = np.empty(len(keys), dtype=np.int64)
    index[order] = np.cumsum(new) - 1
    return index, ordered[new], groups, offsets


def replies_of(table: pa.Table, kind: int, sizes: dict[int, int] | None = None) -> dict[int, bytes]:
    """Reply of each bucket to this group, by bucket."""
    return {b: v for b, k, v in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("vals").to_pylist(), strict=True) if k == kind}


def one(function: Callable, **fixed) -> Callable[[pa.Table], pa.Table]:
    """`function` of one table with its other arguments fixed, in the form applyInArrow takes."""

    def run(table: pa.Table) -> pa.Table:
        out = function(table, **fixed)
        release()
        return out

    return run


def two(function: Callable, **fixed) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two tables, for cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right, **fixed)
        release()
        return out

    return run
