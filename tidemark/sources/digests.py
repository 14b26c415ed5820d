"""SHA-256 of files of any size, as a tree: ranges are hashed in tasks, and a file by its ranges.

A file of at most `RANGE` bytes has its plain SHA-256.  A larger one is cut into ranges of
that size, read `UNIT` bytes at a time through Spark's record reader, which opens whatever
store Spark reads; bytes after the last whole unit are a range of their own.  Its digest
is the SHA-256 of the digests of its ranges, one after the other.  No task holds more than
a unit of a large file, or one small file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 32 << 20
UNIT = 64 << 10
_FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"
_PART = "path string, range long, bytes long, sha256 string"


def _empty(spark: SparkSession, path: str) -> list[tuple]:
    """(path, changed) of the files without bytes, which Spark's reader passes over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    found = store.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getModificationTime()))
    return out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, changed) of the files below a path; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    held = found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
    empty = spark.createDataFrame(_empty(spark, path), "path string, at long")
    return held.unionByName(empty.select("path", F.lit(0).cast("long").alias("bytes"), F.timestamp_millis("at").alias("changed")))


def _hashed(units: Iterable[tuple[int, bytes]], per_range: int) -> Iterator[tuple[int, int, str]]:
    """(range, bytes, sha256) of the ranges that a split holds: splits are made of whole ranges."""
    now, size, digest = None, 0, hashlib.sha256()
    for index, raw in units:
        if now is not None and index // per_range != now:
            yield now, size, digest.hexdigest()
            size, digest = 0, hashlib.sha256()
        now, size = index // per_range, size + len(raw)
        digest.update(raw)
    if now is not None:
        yield now, size, digest.hexdigest()


def _tail(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    """Less than a unit from the end of a file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _large(spark: SparkSession, path: str, size: int, whole: int, unit: int):
    """Rows of the ranges of one file of more than a range."""
    sc, per_range = spark.sparkContext, whole // unit
    wanted = {f"{_FORMAT}.recordLength": str(unit)} | {f"mapreduce.input.fileinputformat.split.{end}size": str(whole) for end in ("min", "max")}
    # the reader ends with an error at what is left after the last unit; all bytes are counted afterwards
    settings = sc._jsc.sc().conf()
    before = settings.get("spark.files.ignoreCorruptFiles", "false")
    settings.set("spark.files.ignoreCorruptFiles", "true")
    try:
        units = sc.newAPIHadoopFile(path, _FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=wanted)
    finally:
        settings.set("spark.files.ignoreCorruptFiles", before)
    rows = units.mapPartitions(lambda part: ((path, *found) for found in _hashed(part, per_range)))
    if size % unit:
        raw = _tail(spark, path, size - size % unit, size % unit)
        rows = rows.union(sc.parallelize([(path, -(-(size // unit) // per_range), len(raw), hashlib.sha256(raw).hexdigest())], 1))
    return rows


def ranges(spark: SparkSession, path: str, whole: int = RANGE, unit: int = UNIT) -> DataFrame:
    """(path, range, bytes, sha256) of every range of every file below a path."""
    if whole % unit:
        raise ValueError("a range is made of whole units")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    empty = spark.createDataFrame([(p, 0, 0, hashlib.sha256(b"").hexdigest()) for p, _ in _empty(spark, path)], _PART)
    out = files.where(F.col("length") <= whole).select("path", F.lit(0).cast("long").alias("range"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).unionByName(empty)
    large = [_large(spark, r["path"], r["bytes"], whole, unit) for r in listing(spark, path).where(F.col("bytes") > whole).collect()]  # a row per large file
    return out.unionByName(spark.createDataFrame(spark.sparkContext.union(large), _PART)) if large else out


def digests(spark: SparkSession, path: str, whole: int = RANGE, unit: int = UNIT) -> DataFrame:
    """(path, bytes, changed, n_ranges, digest) of every file; equal before and after if nothing touched it."""
    parts = F.array_sort(F.collect_list(F.struct("range", "sha256")))  # of one file
    found = ranges(spark, path, whole, unit).groupBy("path").agg(F.sum("bytes").alias("read"), parts.alias("parts"))
    joined = F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: p["sha256"]), "")), 256)
    rows = listing(spark, path).join(found, "path", "left")
    short = F.raise_error(F.concat(F.lit("not all bytes could be read of "), "path")).cast("string")
    digest = F.when(~F.col("bytes").eqNullSafe(F.col("read")), short).when(F.size("parts") == 1, F.col("parts")[0]["sha256"]).otherwise(joined)
    return rows.select("path", "bytes", "changed", F.size("parts").cast("long").alias("n_ranges"), digest.alias("digest"))


def combined(found: DataFrame) -> dict:
    """One digest over all files with their names, sizes and times of change, and how many they are.

    Files are put in order within 256 groups by name, and these among each other.
    """
    line = F.concat_ws("|", "path", "bytes", F.unix_micros("changed"), "digest")
    groups = found.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    row = groups.agg(F.array_join(F.array_sort(F.collect_list(F.concat("g", "d"))), ""), F.sum("n"), F.sum("b")).first()
    return {"files": row[1] or 0, "bytes": row[2] or 0, "digest": hashlib.sha256((row[0] or "").encode()).hexdigest()}
