"""Parquet footers as a table: what each row group holds, which groups a range needs, and scans of those alone.

Footers are read in tasks, a few kilobytes of each file, through Arrow's file systems
(local files, HDFS and object stores).  Nothing of the data is read to decide.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.digests import listing

_TABLE = "path string, row_group int, column string, type string, rows long, start long, bytes long, n_null long, least string, most string"
FILES_PER_TASK = 64


def _opened(path: str) -> pq.ParquetFile:
    """Of a path in the form that Spark lists it."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    store, at = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(store.open_input_file(at))


def _text(value) -> str | None:
    """A bound as Spark would cast it to a string."""
    if value is None:
        return None
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
    if isinstance(value, bytes):
        return value.decode(errors="replace")
    return str(value) if isinstance(value, str | int | float | Decimal | datetime.date) else None


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            with _opened(path) as file:
                meta = file.metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        s = column.statistics
                        start = column.dictionary_page_offset if column.has_dictionary_page else column.data_page_offset
                        ends = (_text(s.min), _text(s.max)) if s is not None and s.has_min_max else (None, None)
                        rows.append((path, g, column.path_in_schema, column.physical_type, group.num_rows, start, column.total_compressed_size, s.null_count if s is not None and s.has_null_count else None, *ends))
        names = ["path", "row_group", "column", "type", "rows", "start", "bytes", "n_null", "least", "most"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, column, type, rows, start, bytes, n_null, least, most): a row for each column of each row group.

    Bounds are text as Spark casts it, and null where the file has none.
    """
    files = listing(spark, path).where(F.col("bytes") > 0).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).select("path")
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks).mapInArrow(_facts, _TABLE)


def kept_groups(zones: DataFrame, column: str, kind: str, low, high) -> DataFrame:
    """(path, row_group, rows, kept): whether a row group can hold `low <= column <= high`.

    `kind` is the type in which bounds compare.  Groups of nulls alone are not kept;
    without bounds a group is.
    """
    least, most = F.col("least").cast(kind), F.col("most").cast(kind)
    apart = (most < F.lit(low).cast(kind)) | (least > F.lit(high).cast(kind)) | (F.col("n_null") == F.col("rows"))
    return zones.where(F.col("column") == column).select("path", "row_group", "rows", (~F.coalesce(apart, F.lit(False))).alias("kept"))


def _scanned(batches: Iterable[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, group in zip(batch.column("path").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
            with _opened(path) as file:
                for part in file.iter_batches(10_000, row_groups=[group], columns=columns):
                    yield from pa.Table.from_batches([part]).select(columns).cast(schema).to_batches()


def scan(groups: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the given (path, row_group), in splits of one group each, with columns and types of `like`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = like.select(*columns)
    splits = groups.select("path", "row_group")
    tasks = max(1, splits.count())
    return splits.repartition(tasks, "path", "row_group").mapInArrow(functools.partial(_scanned, columns=columns, schema=to_arrow_schema(chosen.schema)), chosen.schema)


def facts(spark: SparkSession, path: str) -> dict:
    """Rows, columns, row groups, bytes and types of a table, from footers alone."""
    groups = footers(spark, path).groupBy("path", "row_group").agg(F.max("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    row = groups.agg(F.count(F.lit(1)).alias("row_groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    schema = spark.read.parquet(path).schema
    return row.asDict() | {"columns": len(schema), "types": {f.name: f.dataType.simpleString() for f in schema}}
