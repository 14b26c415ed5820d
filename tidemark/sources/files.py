"""Reading with declared schemas, and publishing with checks."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bounds of a published table's row groups.
ROW_GROUP_BYTES, ROW_GROUP_ROWS = 128 << 20, 250_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, or in a local one on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/tidemark-shared"
    return f"{at.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, dates: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header and a declared schema; only the wanted columns are parsed, dates in the form `dates`.

    A header that differs from the schema, or a field that does not parse, is an error.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("dateFormat", dates).csv(path)
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str) -> DataFrame:
    """(position, column) of a CSV with a header; no rows are parsed."""
    names = spark.read.option("header", True).csv(path).columns
    return spark.createDataFrame(list(enumerate(names)), "position int, column string")


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order."""
    if n < 1:
        raise ValueError("a preview has at least one row")
    return df.orderBy(*order).limit(n)


def slice_of(df: DataFrame, day: str, first: date, last: date, key: str, values: list, columns: list[str]) -> DataFrame:
    """Projected date range and key list, both of which reach the Parquet scan."""
    return df.where(F.col(day).between(first, last) & F.col(key).isin(values)).select(*columns)


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) of a frame."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def reconciled(df: DataFrame, rows: int) -> DataFrame:
    """`df`, after a count that has to agree with what a footer or an earlier count says."""
    seen = df.count()
    if seen != rows:
        raise ValueError(f"{seen} rows where {rows} were expected")
    return df


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the files below a path, from the file system's listing alone."""
    files, at = _hadoop(spark, path)
    found, rows = files.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().getName(), f.getLen()))
    return spark.createDataFrame(rows, "name string, bytes long")


def require_files(spark: SparkSession, path: str, names: list[str]) -> None:
    """Raise with the names that are not below a path."""
    files, at = _hadoop(spark, path)
    missing = [n for n in names if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, n))]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(sorted(missing))}")


def plain(value):
    """JSON form of driver-side scalars."""
    if isinstance(value, date | datetime):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    raise TypeError(type(value).__name__)


def _written(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\0").mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str, require: dict | None = None) -> dict:
    """A document that `write_json` or `publish` wrote; raise unless it holds what is required."""
    found = json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()).rstrip("\0"))
    wrong = {k: found.get(k) for k, v in (require or {}).items() if found.get(k) != v}
    if wrong:
        raise ValueError(f"{path} does not hold what is required: {wrong}")
    return found


def _staged_json(spark: SparkSession, document: dict, path: str) -> tuple[str, dict]:
    """A document written beside its place and read back: where it is staged, and what it holds."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    text = json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=plain)
    try:
        _written(spark, text, staged)
        if read_json(spark, staged) != json.loads(text):
            raise ValueError("what was read back is not what was written")
    except BaseException:
        _delete(spark, staged)
        raise
    return staged, json.loads(text)


def aggregates_only(document, most: int = 100) -> None:
    """Raise if evidence holds raw rows: a list of more than `most` entries is taken for them."""
    if isinstance(document, list | tuple) and len(document) > most:
        raise ValueError("evidence holds aggregates, not rows")
    for v in document.values() if isinstance(document, dict) else document if isinstance(document, list | tuple) else ():
        aggregates_only(v, most)


def write_json(spark: SparkSession, document: dict, path: str, overwrite: bool = False, evidence: bool = False) -> dict:
    """Stable JSON, staged, read back and moved into place; not over another one unasked.

    With `evidence` the document has to pass `aggregates_only` before anything is written.
    """
    if evidence:
        aggregates_only(document)
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    staged, held = _staged_json(spark, document, path)
    _place(spark, {staged: path})
    return held


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def _place(spark: SparkSession, moves: dict[str, str]) -> None:
    """Move staged folders to their places, all or none: old ones are moved aside first, and back if a move fails."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    done: list[tuple] = []
    try:
        for staged, path in moves.items():
            files, to = _hadoop(spark, path)
            aside = made(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}") if files.exists(to) else None
            if aside is not None and not files.rename(to, aside):
                raise OSError(f"{path} could not be moved aside")
            done.append((files, to, aside))
            if not files.rename(made(staged), to):
                raise OSError(f"{staged} could not be moved to {path}")
    except BaseException:
        for files, to, aside in reversed(done):
            files.delete(to, True)
            if aside is not None:
                files.rename(aside, to)
        for staged in moves:
            _delete(spark, staged)
        raise
    for files, _, aside in done:
        if aside is not None:
            files.delete(aside, True)


def write_bounded(df: DataFrame, path: str) -> None:
    """zstd Parquet with bounded row groups and files, at a new path."""
    df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", 50_000_000).option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)


def make_folder(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.mkdirs(at)


def _named(spark: SparkSession, path: str, prefix: str) -> list:
    """Paths of the files of a folder whose names begin with a prefix."""
    files, at = _hadoop(spark, path)
    return [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith(prefix)]


def remove_named(spark: SparkSession, path: str, prefix: str) -> None:
    files, _ = _hadoop(spark, path)
    for p in _named(spark, path, prefix):
        files.delete(p, True)


def move_into(spark: SparkSession, folder: str, to: str, prefix: str) -> int:
    """Move the part files of a folder into another one under names of their own, and drop the folder; their number."""
    files, _ = _hadoop(spark, to)
    parts = _named(spark, folder, "part-")
    for p in parts:
        if not files.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to, prefix + p.getName())):
            raise OSError(f"{p} could not be moved to {to}")
    _delete(spark, folder)
    return len(parts)


def place_with(spark: SparkSession, table: str, path: str, documents: dict[str, dict]) -> None:
    """Move a finished table and its documents into place together."""
    moves = {table: path.rstrip("/")}
    try:
        for at, document in documents.items():
            moves[_staged_json(spark, document, at)[0]] = at
    except BaseException:
        for staged in list(moves)[1:]:
            _delete(spark, staged)
        raise
    _place(spark, moves)


def publish(df: DataFrame, path: str, overwrite: bool = False, extra: dict | None = None, check=None, beside=None) -> dict:
    """Write zstd Parquet with a manifest; never an empty table, never over data unasked.

    The table is written to a staging path beside its place, where it is counted and
    hashed as it is written, read back and compared, and `check` (of the frame that was
    read) may raise.  Its manifest is staged as well, and so are the documents that
    `beside` makes of it (by path).  Only when all of them lie there they move into place
    together; on an error nothing of them is left, and what was there stays.  Row groups
    are bounded by `ROW_GROUP_BYTES`, files by their rows.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    if exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} exists")
    moves = {f"{path}.staged-{uuid.uuid4().hex}": path}
    try:
        staged = next(iter(moves))
        seen = Observation()
        row_hash = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
        measured = df.observe(seen, F.count(F.lit(1)).alias("rows"), row_hash.alias("hash"))
        write_bounded(measured, staged)
        wrote = seen.get
        if not wrote["rows"]:
            raise ValueError("nothing to publish")
        back = spark.read.parquet(staged)
        read = back.agg(F.count(F.lit(1)).alias("rows"), row_hash.alias("hash")).first()
        if (read["rows"], read["hash"]) != (wrote["rows"], wrote["hash"]) or [f.dataType for f in back.schema] != [f.dataType for f in df.schema]:
            raise ValueError("what was read back is not what was written")
        facts = check(back) if check else None
        manifest = {"rows": wrote["rows"], "row_hash": str(wrote["hash"]), "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]} | (extra or {}) | ({"checked": facts} if facts else {})
        for at, document in ({f"{path}.manifest": manifest} | (beside(manifest) if beside else {})).items():
            moves[_staged_json(spark, document, at)[0]] = at
    except BaseException:
        for staged in moves:
            _delete(spark, staged)
        raise
    _place(spark, moves)
    return read_json(spark, f"{path}.manifest")
