"""Digests of large files, footers as tables, and bounds of what is published."""

import hashlib
import os
from datetime import date

import duckdb
import pytest

from tidemark.sources import digests, files, footers


def plain(path, whole, unit):
    """The tree digest of a file, by reading it in one go."""
    raw = open(path, "rb").read()
    if len(raw) <= whole:
        return hashlib.sha256(raw).hexdigest()
    body = len(raw) - len(raw) % unit
    cuts = [raw[i : min(i + whole, body)] for i in range(0, body, whole)] + ([raw[body:]] if len(raw) % unit else [])
    return hashlib.sha256(b"".join(hashlib.sha256(c).digest() for c in cuts)).hexdigest()


@pytest.mark.parametrize("size", [0, 1, 4095, 65_536, 65_537, 131_072, 200_000, 262_144, 262_145, 1_000_003])
def test_digests_of_ranges(spark, tmp_path, size):
    path = tmp_path / "f.bin"
    path.write_bytes(os.urandom(size))
    row = digests.digests(spark, str(tmp_path), 65_536, 4_096).first()
    assert (row["bytes"], row["digest"]) == (size, plain(path, 65_536, 4_096))
    assert digests.digests(spark, str(path), 1 << 20, 4_096).first()["digest"] == hashlib.sha256(path.read_bytes()).hexdigest()


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Longer than any row can be; most of it is a hole, so that it takes no room."""
    path = tmp_path / "large.bin"
    size = 3 * (1 << 30) + 12_345
    with open(path, "wb") as f:
        f.truncate(size)
        for at in (0, 1 << 31, size - 100):
            f.seek(at)
            f.write(b"some bytes")
    row = digests.digests(spark, str(path)).first()
    want, ends = [], 0
    with open(path, "rb") as f:
        body = size - size % digests.UNIT
        while ends < body:
            part = f.read(min(digests.RANGE, body - ends))
            ends += len(part)
            want.append(hashlib.sha256(part).digest())
        want.append(hashlib.sha256(f.read()).digest())
    assert (row["bytes"], row["n_ranges"], row["digest"]) == (size, len(want), hashlib.sha256(b"".join(want)).hexdigest())


def test_combined_digest_sees_every_change(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "in/c"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    seen = [digests.combined(digests.digests(spark, str(tmp_path), 2048, 1024))]
    assert (seen[0]["files"], seen[0]["bytes"]) == (3, 6000)
    assert digests.combined(digests.digests(spark, str(tmp_path), 2048, 1024)) == seen[0]
    stat = os.stat(tmp_path / "in" / "c")
    (tmp_path / "in" / "c").write_bytes(b"in/d" * 1000)
    os.utime(tmp_path / "in" / "c", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    seen.append(digests.combined(digests.digests(spark, str(tmp_path), 2048, 1024)))
    (tmp_path / "b").rename(tmp_path / "z")
    seen.append(digests.combined(digests.digests(spark, str(tmp_path), 2048, 1024)))
    assert len({s["digest"] for s in seen}) == 3


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """A table of several files and row groups, nulls among its columns."""
    path = str(tmp_path_factory.mktemp("grouped") / "t")
    rows = spark.range(40_000).selectExpr("id", "if(id < 10000, null, id % 7) AS few", "date_add(date'2020-01-01', cast(id / 100 as int)) AS day", "timestamp_micros(id * 1000000000) AS at", "cast(id as string) AS name", "cast(null as double) AS nothing")
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.row.count.limit", 2_500).parquet(path)
    return path


def test_footers_are_those_of_the_files(spark, grouped):
    got = {(os.path.basename(r["path"]), r["row_group"], r["column"]): (r["rows"], r["bytes"], r["n_null"]) for r in footers.footers(spark, grouped).collect()}
    want = duckdb.sql(f"SELECT file_name, row_group_id, path_in_schema, row_group_num_rows, total_compressed_size, stats_null_count FROM parquet_metadata('{grouped}/*.parquet')").fetchall()
    assert got == {(os.path.basename(f), g, c): (n, b, z) for f, g, c, n, b, z in want}
    assert len({k[:2] for k in got}) >= 15
    facts = footers.facts(spark, grouped)
    assert (facts["rows"], facts["columns"], facts["row_groups"]) == (40_000, 6, len({k[:2] for k in got}))


@pytest.mark.parametrize(("column", "kind", "low", "high"), [("id", "long", 9_990, 12_600), ("day", "date", date(2020, 2, 1), date(2020, 2, 20)), ("name", "string", "12", "13"), ("few", "long", 1, 2), ("id", "long", 50_000, 60_000)])
def test_zone_map_keeps_the_groups_that_can_hold_a_range(spark, grouped, column, kind, low, high):
    zones = footers.footers(spark, grouped)
    kept = footers.kept_groups(zones, column, kind, low, high)
    got = {(os.path.basename(r["path"]), r["row_group"]) for r in kept.where("kept").collect()}
    cast = {"long": "BIGINT", "date": "DATE", "string": "VARCHAR"}[kind]
    want = duckdb.sql(f"SELECT file_name, row_group_id FROM parquet_metadata('{grouped}/*.parquet') WHERE path_in_schema = '{column}' AND stats_min_value::{cast} <= '{high}'::{cast} AND stats_max_value::{cast} >= '{low}'::{cast}").fetchall()
    assert got == {(os.path.basename(f), g) for f, g in want}
    like = spark.read.parquet(grouped)
    rows = footers.scan(kept.where("kept"), like, ["id", column] if column != "id" else ["id"])
    inside = rows[column].between(low, high)
    assert rows.where(inside).count() == like.where(like[column].between(low, high)).count()
    assert rows.count() == sum(r["rows"] for r in kept.where("kept").collect())


def test_scan_keeps_types(spark, grouped):
    like = spark.read.parquet(grouped)
    groups = footers.footers(spark, grouped).select("path", "row_group").distinct()
    back = footers.scan(groups, like, like.columns)
    assert back.schema == like.schema
    assert back.exceptAll(like).count() == like.exceptAll(back).count() == 0


def test_published_row_groups_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROW_GROUP_ROWS", 5_000)
    files.publish(spark.range(23_000).coalesce(1), str(tmp_path / "t"))
    sizes = [r[0] for r in duckdb.sql(f"SELECT row_group_num_rows FROM parquet_metadata('{tmp_path}/t/*.parquet')").fetchall()]
    assert sum(sizes) == 23_000 and max(sizes) <= 5_000
