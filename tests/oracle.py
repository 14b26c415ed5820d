"""Comparison of a query with its DuckDB statement on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    table = con.execute(sql).to_arrow_table()
    return table.column_names, [tuple(r.values()) for r in table.to_pylist()]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return value


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(columns, rows)
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want, strict=True) if a != b)
