"""Joins with the guarantees that enrichment needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import null_if_blank
from tidemark.operators.sequences import in_blocks, own_rows


def unique(dim: DataFrame, keys: list[str]) -> DataFrame:
    """`dim` with one row for each key; a key that occurs twice is an error of the query that reads it, nulls count as a key.

    The check is a filter on the aggregate that the join's shuffle needs anyway, so it
    adds neither a job nor a shuffle.  The partition number in it, of any value, keeps the
    optimiser from dropping null keys before they are counted.  Only a reader that uses no
    column of `dim` (nor an indicator) does not check it, as it does not read it at all.
    """
    values = [c for c in dim.columns if c not in keys]
    one = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in values))
    broken = F.raise_error(F.lit(f"{keys} is not unique")).cast("boolean")
    return one.where(F.when(F.col("_n") > 1, broken).otherwise(F.spark_partition_id() >= 0)).select(*keys, *values)


def many_to_one(base: DataFrame, dim: DataFrame, keys: list[str], matched: str | None = None) -> DataFrame:
    """LEFT join that keeps the row count, checked as it runs; `matched` names an indicator column."""
    dim = unique(dim, keys)
    if matched:
        dim = dim.withColumn(matched, F.lit(True))
    out = base.join(dim, keys, "left")
    return out.withColumn(matched, F.coalesce(matched, F.lit(False))) if matched else out


def match_statistics(joined: DataFrame, indicators: dict[str, str]) -> DataFrame:
    """(source, n_rows, n_matched, n_unmatched, pct_matched): by the indicator column of each joined source, in one pass."""
    row = joined.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"m{i}") for i, c in enumerate(indicators.values())))
    m = [F.col(f"m{i}") for i in range(len(indicators))]
    cells = [F.struct(F.lit(s).alias("source"), F.col("n").alias("n_rows"), x.alias("n_matched"), (F.col("n") - x).alias("n_unmatched"), F.round(F.try_divide(100 * x, F.col("n")), 6).alias("pct_matched")) for s, x in zip(indicators, m, strict=True)]
    return row.select(F.inline(F.array(*cells)))


def kept_grain(base: DataFrame, joined: DataFrame, keys: list[str]) -> DataFrame:
    """(n_base, n_joined, base_duplicates, joined_duplicates, kept): rows before and after, and rows beyond the first of each key."""
    def facts(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{name}_duplicates"))

    both = facts(base, "base").crossJoin(F.broadcast(facts(joined, "joined")))  # one row each
    kept = (F.col("n_base") == F.col("n_joined")) & (F.col("base_duplicates") == F.col("joined_duplicates"))
    return both.select("n_base", "n_joined", "base_duplicates", "joined_duplicates", kept.alias("kept"))


def scope_expand(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events (day, kind, scope, scope_name, note, moved) to places (place, region, town), collapsed by day.

    National events reach every place, regional and local ones those whose region or
    town has their name; an event counts as a holiday unless moved or a work day.
    """
    named = {"Regional": "region", "Local": "town"}
    branches = [events.where("scope = 'National'").crossJoin(places.select("place"))]
    for scope, column in named.items():
        branches.append(events.where(F.col("scope") == scope).join(places.select("place", F.col(column).alias("scope_name")), "scope_name").select(*events.columns, "place"))
    every = branches[0]
    for b in branches[1:]:
        every = every.unionByName(b)
    holiday = ~F.col("moved") & (F.col("kind") != "Work Day")
    return every.groupBy("day", "place").agg(F.bool_or(holiday).alias("is_holiday"), distinct_text("note").alias("notes"), distinct_text("kind").alias("kinds"), distinct_text("scope").alias("scopes"), F.bool_or("moved").alias("any_moved"), F.count(F.lit(1)).alias("n_events"))


def distinct_text(column: str, sep: str = " | ") -> Column:
    """Distinct non-blank values in order, joined; null if there are none."""
    value = null_if_blank(F.col(column))
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), sep), F.lit(""))


def exact_offset(df: DataFrame, keys: list[str], day: str, value: str, offsets: list[int]) -> DataFrame:
    """Value of exactly k days before, null where that day has no row: windows over blocks of each series."""
    rows = in_blocks(df, keys, day, max(offsets))
    at = Window.partitionBy(*keys, "_block").orderBy(F.unix_date(day))
    return own_rows(rows.withColumns({f"lag_{k}": F.max(value).over(at.rangeBetween(-k, -k)) for k in offsets}))


def around(cases: DataFrame, facts: DataFrame, keys: list[str], day: str, days: int = 7) -> DataFrame:
    """Facts within `days` of a case of the same keys, with the signed distance.

    Both sides meet by keys and a bin of days, a case in its own bin and the two beside
    it, so that neither a busy series nor many cases need a broadcast or one task.
    """
    width = max(1, days)
    own = F.floor(F.unix_date(day) / width)
    near = F.array(own - 1, own, own + 1)
    c = cases.select("case_id", *keys, F.col(day).alias("case_day"), F.explode(near).alias("_bin"))
    met = c.join(facts.withColumn("_bin", own), [*keys, "_bin"]).drop("_bin")
    distance = F.datediff(day, "case_day")
    return met.where(F.abs(distance) <= days).withColumn("relative_day", distance)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent."""
    return child.select(F.col(child_key).alias("key")).where("key is not null").distinct().join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def latest_at(history: DataFrame, keys: list[str], day: str, columns: list[str], origin: Column, ties: list[str] = ()) -> DataFrame:
    """Columns of the last row at or before `origin`, by key; of rows of one day, that with the greatest `ties`."""
    row = F.max_by(F.struct(*columns), F.struct(day, *ties))
    return history.where(F.col(day) <= origin).groupBy(*keys).agg(row.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def attributes(base: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """LEFT join to one row of attributes for each key; a key without one, with two, or with a null attribute is an error."""
    values = [c for c in dim.columns if c not in keys]
    one = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in values))
    out = base.join(one, keys, "left")
    wrong = F.when(F.col("_n").isNull(), "unmatched key").when(F.col("_n") > 1, "repeated key")
    for c in values:
        wrong = wrong.when(F.col(c).isNull(), f"null {c}")
    return out.withColumn(values[0], F.when(wrong.isNotNull(), F.raise_error(wrong).cast(dim.schema[values[0]].dataType)).otherwise(F.col(values[0]))).drop("_n")


def looked_up(rows: DataFrame, table: dict, column: str, name: str) -> DataFrame:
    """`name`: what a small dictionary holds for a column; a miss is an error, null stays null."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.element_at(pairs, F.col(column))
    missed = F.col(column).isNotNull() & ~F.map_contains_key(pairs, F.coalesce(F.col(column), F.lit(next(iter(table)))))
    kind = rows.select(F.element_at(pairs, F.lit(next(iter(table))))).schema[0].dataType
    return rows.withColumn(name, F.when(missed, F.raise_error(F.concat(F.lit(f"{column} has no entry for "), F.col(column).cast("string"))).cast(kind)).otherwise(found))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with how often."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right"))).groupBy("side").count()


def compared(source: DataFrame, copy: DataFrame, keys: list[str]) -> DataFrame:
    """(column, n_pairs, n_differ, only_source, only_copy): column by column, null equal to null, for rows paired by key.

    Rows that repeat a key are paired in the order of their other columns.
    """
    if source.columns != copy.columns:
        raise ValueError("columns or their order differ")
    values = [c for c in source.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(*values)
    left, right = (df.withColumn("_k", F.row_number().over(order)).select(*keys, "_k", F.struct(*values).alias(side)) for df, side in ((source, "_s"), (copy, "_c")))
    both = left.join(right, [*keys, "_k"], "full")
    paired = F.col("_s").isNotNull() & F.col("_c").isNotNull()
    sums = [F.count_if(paired & ~F.col(f"_s.{c}").eqNullSafe(F.col(f"_c.{c}"))).alias(f"d{i}") for i, c in enumerate(values)]
    row = both.agg(F.count_if(paired).alias("n_pairs"), F.count_if(F.col("_c").isNull()).alias("only_source"), F.count_if(F.col("_s").isNull()).alias("only_copy"), *sums)
    pairs = ", ".join(f"'{c}', d{i}" for i, c in enumerate(values))
    return row.selectExpr("n_pairs", "only_source", "only_copy", f"stack({len(values)}, {pairs}) as (column, n_differ)").select("column", "n_pairs", "n_differ", "only_source", "only_copy")


def positioned(rows: DataFrame) -> DataFrame:
    """Rows of a Parquet table with `_position`, their place in the order of its files and within each.

    Places follow from the file, the row's index in it and how many rows the files before
    hold (a row per file), so nothing is sorted.
    """
    held = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = held.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_start"))
    return held.join(F.broadcast(starts), "_file").withColumn("_position", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def compared_in_order(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(column, n_pairs, n_differ, first, only_source, only_copy): two Parquet tables row by row in their order, null equal to null.

    `first` is the first position at which a column differs.
    """
    if source.columns != copy.columns:
        raise ValueError("columns or their order differ")
    columns = source.columns
    left, right = (positioned(df).select("_position", F.struct(*columns).alias(side)) for df, side in ((source, "_s"), (copy, "_c")))
    both = left.join(right, "_position", "full")
    paired = F.col("_s").isNotNull() & F.col("_c").isNotNull()
    differ = [paired & ~F.col(f"_s.{c}").eqNullSafe(F.col(f"_c.{c}")) for c in columns]
    facts = [F.count_if(paired).alias("n_pairs"), F.count_if(F.col("_c").isNull()).alias("only_source"), F.count_if(F.col("_s").isNull()).alias("only_copy")]
    row = both.agg(*facts, *(F.count_if(d).alias(f"d{i}") for i, d in enumerate(differ)), *(F.min(F.when(d, F.col("_position"))).alias(f"p{i}") for i, d in enumerate(differ)))
    cells = [F.struct(F.lit(c).alias("column"), F.col("n_pairs"), F.col(f"d{i}").alias("n_differ"), F.col(f"p{i}").alias("first"), F.col("only_source"), F.col("only_copy")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))
