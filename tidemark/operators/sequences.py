"""Calendar-aware sequences: islands, complete windows, extrema, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: (keys, start, end, days). Rows are distinct (keys, day)."""
    order = Window.partitionBy(*keys).orderBy(day)
    return days.select(*keys, day, F.date_sub(day, F.row_number().over(order)).alias("_g")).groupBy(*keys, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("days")).drop("_g")


def longest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of each key, the earliest of equals."""
    order = Window.partitionBy(*keys).orderBy(F.col("days").desc(), "start")
    return runs.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def in_blocks(df: DataFrame, keys: list[str], day: str, back: int, days: int | None = None) -> DataFrame:
    """Rows with `_block`, a stretch of days of their series, and `_own`: false for copies of the `back` days before it.

    A frame of at most `back` days lies within the block of its row, so a window over
    (keys, `_block`) needs no whole series in one task.  Blocks are at least eight times as
    long as what is copied into them.
    """
    size = days or max(64, 8 * back)
    at = F.unix_date(day)
    first, last = F.floor(at / size), F.floor((at + back) / size)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == F.floor(at / size))


def own_rows(df: DataFrame) -> DataFrame:
    """The rows of `in_blocks` themselves, without what was copied."""
    return df.where("_own").drop("_block", "_own")


def complete(fn, value: str, width: int, keys: list[str], day: str, last: int = -1) -> Column:
    """`fn` over the `width` days that end `-last` days ago, null unless each has one non-null row.

    For long series the rows come from `in_blocks`, with `_block` among the keys.
    """
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(last - width + 1, last)
    full = (F.count(F.lit(1)).over(frame) == width) & (F.count(value).over(frame) == width)
    return F.when(full, fn(value).over(frame))


def nearest_known(df: DataFrame, keys: list[str], day: str, value: str, days: int = 256) -> DataFrame:
    """Rows with `previous`, `next`: the nearest non-null values before and after each row of its series, and their days.

    Known values are carried within blocks of days, and from block to block through one
    row for each block, so a series may be of any length and a gap of any width.  Rows of
    one day see each other's values neither before nor after.
    """
    at = F.floor(F.unix_date(day) / days)
    rows = df.withColumns({"_block": at, "_known": F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("day"), F.col(value).alias("value")))})
    block = Window.partitionBy(*keys, "_block").orderBy(F.unix_date(day))
    inside = {"_before": F.last("_known", ignorenulls=True).over(block.rangeBetween(Window.unboundedPreceding, -1)), "_after": F.first("_known", ignorenulls=True).over(block.rangeBetween(1, Window.unboundedFollowing))}
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.unix_date(day))).alias("_last"), F.min_by("_known", F.when(F.col("_known").isNotNull(), F.unix_date(day))).alias("_first"))
    series = Window.partitionBy(*keys).orderBy("_block")  # a row per block
    carried = {"_from": F.last("_last", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1)), "_to": F.first("_first", ignorenulls=True).over(series.rowsBetween(1, Window.unboundedFollowing))}
    carried = ends.withColumns(carried).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), "_from", "_to")
    met = rows.withColumns(inside).join(carried, [*(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_block") == F.col("_b")])
    before, after = F.coalesce("_before", "_from"), F.coalesce("_after", "_to")
    return met.select(*df.columns, before["value"].alias("previous"), before["day"].alias("previous_day"), after["value"].alias("next"), after["day"].alias("next_day"))


def peak(day: str, value: str, lowest: bool = False) -> Column:
    """Day of the largest (or smallest) value, the earliest of ties."""
    if lowest:
        return F.min_by(day, F.struct(F.col(value), F.unix_date(day)))
    return F.max_by(day, F.struct(F.col(value), -F.unix_date(day)))


def from_then_on(condition: Column, order: list[str], keys: list[str]) -> Column:
    """Whether a condition holds on this row and all later ones."""
    return F.min(condition.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)) == 1


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def largest(df: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    """Top n by a column, nulls left out, ties by the given columns."""
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), *ties).limit(n)


def smallest(df: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    """The lowest n by a column, nulls left out, ties by the given columns."""
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column), *ties).limit(n)


def order_breaks(df: DataFrame, index: str, keys: list[str], block: int = 100_000) -> DataFrame:
    """(rows, breaks): in how many rows the keys do not exceed those of the row before, by index.

    Rows are compared within blocks of the index, and block ends with the next block's
    start, so that no task sees more than a block; rows without an index do not count.
    """
    order = Window.partitionBy("_b").orderBy(index)
    rows = df.where(F.col(index).isNotNull()).select(index, F.struct(*keys).alias("_s"), F.floor(F.col(index) / block).alias("_b"))
    rows = rows.withColumn("_x", F.col("_s") <= F.lag("_s").over(order))
    blocks = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_x").alias("breaks"), F.min_by("_s", index).alias("_first"), F.max_by("_s", index).alias("_last"))
    joint = F.when(F.col("_first") <= F.lag("_last").over(Window.orderBy("_b")), 1).otherwise(0)  # a row per block
    return blocks.withColumn("_j", joint).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("breaks") + F.col("_j")), F.lit(0)).alias("breaks"))


def differenced(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Rows with `gap`, the days since the row before of their key, and `change`, the difference of values."""
    order = Window.partitionBy(*keys).orderBy(day)
    return df.withColumns({"gap": F.datediff(day, F.lag(day).over(order)), "change": F.col(value) - F.lag(value).over(order)})


def chosen(totals: DataFrame, key: str, value: str, n: int, asked: list = (), most: int = 10) -> DataFrame:
    """The n largest keys and the ones asked for, each once; n is 1 to `most`, and an unknown key is an error."""
    if not 1 <= n <= most:
        raise ValueError(f"n must be within 1 and {most}")
    asked = list(dict.fromkeys(asked))
    found = totals.where(F.col(key).isin(list(asked)))
    if found.count() != len(asked):
        raise ValueError("a key that is asked for does not occur")
    return largest(totals, value, n, [key]).union(found).distinct()


def span_of(notes: DataFrame, column: str, word: str) -> DataFrame:
    """(first, last) day of the notes that hold a word, in any case."""
    return notes.where(F.contains(F.lower(F.col(column)), F.lit(word.lower()))).agg(F.min("day").alias("first"), F.max("day").alias("last"))


def against_baseline(rows: DataFrame, span: DataFrame, day: str, value: str) -> DataFrame:
    """A span of days, and the spans of equal length before and after it, each against both of these."""
    size = F.datediff("last", "first") + 1
    d = F.col(day)
    period = F.when(d.between(F.col("first"), F.col("last")), "during").when(d.between(F.date_sub("first", size), F.date_sub("first", 1)), "before").when(d.between(F.date_add("last", 1), F.date_add("last", size)), "after")
    near = rows.crossJoin(F.broadcast(span)).withColumn("period", period).where("period is not null")  # one row
    base = F.broadcast(near.where("period <> 'during'").agg(F.avg(value).alias("bm"), F.median(value).alias("bd")))
    own = near.groupBy("period").agg(F.count(F.lit(1)).alias("n_days"), F.avg(value).alias("m"), F.median(value).alias("d"))
    change = lambda a, b: F.round(100 * (F.col(a) - F.col(b)) / F.col(b), 6)
    return own.crossJoin(base).select("period", "n_days", F.round("m", 6).alias("mean"), F.round("d", 6).alias("median"), change("m", "bm").alias("mean_change"), change("d", "bd").alias("median_change"))


def sampled(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """A sample of n rows at most that depends on their keys and the seed alone, not on how rows are split."""
    h = F.xxhash64(F.lit(seed), *key)
    return df.orderBy(h, *key).limit(n)
