"""Profiles, audits and summaries; every one a partial and a final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_with_null(column: str) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def conflicts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose rows disagree on a column, or mix null with a value."""
    held = df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("most"), F.count(column).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
    return held.where((F.col("least") != F.col("most")) | ((F.col("n_values") > 0) & (F.col("n_values") < F.col("n_rows"))))


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, and keys with more than one row."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null, pct_null) in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c_{c}") for c in df.columns))
    pairs = ", ".join(f"'{c}', `c_{c}`" for c in df.columns)
    return row.selectExpr("n", f"stack({len(df.columns)}, {pairs}) as (column, n_null)").select("column", "n_null", F.round(F.try_divide(100 * F.col("n_null"), F.col("n")), 6).alias("pct_null"))


def status_columns(flag: str) -> list[Column]:
    """Counts of true, false and missing, and the missing share."""
    missing = F.count_if(F.col(flag).isNull())
    return [F.count_if(F.col(flag)).alias("n_true"), F.count_if(~F.col(flag)).alias("n_false"), missing.alias("n_missing"), F.round(100 * missing / F.count(F.lit(1)), 6).alias("pct_missing")]


def status_sums(flag: str, n: str) -> list[Column]:
    """The same, of rows that stand for `n` each."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    missing = total(F.col(flag).isNull())
    return [total(F.col(flag)).alias("n_true"), total(~F.col(flag)).alias("n_false"), missing.alias("n_missing"), F.round(100 * missing / F.sum(n), 6).alias("pct_missing")]


#: Learned ranges: so many coarse ones, each cut into as many fine ones.
COARSE = 32


def ranged(counted: DataFrame, value: str, coarse: int = COARSE) -> DataFrame:
    """`counted` with `_b`, the number of the range that its value lies in.

    Ranges are learned from the data, so that each has about as many rows as any other
    unless one value fills it; a value is compared with the coarse bounds, and then with
    the fine ones between two of them.  NaN lies above all numbers, as in every order.
    """
    points = [i / coarse**2 for i in range(1, coarse**2)]
    # one row; not a number is no point of a range
    edges = counted.where(~F.isnan(F.col(value).cast("double"))).agg(F.percentile_approx(value, points, 20 * coarse**2).alias("_edges"))
    met = counted.crossJoin(F.broadcast(edges))
    v = F.col(value)
    outer = F.expr(f"size(filter(sequence(1, {coarse - 1}), i -> _edges[i * {coarse} - 1] <= `{value}`))")
    inner = F.expr(f"size(filter(sequence(0, {coarse - 2}), i -> _edges[_o * {coarse} + i] <= `{value}`))")
    number = F.when(v.isNull() | F.col("_edges").isNull(), 0).otherwise(F.col("_o") * coarse + F.col("_i"))
    return met.withColumn("_o", outer).withColumn("_i", inner).withColumn("_b", number.cast("int")).drop("_o", "_i", "_edges")


def cumulative(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """(*keys, value, n, upto, total): how often each value of a group occurs, and how many are at most as large; nulls are left out.

    Values are put in order within learned ranges of each group, and the sums of these
    (fewer than `COARSE` squared) among each other, so that no task orders a whole group,
    however large it is and however close its values are.
    """
    keys = list(keys)
    counted = ranged(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value")
    sums = counted.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_b", (F.sum("_n").over(group.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_b").orderBy("value"))
    ordered = counted.withColumn("_inside", inside)
    if keys:
        same = [ordered[k].eqNullSafe(sums[k]) for k in keys]
        met = ordered.join(sums.withColumnRenamed("_b", "_c"), [*same, ordered["_b"] == F.col("_c")])
        return met.select(*(ordered[k] for k in keys), "value", "n", (F.col("_before") + F.col("_inside")).alias("upto"), "total")
    return ordered.join(F.broadcast(sums), "_b").select("value", "n", (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def _picked(rows: DataFrame, points: list[float], keys: list[str]) -> DataFrame:
    """(*keys, n, then for each point the value below and above its place)."""
    picks = []
    for i, q in enumerate(points):
        place = (F.col("total") - 1) * F.lit(float(q))
        picks += [F.min(F.when(F.col("upto") > f(place), F.col("value"))).alias(f"{side}{i}") for side, f in (("a", F.floor), ("b", F.ceil))]
    return rows.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def _between(i: int, q: float) -> Column:
    """The value at a point, from its two neighbours; equal ones need no arithmetic, which infinite ones would not survive."""
    place = (F.col("n") - 1) * F.lit(float(q))
    a, b = F.col(f"a{i}"), F.col(f"b{i}")
    return F.when(a == b, a.cast("double")).otherwise(a + (place - F.floor(place)) * (b - a))


def quantiles(df: DataFrame, value: str, points: list[float], keys: list[str] = ()) -> DataFrame:
    """(*keys, q, value): exact quantiles with linear interpolation between neighbours, of each group."""
    keys = list(keys)
    cells = [F.struct(F.lit(float(q)).alias("q"), _between(i, q).alias("value")) for i, q in enumerate(points)]
    return _picked(cumulative(df, value, keys), points, keys).select(*keys, F.inline(F.array(*cells)))


def with_median(summary: DataFrame, df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """A summary by keys with the exact median of each group, of which no task holds all values."""
    middle = _picked(cumulative(df, value, keys), [0.5], keys).select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.round(_between(0, 0.5), 6).alias(name))
    return summary.join(middle, [summary[k].eqNullSafe(middle[f"_m_{k}"]) for k in keys], "left").drop(*(f"_m_{k}" for k in keys))


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the total that the top one, the top ten and the top fifth of keys hold."""
    ranked = cumulative(df.groupBy(key).agg(F.sum(value).alias("t")), "t")
    above = F.col("total") - F.col("upto")  # keys with a larger total
    held = lambda k: F.sum(F.col("value") * F.greatest(F.least(F.col("n"), k - above), F.lit(0)))
    share = lambda k: F.round(F.try_divide(held(k), F.sum(F.col("value") * F.col("n"))), 6)
    return ranked.agg(share(F.lit(1)).alias("top_1"), share(F.lit(10)).alias("top_10"), share(F.greatest(F.ceil(F.col("total") * 0.2), F.lit(1))).alias("top_fifth"))


#: What `describe` gives, in its order.
DESCRIBED = ["mean", "median", "std", "least", "most"]


def variance_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample variance from a count, a sum and a sum of squares, not below 0 where rounding would have it so; null below two values.

    Partial sums of any split add up, so it needs no second pass over the values.
    """
    return F.when(n > 1, F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))


def describe(column: str) -> list[Column]:
    v = F.col(column)
    return [F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")]


def coverage(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Span, observed days and share of each series, and how many are short or intermittent."""
    s = df.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("observed"))
    s = s.withColumn("span", F.datediff("last", "first") + 1).withColumn("share", F.col("observed") / F.col("span"))
    return s.agg(F.count(F.lit(1)).alias("n_series"), F.count_if((F.col("span") < 180) | (F.col("observed") < 60)).alias("n_short"), F.count_if(F.col("share") < 0.25).alias("n_intermittent"), F.round(F.avg("share"), 6).alias("mean_share"))


def rules(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that each named rule marks, in one pass."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(named.values())))
    pairs = ", ".join(f"'{k}', r{i}" for i, k in enumerate(named))
    return row.selectExpr(f"stack({len(named)}, {pairs}) as (rule, n)")


def scope_check(facts: DataFrame, places: DataFrame, day: str, scope: str, place: str) -> DataFrame:
    """By day and scope: places with facts, places the scope has, and whether they are the same number."""
    expected = places.groupBy(scope).agg(F.countDistinct(place).alias("expected"))
    seen = facts.join(places, place).groupBy(day, scope).agg(F.countDistinct(place).alias("represented"))
    return seen.join(expected, scope).select(day, scope, "represented", "expected", (F.col("represented") == F.col("expected")).alias("consistent"))


def rule_report(df: DataFrame, named: dict[str, tuple[Column, Column]], key: str) -> DataFrame:
    """(rule, n, explained, unresolved, example): rows each rule marks, those that its second condition explains, and the smallest key of one that it does not; `rule_examples` has more of these."""
    sums = []
    for i, (mask, reason) in enumerate(named.values()):
        hit = F.coalesce(mask, F.lit(False))
        why = hit & F.coalesce(reason, F.lit(False))
        sums += [F.count_if(hit).alias(f"n{i}"), F.count_if(why).alias(f"e{i}"), F.min(F.when(hit & ~why, F.col(key))).alias(f"x{i}")]
    row = df.agg(*sums)
    cells = [F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("explained"), (F.col(f"n{i}") - F.col(f"e{i}")).alias("unresolved"), F.col(f"x{i}").alias("example")) for i, rule in enumerate(named)]
    return row.select(F.inline(F.array(*cells)))


def rule_examples(df: DataFrame, named: dict[str, tuple[Column, Column]], key: list[str], most: int = 5) -> DataFrame:
    """(rule, place, *key): the first `most` rows, by key, that a rule marks and its second condition does not explain.

    Each task keeps its own first rows before they meet.
    """
    held = [F.when(F.coalesce(mask, F.lit(False)) & ~F.coalesce(reason, F.lit(False)), F.lit(rule)) for rule, (mask, reason) in named.items()]
    rows = df.select(*key, F.explode(F.array_compact(F.array(*held))).alias("rule"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(*key))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("rule", "place", *key)


def covered(buckets: DataFrame, n: str, rows: DataFrame) -> DataFrame:
    """Counts by bucket, after a check within the query that the buckets hold every row once."""
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    met = buckets.withColumn("_sum", F.sum(n).over(Window.partitionBy())).crossJoin(F.broadcast(total))  # a row per bucket, one row
    return met.withColumn(n, F.when(F.col("_sum") == F.col("_all"), F.col(n)).otherwise(F.raise_error(F.lit("the buckets do not hold every row once")).cast("long"))).drop("_sum", "_all")


def scope_levels(facts: DataFrame, places: DataFrame, day: str, place: str, levels: list[str]) -> DataFrame:
    """(day, level, scope, represented, expected, consistent): places with facts against all places, overall and by each level of scope."""
    of = lambda df: df.select(*([day] if day in df.columns else []), F.col(place).alias("place"), F.inline(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("scope")), *(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("scope")) for c in levels))))
    expected = of(places.select(place, *levels)).groupBy("level", "scope").agg(F.count_distinct("place").alias("expected"))
    seen = of(facts.select(day, place).distinct().join(places.select(place, *levels), place)).groupBy(day, "level", "scope").agg(F.count_distinct("place").alias("represented"))
    return seen.join(expected, ["level", "scope"]).select(day, "level", "scope", "represented", "expected", (F.col("represented") == F.col("expected")).alias("consistent"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows, repeated): rows beyond the first of rows equal in every column, and how many kinds of them repeat."""
    return duplicate_counts(df, df.columns).withColumnRenamed("duplicate_keys", "repeated")


def null_matrix(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """(flag, column, n, n_null): nulls of each column where a flag is true, false or missing."""
    sums = [F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.groupBy(F.coalesce(F.col(flag).cast("string"), F.lit("missing")).alias("flag")).agg(F.count(F.lit(1)).alias("n"), *sums)
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(columns))
    return row.selectExpr("flag", "n", f"stack({len(columns)}, {pairs}) as (column, n_null)").select("flag", "column", "n", "n_null")


def key_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both, a_in_b, equal) of two sets of keys, in one shuffle."""
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).distinct().unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("s")).distinct())
    row = sides.where("k is not null").groupBy("k").agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"), F.count_if(F.col("s") == 3).alias("both"))
    return row.withColumns({"a_in_b": F.col("only_a") == 0, "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0)})


def activity(df: DataFrame, key: str, day: str, window: int = 90) -> DataFrame:
    """(n, new, inactive): keys first seen within `window` days of the last day, and keys last seen before that."""
    each = df.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    end = each.agg(F.max("last").alias("end"))
    cut = F.date_sub("end", window)
    return each.crossJoin(F.broadcast(end)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") > cut).alias("new"), F.count_if(F.col("last") < cut).alias("inactive"))  # end: one row
