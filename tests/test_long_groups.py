"""Groups and series that hold nearly all rows, against plain Python."""

import math
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sequences

DAY = date(2015, 1, 1)


def largest_task(df, *keys):
    """Rows of the largest of the groups that a window holds."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_quantiles_of_a_group_with_close_values(spark):
    """One group holds all rows but a few, all within a sixteenth of an octave."""
    rows = spark.range(50_000).select(F.when(F.col("id") < 49_990, "a").when(F.col("id") < 49_995, "b").alias("k"), (100 + (F.col("id") * 7919 % 50_000) / 20_000).alias("v"))
    points = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    got = {(r["k"], r["q"]): r["value"] for r in agg.quantiles(rows, "v", points, ["k"]).collect()}
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r["k"], []).append(r["v"])
    for k, values in by_key.items():
        for q, want in zip(points, np.quantile(values, points), strict=True):
            assert got[k, q] == pytest.approx(want)
    counted = agg.ranged(rows.groupBy("k", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n")), "value")
    assert largest_task(counted, "k", "_b") < 50_000 / 200


def test_quantiles_of_hard_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [1.0, 2.0, 2.0, -inf, inf, inf, None, -5.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    for r in agg.quantiles(df, "v", [0.0, 0.25, 0.5, 0.6, 1.0]).collect():
        place = (len(known) - 1) * r["q"]
        a, b = sorted(known)[math.floor(place)], sorted(known)[math.ceil(place)]
        assert r["value"] == (a if a == b else a + (place - math.floor(place)) * (b - a))
    top = agg.quantiles(spark.createDataFrame([(1.0,), (nan,)], "v double"), "v", [0.0, 1.0]).orderBy("q").collect()
    assert top[0]["value"] == 1.0 and math.isnan(top[1]["value"])
    assert agg.quantiles(spark.createDataFrame([(nan,), (nan,)], "v double"), "v", [0.5]).count() == 1
    assert agg.quantiles(df.where("v is null"), "v", [0.5], ["v"]).count() == 0


def test_medians_join_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0), ("b", None)], "k string, v double")
    out = agg.with_median(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), df, ["k"], "v")
    assert {tuple(r) for r in out.collect()} == {(None, 2, 2.5), ("a", 1, 2.0), ("b", 1, None)}


def test_concentration_of_equal_totals(spark):
    rows = spark.range(100).select("id", F.lit(2.0).alias("v"))
    assert tuple(agg.concentration(rows, "id", "v").first()) == (0.01, 0.1, 0.2)


def series(spark, n=9_000):
    """One series with nine tenths of the rows, with gaps, and many short ones."""
    rows = [("long", DAY + timedelta(days=k), float(k % 31) if k % 13 else None) for k in range(n) if k % 101] + [(f"s{k % 50}", DAY + timedelta(days=k % 90), float(k)) for k in range(0, n // 9)]
    rows = list({(s, d): (s, d, v) for s, d, v in rows}.values())
    return rows, spark.createDataFrame(rows, "s string, day date, v double")


def test_windows_of_a_long_series(spark):
    rows, df = series(spark)
    at = {(s, d): v for s, d, v in rows}
    got = {(r["s"], r["day"]): (r["lag_1"], r["lag_7"]) for r in joins.exact_offset(df, ["s"], "day", "v", [1, 7]).collect()}
    assert got == {(s, d): (at.get((s, d - timedelta(days=1))), at.get((s, d - timedelta(days=7)))) for s, d in at}
    blocks = sequences.in_blocks(df, ["s"], "day", 7)
    assert largest_task(blocks, "s", "_block") < len(rows) / 50
    assert blocks.count() < 1.2 * len(rows)
    mean = sequences.own_rows(blocks.withColumn("m", sequences.complete(F.avg, "v", 7, ["s", "_block"], "day")))
    for r in mean.collect():
        days = [at.get((r["s"], r["day"] - timedelta(days=k))) for k in range(1, 8)]
        assert r["m"] == (None if None in days else pytest.approx(sum(days) / 7))


def test_nearest_known_values_of_a_long_series(spark):
    rows, df = series(spark, 3_000)
    known = {}
    for s, d, v in rows:
        if v is not None:
            known.setdefault(s, []).append((d, v))
    for days in (5, 256):
        got = {(r["s"], r["day"]): r for r in sequences.nearest_known(df, ["s"], "day", "v", days).collect()}
        assert len(got) == len(rows)
        for s, d, _ in rows[::17]:
            before = max((x for x in known.get(s, []) if x[0] < d), default=(None, None))
            after = min((x for x in known.get(s, []) if x[0] > d), default=(None, None))
            r = got[s, d]
            assert ((r["previous_day"], r["previous"]), (r["next_day"], r["next"])) == (before, after)


def test_interval_join_of_all_rows(spark):
    rows, df = series(spark, 1_500)
    cases = df.withColumn("case_id", F.struct("s", "day"))
    near = joins.around(cases, df, ["s"], "day", 3)
    got = Counter((r["s"], r["case_day"], r["relative_day"]) for r in near.collect())
    days = {(s, d) for s, d, _ in rows}
    assert got == Counter((s, d, k) for s, d in days for k in range(-3, 4) if (s, d + timedelta(days=k)) in days)


def test_rule_examples_and_buckets(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    out = agg.rule_examples(df, {"low": (F.col("x") < 2, F.col("x") == 0), "none": (F.col("x") > 20, F.lit(False))}, ["id"])
    assert sorted(map(tuple, out.collect())) == [("low", i + 1, 10 * i + 1) for i in range(5)]
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    assert agg.covered(counts, "n", df).count() == 10
    with pytest.raises(Exception, match="every row once"):
        agg.covered(counts.where("x > 0"), "n", df).collect()


def test_variance_by_sums_is_not_negative(spark):
    df = spark.createDataFrame([(1e8 + 0.1,)] * 3 + [(None,)], "x double")
    sums = df.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    v = sums.select(agg.variance_from_sums(F.col("n"), F.col("s"), F.col("ss")), agg.variance_from_sums(F.lit(1), F.lit(2.0), F.lit(4.0))).first()
    assert v[0] >= 0 and v[1] is None
