"""Streams in shuffled micro-batches end equal to the batch functions."""

import os
import random
from datetime import datetime, timedelta

import pytest

from tidemark.streaming import metrics, stateful

START = datetime(2024, 3, 1)
DDL = "ts timestamp, event_type string, value double, instance int, v long"
LATE = "90 minutes"


def made(n=400, seed=3):
    """Events of a day in an order that differs from that of time by less than an hour, with ties and nulls."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=draw.randrange(86_400) // 30 * 30)
        rows.append((at, draw.choice(["view", "view", "view", "click", None]), draw.choice([None, 0.5, 30.0, 75.0, 4000.0]), i % 3, draw.randrange(50)))
    return sorted(rows, key=lambda r: (r[0] + timedelta(minutes=draw.randrange(55)), str(r)))


def streamed(spark, tmp_path, rows, plan, name, batches=5):
    """What a plan has written once the stream has ended: the last micro-batches only move the watermark on."""
    at = tmp_path / name
    at.mkdir()
    later = [(START + timedelta(days=k), "end", 0.5, 9, 0) for k in (3, 4)]
    parts = [rows[len(rows) * i // batches : len(rows) * (i + 1) // batches] for i in range(batches)] + [[r] for r in later]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(at / "in"))
    for i, f in enumerate(sorted((at / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    frame = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(at / "in"))
    run = plan(frame).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at / "state")).start()
    run.processAllAvailable()
    run.stop()
    return spark.table(name)


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


@pytest.fixture(scope="module")
def events():
    return made()


def test_gauge(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda s: stateful.in_progress(s, LATE), "gauge").where("kind <> 'end'")
    batch = metrics.in_progress(spark.createDataFrame(events, DDL))
    assert rows(got) == rows(batch.select(*got.columns))


def test_counter_rates(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda s: stateful.counter_increases(s, ["event_type"], "instance", "v", 300, LATE), "increases")
    got = metrics.slot_rates(got.where("event_type <> 'end'"), ["event_type"], 300, 3)
    batch = metrics.rates(spark.createDataFrame(events, DDL).where("event_type is not null"), ["event_type"], "instance", "ts", "v", 300, 3)
    assert rows(got) == rows(batch.selectExpr("event_type", "slot", "cast(increase as double) as increase", "rate"))


@pytest.mark.parametrize(("window", "hold", "step"), [(5, 7, 60), (2, 1, 600)])
def test_alerts(spark, tmp_path, events, window, hold, step):
    got = streamed(spark, tmp_path, events, lambda s: stateful.raised(s, window, hold, step, LATE), f"alerts_{window}_{hold}").where("kind <> 'end'")
    assert rows(got) == rows(metrics.raised_states(spark.createDataFrame(events, DDL), window, hold, step))


def test_silence_fires_by_a_timer(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda s: stateful.silent(s, 2, 60, LATE), "silences").where("kind <> 'end'")
    df = spark.createDataFrame(events, DDL)
    batch = metrics.silent_states(df, 2, 60)
    # the silence after the last event fires while no row comes any more
    last = metrics._steps(df, 60).groupBy("kind").agg({"h": "max"}).withColumnRenamed("max(h)", "h")
    trailing = last.selectExpr("kind", "stack(2, 'pending', h + 1, 'firing', h + 3) as (state, at)")
    assert rows(got) == rows(batch.unionByName(trailing))


def test_quantiles_and_counts_of_windows(spark, tmp_path, events):
    df = spark.createDataFrame(events, DDL)
    got = streamed(spark, tmp_path, events, lambda s: metrics.windowed_quantile(s, 0.9, "1 hour", LATE), "quantiles").where("kind <> 'end'")
    assert rows(got) == rows(metrics.windowed_quantile(df, 0.9))
    got = streamed(spark, tmp_path, events, lambda s: metrics.counts(s, "1 hour", LATE), "windows").where("kind <> 'end'")
    assert rows(got) == rows(metrics.counts(df))


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path, events):
    late = (START, "view", 30.0, 0, 1)  # comes a day late
    for name, plan, batch in (("g", lambda s: stateful.in_progress(s, LATE).where("kind <> 'end'"), metrics.in_progress), ("a", lambda s: stateful.raised(s, 5, 1, 60, LATE).where("kind <> 'end'"), lambda df: metrics.raised_states(df, 5, 1))):
        got = streamed(spark, tmp_path, [*events, *[(START + timedelta(days=1, hours=5), "click", None, 0, 1)] * 9, late], plan, f"late_{name}", batches=6)
        kept = spark.createDataFrame([*events, (START + timedelta(days=1, hours=5), "click", None, 0, 1)], DDL)
        assert rows(got) == rows(batch(kept).select(*got.columns))
