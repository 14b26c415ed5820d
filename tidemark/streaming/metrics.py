"""Service metrics over events.

`counts` and `windowed_quantile` take a batch or a streaming frame: windows with a
watermark in append mode hold bounded state.  All others take a batch frame; the gauge,
counter increases and alerts of a stream are in ``stateful``, and end equal to these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0)


def counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events, errors and summed value by window and kind; a null kind is ``unknown``."""
    kind = F.coalesce("event_type", F.lit("unknown")).alias("kind")
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "kind", "n", "n_error", "total")


def histogram(events: DataFrame, value: str = "value") -> DataFrame:
    """Cumulative counts by upper bound, by kind."""
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(BUCKETS)]
    row = events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("kind")).agg(*sums, F.count(value).alias("n"))
    pairs = ", ".join(f"{b}D, le_{i}" for i, b in enumerate(BUCKETS))
    return row.selectExpr("kind", "n", f"stack({len(BUCKETS)}, {pairs}) as (le, cumulative)")


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """Quantile by linear interpolation within the bucket where it falls; the last bound above all."""
    order = Window.partitionBy("kind").orderBy("le")
    rows = hist.withColumns({"below": F.coalesce(F.lag("cumulative").over(order), F.lit(0)), "floor": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "rank": F.lit(q) * F.col("n")})
    hit = F.when((F.col("cumulative") >= F.col("rank")) & (F.col("below") < F.col("rank")), F.col("floor") + (F.col("le") - F.col("floor")) * (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below")))
    return rows.groupBy("kind").agg(F.round(F.coalesce(F.max(hit), F.max("le")), 6).alias("quantile"))


def windowed_quantile(events: DataFrame, q: float, width: str = "1 hour", lateness: str = "10 minutes", value: str = "value") -> DataFrame:
    """(start, kind, n, quantile): the quantile of each window from its histogram, interpolated within a bucket; the last bound above all.

    Counts by bucket are the only state of a stream.
    """
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(BUCKETS)]
    row = rows.groupBy(F.window("ts", width).alias("w"), kind_of().alias("kind")).agg(*sums, F.count(value).alias("n"))
    rank = F.lit(q) * F.col("n")
    hit, below, floor = F.lit(None).cast("double"), F.lit(0), 0.0
    for i, le in enumerate(BUCKETS):
        upto = F.col(f"le_{i}")
        within = F.lit(floor) + F.lit(le - floor) * (rank - below) / (upto - below)
        hit = F.coalesce(hit, F.when((upto >= rank) & (below < rank), within))
        below, floor = upto, le
    value_ = F.when(F.col("n") > 0, F.round(F.coalesce(hit, F.lit(BUCKETS[-1])), 6))
    return row.select(F.col("w.start").alias("start"), "kind", "n", value_.alias("quantile"))


def kind_of():
    return F.coalesce("event_type", F.lit("unknown"))


def micros(ts: str):
    """Microseconds since 1970 of a time, in the session's time zone if it has none of its own."""
    return (_hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")


def _hour(ts: str):
    return F.datediff(ts, F.lit("1970-01-01")).cast("long") * 24 + F.hour(ts)


def _steps(events: DataFrame, step: int) -> DataFrame:
    """Distinct (kind, h): the steps of `step` seconds that have events."""
    return events.where("ts is not null").select(kind_of().alias("kind"), F.floor(micros("ts") / (step * 1_000_000)).cast("long").alias("h")).distinct()


def in_progress(events: DataFrame) -> DataFrame:
    """By kind and hour since 1970: the most requests open at once, and those open at its end.

    A request is open for `value` seconds from `ts`; at the same instant ends come first.
    Hours are summed before they are put in order, so no task holds more than an hour of a kind.
    """
    micro = 1_000_000
    began = (_hour("ts") * 3600 + F.minute("ts") * 60) * micro + (F.expr("extract(SECOND FROM ts)") * micro).cast("long")
    known = events.where("ts is not null and value is not null").select(F.coalesce("event_type", F.lit("unknown")).alias("kind"), began.alias("a"), (began + F.round(F.col("value") * micro).cast("long")).alias("b"))
    marks = known.select("kind", F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))))
    marks = marks.withColumn("hour", F.floor(F.col("at") / (3600 * micro)).cast("long"))
    within = Window.partitionBy("kind", "hour").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    hours = marks.withColumn("s", F.sum("d").over(within)).groupBy("kind", "hour").agg(F.max("s").alias("most"), F.sum("d").alias("change"))
    end = F.sum("change").over(Window.partitionBy("kind").orderBy("hour"))
    return hours.select("kind", "hour", (end - F.col("change") + F.greatest("most", F.lit(0))).alias("peak"), end.alias("open"))


def _runs(events: DataFrame, window: int, step: int) -> DataFrame:
    """(kind, pending, last): runs of steps on which some event lies within the last `window` steps."""
    true = _steps(events, step).select("kind", F.explode(F.sequence("h", F.col("h") + window - 1)).alias("h")).distinct()
    return true.withColumn("g", F.col("h") - F.row_number().over(Window.partitionBy("kind").orderBy("h"))).groupBy("kind", "g").agg(F.min("h").alias("pending"), F.max("h").alias("last"))


def raised(events: DataFrame, window: int, hold: int, step: int = 3600) -> DataFrame:
    """Alerts of each kind: some event within the last `window` steps (of `step` seconds), for more than `hold` steps on end."""
    runs = _runs(events, window, step)
    return runs.where(F.col("last") - F.col("pending") >= hold).select("kind", "pending", (F.col("pending") + hold).alias("fires"), (F.col("last") + 1).alias("resolved"))


def _transitions(rows: DataFrame, *states: tuple[str, str]) -> DataFrame:
    """(kind, state, at) of the given states and their columns, without nulls."""
    cells = F.array(*(F.struct(F.lit(name).alias("state"), F.col(column).alias("at")) for name, column in states))
    return rows.select("kind", F.inline(cells)).where("at is not null")


def raised_states(events: DataFrame, window: int, hold: int, step: int = 60) -> DataFrame:
    """(kind, state, at): pending, firing and resolved of every run of `raised`; a run that ends before it fires is dismissed."""
    runs, fires = _runs(events, window, step), F.col("last") - F.col("pending") >= hold
    end = F.col("last") + 1
    rows = runs.select("kind", "pending", F.when(fires, F.col("pending") + hold).alias("firing"), F.when(fires, end).alias("resolved"), F.when(~fires, end).alias("dismissed"))
    return _transitions(rows, *((c, c) for c in ("pending", "firing", "resolved", "dismissed")))


def silent(events: DataFrame, hold: int, step: int = 3600) -> DataFrame:
    """Alerts of each kind: no event for `hold` whole steps (of `step` seconds) or more, between two events."""
    ahead = F.lead("h").over(Window.partitionBy("kind").orderBy("h"))
    return _steps(events, step).withColumn("resolved", ahead).where(F.col("resolved") - F.col("h") > hold).select("kind", (F.col("h") + 1).alias("pending"), (F.col("h") + 1 + hold).alias("fires"), "resolved")


def silent_states(events: DataFrame, hold: int, step: int = 60) -> DataFrame:
    """(kind, state, at): pending, firing and resolved of every silence between two events."""
    return _transitions(silent(events, hold, step), ("pending", "pending"), ("firing", "fires"), ("resolved", "resolved"))


def rates(samples: DataFrame, labels: list[str], instance: str, ts: str, value: str, step: int, steps: int) -> DataFrame:
    """(labels, slot, increase, rate): increase of counters over the last `steps` slots of `step` seconds, and per second.

    A counter that falls was reset, so that its value is its increase; the first sample of
    an instance adds nothing.  Increases are summed over instances by slot before they are
    put in order.
    """
    order = Window.partitionBy(*labels, instance).orderBy("_t", value)
    micro = (_hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")
    rows = samples.where(F.col(ts).isNotNull()).withColumn("_t", micro).withColumn("_p", F.lag(value).over(order))
    v, p = F.col(value), F.col("_p")
    grown = F.when(p.isNull(), 0).when(v < p, v).otherwise(v - p)
    return slot_rates(rows.select(*labels, F.floor(F.col("_t") / (step * 1_000_000)).cast("long").alias("slot"), grown.alias("increase")), labels, step, steps)


def slot_rates(increases: DataFrame, labels: list[str], step: int, steps: int) -> DataFrame:
    """(labels, slot, increase, rate) from increases by slot, such as a stream has written."""
    slots = increases.groupBy(*labels, "slot").agg(F.sum("increase").alias("_i"))
    last = F.sum("_i").over(Window.partitionBy(*labels).orderBy("slot").rangeBetween(1 - steps, 0))
    return slots.select(*labels, "slot", last.alias("increase"), F.round(last / (step * steps), 9).alias("rate"))
