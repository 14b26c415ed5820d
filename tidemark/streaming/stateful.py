"""Service metrics of streams that hold state: gauges, counter increases and alerts.

Each operator buffers what the watermark has not passed, in state by key, and works it off
in order of event time once it has; timers of the event time wake a key that gets no more
rows.  So micro-batches may come in any order within the lateness, and the rows of a
stream that has ended are those of the batch functions in ``metrics``.  What is later than
the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.streaming import metrics

MICRO = 1_000_000


def _keyed(events: DataFrame, lateness: str) -> DataFrame:
    """Rows with their kind, their time as a watermark, and as microseconds."""
    rows = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.withColumns({"kind": metrics.kind_of(), "at": metrics.micros("ts")})


def _waken(state: GroupState, at: int | None) -> None:
    """Set the timer of a key to a time in microseconds, after the watermark."""
    if at is not None:
        state.setTimeoutTimestamp(max(-(-at // 1000), state.getCurrentWatermarkMs() + 1))


def _gauge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whole hours that the watermark has passed: the most open at once, and those open at the end."""
    at, step, open_ = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
    for f in frames:
        at += f["at"].tolist() + f["until"].tolist()
        step += [1] * len(f) + [-1] * len(f)
    hour = 3600 * MICRO
    cut = state.getCurrentWatermarkMs() * 1000 // hour * hour
    when, change = np.array(at, dtype=np.int64), np.array(step, dtype=np.int64)
    order = np.lexsort((change, when))  # at one instant ends come first
    when, change = when[order], change[order]
    n = int(np.searchsorted(when, cut))
    out = []
    for h in np.unique(when[:n] // hour):
        a, b = np.searchsorted(when, [h * hour, (h + 1) * hour])
        run = open_ + np.cumsum(change[a:b])
        out.append((key[0], int(h), max(int(run.max()), open_), int(run[-1])))
        open_ = int(run[-1])
    state.update((when[n:].tolist(), change[n:].astype(int).tolist(), open_))
    _waken(state, (int(when[n]) // hour + 1) * hour if n < len(when) else None)
    yield pd.DataFrame(out, columns=["kind", "hour", "peak", "open"])


def in_progress(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """`metrics.in_progress` of a stream, an hour of a kind as soon as the watermark has passed it."""
    rows = _keyed(events, lateness).where("value is not null").withColumn("until", F.col("at") + F.round(F.col("value") * MICRO).cast("long"))
    return rows.select("kind", "ts", "at", "until").groupBy("kind").applyInPandasWithState(_gauge, "kind string, hour long, peak long, open long", "at array<long>, step array<long>, open long", "append", "EventTimeTimeout")


def _increases(step: int, names: list[str]) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value, last = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        for f in frames:
            at += f["at"].tolist()
            value += f["_v"].tolist()
        cut = state.getCurrentWatermarkMs() * 1000 // (step * MICRO) * (step * MICRO)
        when, v = np.array(at, dtype=np.int64), np.array(value, dtype=np.float64)
        order = np.lexsort((v, when))
        when, v = when[order], v[order]
        n = int(np.searchsorted(when, cut))
        sums: dict[int, float] = {}
        for t, x in zip(when[:n].tolist(), v[:n].tolist(), strict=True):
            grown = 0.0 if last is None else x if x < last else x - last
            sums[t // (step * MICRO)] = sums.get(t // (step * MICRO), 0.0) + grown
            last = x
        state.update((when[n:].tolist(), v[n:].tolist(), last))
        _waken(state, (int(when[n]) // (step * MICRO) + 1) * step * MICRO if n < len(when) else None)
        yield pd.DataFrame([(*key, k, s) for k, s in sums.items()], columns=names)

    return run


def counter_increases(samples: DataFrame, labels: list[str], instance: str, value: str, step: int, lateness: str = "10 minutes") -> DataFrame:
    """(labels, instance, slot, increase): what each counter grew in each slot of `step` seconds that has samples.

    `metrics.slot_rates` of the rows written so far gives rates over sliding windows.
    """
    rows = samples.where(f"ts is not null and {value} is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = rows.select(*labels, instance, "ts", metrics.micros("ts").alias("at"), F.col(value).cast("double").alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*labels, instance]) + ", slot long, increase double"
    return rows.groupBy(*labels, instance).applyInPandasWithState(_increases(step, [*labels, instance, "slot", "increase"]), out, "at array<long>, value array<double>, last double", "append", "EventTimeTimeout")


_STATES = "kind string, state string, at long"


def _alerts(window: int, hold: int, step: int) -> Callable:
    """A condition that an event makes true for `window` steps: pending, then firing after `hold` steps, then resolved."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, last, fired = (list(state.get[0]), *state.get[1:]) if state.exists else ([], None, None, False)
        for f in frames:
            waiting += (f["at"] // (step * MICRO)).tolist()
        cut = state.getCurrentWatermarkMs() * 1000 // (step * MICRO)
        steps = sorted(set(waiting))
        out: list[tuple] = []

        def settle(known: int) -> None:
            """What is sure of the current run once all steps before `known` are."""
            nonlocal start, last, fired
            if start is not None and not fired and last - start >= hold and known > start + hold:
                out.append((key[0], "firing", start + hold))
                fired = True
            if start is not None and known > last + 1:
                out.append((key[0], "resolved" if fired else "dismissed", last + 1))
                start, last, fired = None, None, False

        for t in (x for x in steps if x < cut):
            settle(t)
            if start is None:
                out.append((key[0], "pending", t))
                start, fired = t, False
            last = t + window - 1
        settle(cut)
        later = [x for x in steps if x >= cut]
        state.update((later, start, last, fired))
        wakes = [later[0] + 1] if later else []
        if start is not None:
            wakes.append(start + hold + 1 if not fired and last - start >= hold else last + 2)
        _waken(state, min(wakes) * step * MICRO if wakes else None)
        yield pd.DataFrame(out, columns=["kind", "state", "at"])

    return run


def raised(events: DataFrame, window: int, hold: int, step: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(kind, state, at): transitions of `metrics.raised_states`, each as soon as the watermark makes it sure."""
    rows = _keyed(events, lateness).select("kind", "ts", "at")
    return rows.groupBy("kind").applyInPandasWithState(_alerts(window, hold, step), _STATES, "waiting array<long>, start long, last long, fired boolean", "append", "EventTimeTimeout")


def _absences(hold: int, step: int) -> Callable:
    """No event for more than `hold` whole steps: firing by a timer, without any row, and resolved by the next event."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last, fired = (list(state.get[0]), *state.get[1:]) if state.exists else ([], None, False)
        for f in frames:
            waiting += (f["at"] // (step * MICRO)).tolist()
        cut = state.getCurrentWatermarkMs() * 1000 // (step * MICRO)
        steps = sorted(set(waiting))
        out: list[tuple] = []

        def settle(known: int) -> None:
            nonlocal fired
            if last is not None and not fired and known - last > hold:
                out.extend([(key[0], "pending", last + 1), (key[0], "firing", last + 1 + hold)])
                fired = True

        for t in (x for x in steps if x < cut):
            settle(t)
            if fired:
                out.append((key[0], "resolved", t))
            last, fired = t, False
        settle(cut)
        later = [x for x in steps if x >= cut]
        state.update((later, last, fired))
        wakes = ([later[0] + 1] if later else []) + ([last + hold + 1] if last is not None and not fired else [])
        _waken(state, min(wakes) * step * MICRO if wakes else None)
        yield pd.DataFrame(out, columns=["kind", "state", "at"])

    return run


def silent(events: DataFrame, hold: int, step: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(kind, state, at): transitions of `metrics.silent_states`; a silence fires while it lasts."""
    rows = _keyed(events, lateness).select("kind", "ts", "at")
    return rows.groupBy("kind").applyInPandasWithState(_absences(hold, step), _STATES, "waiting array<long>, last long, fired boolean", "append", "EventTimeTimeout")
