"""Expanding-window folds and the leakage rule."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HORIZON = 16


@dataclass(frozen=True)
class Fold:
    number: int
    origin: date

    @property
    def start(self) -> date:
        return self.origin + timedelta(days=1)

    @property
    def end(self) -> date:
        return self.origin + timedelta(days=HORIZON)


def check(folds: list[Fold], holdout: Fold) -> None:
    """Numbers 1..n, origins increasing, windows disjoint and before the holdout."""
    if not folds:
        raise ValueError("there are no folds")
    if [f.number for f in folds] != list(range(1, len(folds) + 1)):
        raise ValueError("fold numbers must be 1..n in order")
    for a, b in zip(folds, [*folds[1:], holdout], strict=True):
        if not a.origin < b.origin:
            raise ValueError("fold origins must increase")
        if not a.end < b.start:
            raise ValueError("validation windows must not overlap each other or the holdout")


#: Fixed values of the contract: the approved origins, and that of the protected holdout.
APPROVED = [
    Fold(1, date(2015, 8, 31)),
    Fold(2, date(2015, 12, 8)),
    Fold(3, date(2016, 4, 15)),
    Fold(4, date(2016, 6, 30)),
    Fold(5, date(2016, 8, 31)),
    Fold(6, date(2016, 12, 8)),
    Fold(7, date(2017, 4, 15)),
    Fold(8, date(2017, 6, 30)),
]
HOLDOUT = Fold(9, date(2017, 7, 30))


def check_approved(folds: list[Fold] = APPROVED, holdout: Fold = HOLDOUT) -> None:
    """The contract of exactly eight folds."""
    if len(folds) != 8:
        raise ValueError("there must be exactly 8 folds")
    check(folds, holdout)


def table(spark, folds: list[Fold], holdout: Fold | None = None) -> DataFrame:
    """(fold, origin, start, end, days, holdout)."""
    rows = [(f.number, f.origin, f.start, f.end, (f.end - f.start).days + 1, f is holdout) for f in [*folds, *([holdout] if holdout else [])]]
    return spark.createDataFrame(rows, "fold int, origin date, start date, end date, days int, holdout boolean")


def is_known(label_day: str, origin: date):
    """Whether a label may be learned from at an origin: by the day of the label, not that of its forecast."""
    return F.col(label_day) <= F.lit(origin)


def populations(facts: DataFrame, day: str, folds: list[Fold]) -> DataFrame:
    """Training and validation rows of every fold; rows are counted by day first, so each is looked at once."""
    days = facts.groupBy(F.col(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    sums = []
    for f in folds:
        own = F.col("_d").between(f.start, f.end)
        sums += [total(is_known("_d", f.origin)).alias(f"t{f.number}"), total(own).alias(f"v{f.number}"), F.count_if(own).alias(f"d{f.number}")]
    parts = ", ".join(f"{f.number}, t{f.number}, v{f.number}, d{f.number}" for f in folds)
    return days.agg(*sums).selectExpr(f"stack({len(folds)}, {parts}) as (fold, n_train, n_validation, n_days)")
