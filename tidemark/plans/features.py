"""Leakage-safe forecasting features for many origins in one plan.

Each row of the panel is exploded to the origins whose window [origin - 28, origin + 16]
holds it; all features of (origin, store, item) are conditional aggregates over that
partition, so the panel is scanned once and exchanged once for the sales features.
Store-day and market sub-plans are small and join back.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns

HISTORY, HORIZON = 28, 16
LAGS, MEANS, STDS = (1, 7, 14, 28), (7, 14, 28), (7, 28)


def by_origin(rows: DataFrame, day: str, origins: list[date]) -> DataFrame:
    """A row for each origin whose window holds it, with the signed distance in days."""
    every = F.array(*(F.lit(o) for o in origins))
    near = F.filter(every, lambda o: (F.col(day) >= F.date_sub(o, HISTORY)) & (F.col(day) <= F.date_add(o, HORIZON)))
    inside = rows.where(F.col(day).between(F.date_sub(F.lit(min(origins)), HISTORY), F.date_add(F.lit(max(origins)), HORIZON)))
    return inside.withColumn("origin", F.explode(near)).withColumn("off", F.datediff(day, "origin"))


def _within(width: int, last: int) -> Column:
    return F.col("off").between(last - width + 1, last)


def complete(fn, value: str, width: int, over, last: int = -1) -> Column:
    """`fn` of the window, null unless it has `width` rows, all with a value."""
    inside = _within(width, last)
    full = (F.count(F.when(inside, 1)).over(over) == width) & (F.count(F.when(inside, F.col(value))).over(over) == width)
    return F.when(full, fn(F.when(inside, F.col(value))).over(over))


def sales_features(panel: DataFrame, origins: list[date], static: list[str] = (), unknown: str = "raise") -> DataFrame:
    """Panel (day, store, item, sales, static...) to one row per observed target day.

    Static attributes are those of the last row at or before the origin; a series without
    one in the history that is looked at is an error, or with `unknown` "drop" left out.
    """
    over = Window.partitionBy("origin", "store", "item")
    rows = by_origin(panel, "day", origins)
    made = {f"sales_lag_{k}": F.max(F.when(F.col("off") == -k, F.col("sales"))).over(over) for k in LAGS}
    made |= {f"sales_mean_{w}": complete(F.avg, "sales", w, over) for w in MEANS}
    made |= {f"sales_std_{w}": complete(F.stddev_samp, "sales", w, over) for w in STDS}
    made |= {f"known_{c}": F.max_by(F.col(c), F.when(F.col("off") <= 0, F.col("day"))).over(over) for c in static}
    made["known"] = F.count(F.when(F.col("off") <= 0, 1)).over(over)
    out = rows.withColumns(made).where("off > 0")
    if unknown == "drop":
        out = out.where("known > 0")
    else:
        out = out.withColumn("sales", F.when(F.col("known") > 0, F.col("sales")).otherwise(F.raise_error(F.lit("target series that is not known at the origin")).cast("double")))
    out = out.drop("known", *static).withColumnsRenamed({f"known_{c}": c for c in static})
    return out.withColumns(calendar_columns(F.col("day"))).withColumnsRenamed({"off": "horizon", "day": "target_day"})


def store_features(store_days: DataFrame, origins: list[date]) -> DataFrame:
    """Store-day counts at the origin and 7 and 14 days before, and complete means that include it."""
    rows = by_origin(store_days, "day", origins).where("off <= 0")
    pick = lambda k: F.max(F.when(F.col("off") == -k, F.col("visits"))).cast("double")
    mean = lambda w: F.when(F.count(F.when(_within(w, 0), F.col("visits"))) == w, F.avg(F.when(_within(w, 0), F.col("visits"))))
    return rows.groupBy("origin", "store").agg(pick(0).alias("visits_at_origin"), pick(7).alias("visits_lag_7"), pick(14).alias("visits_lag_14"), mean(7).alias("visits_mean_7"), mean(14).alias("visits_mean_14"))


def market_features(prices: DataFrame, origins: list[date]) -> DataFrame:
    """Exact-day changes, change and volatility of the observed prices of the last week."""
    return price_changes(by_origin(prices, "day", origins).where("off <= 0"))


def price_changes(rows: DataFrame) -> DataFrame:
    """The same, of rows (origin, day, off, price) up to the origin."""
    at = lambda k: F.max(F.when(F.col("off") == -k, F.col("price")))
    week = F.col("price").isNotNull() & (F.col("off") >= -6)
    before = F.lag("price").over(Window.partitionBy("origin").orderBy("day"))
    seen = rows.where(week).withColumn("before", before)
    first, last = F.min_by("price", "day"), F.max_by("price", "day")
    volatile = F.when((F.count(F.lit(1)) >= 3) & (F.count_if(F.col("before") == 0) == 0), F.stddev_samp(F.try_divide("price", "before") - 1))
    rolled = seen.groupBy("origin").agg(F.when(F.count(F.lit(1)) >= 2, F.try_divide(last, first) - 1).alias("price_change_week"), volatile.alias("price_volatility_week"))
    exact = rows.groupBy("origin").agg((F.try_divide(at(0), at(1)) - 1).alias("price_change_1"), (F.try_divide(at(0), at(7)) - 1).alias("price_change_7"))
    return exact.join(rolled, "origin", "left")


#: The model table: names, order and types are its contract.
AUDIT = ["forecast_origin", "forecast_date", "forecast_horizon"]
STATIC = ["family", "class", "perishable", "city", "state", "store_type", "cluster"]
TARGET = "unit_sales"
SALES = [*(f"sales_lag_{k}" for k in LAGS), *(f"sales_rolling_mean_{w}" for w in MEANS), *(f"sales_rolling_std_{w}" for w in STDS)]
CALENDAR = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend"]
STORE_DAY = ["transactions_at_origin", "transactions_mean_7d", "transactions_mean_14d", "transactions_lag_7", "transactions_lag_14"]
OIL = ["oil_pct_change_1d", "oil_pct_change_7d", "oil_rolling_change_7d", "oil_rolling_volatility_7d"]
HOLIDAY = ["is_holiday", "holiday_type", "holiday_locale", "holiday_transferred", "holiday_event_count"]
MODEL = ["store_nbr", "item_nbr", *STATIC, *SALES, *CALENDAR, "onpromotion", *STORE_DAY, *OIL, *HOLIDAY]
TRAINING = [*AUDIT, "store_nbr", "item_nbr", *STATIC, TARGET, *SALES, *CALENDAR, "onpromotion", *STORE_DAY, *OIL, *HOLIDAY]
INFERENCE = [*AUDIT, *MODEL]
FORBIDDEN = {"id", "unit_sales", "transactions", "dcoilwtico", "holiday_description", "is_earthquake", "earthquake_flag", "days_since_earthquake"}
TYPES = (
    dict.fromkeys(["forecast_origin", "forecast_date"], "timestamp_ntz")
    | dict.fromkeys(["forecast_horizon", "perishable", "cluster", *CALENDAR[:-1]], "tinyint")
    | dict.fromkeys(["store_nbr", "class", "holiday_event_count"], "smallint")
    | {"item_nbr": "int"}
    | dict.fromkeys(["family", "city", "state", "store_type", "holiday_type", "holiday_locale"], "string")
    | dict.fromkeys([TARGET, *SALES, *STORE_DAY, *OIL], "double")
    | dict.fromkeys(["is_weekend", "onpromotion", "is_holiday", "holiday_transferred"], "boolean")
)
#: Fixed value: holidays whose note names a disaster, so that their fields are not known ahead.
DISASTER = r"(?i)terremoto|earthquake|manabi"


def narrow(column: str, kind: str) -> Column:
    """Cast of a column to a narrower type; a value that does not survive it is an error."""
    value = F.col(column)
    small = value.try_cast(kind)
    changed = value.isNotNull() & (small.isNull() | (small.cast("double") != value.cast("double")))
    return F.when(changed, F.raise_error(F.lit(f"{column} does not fit {kind}")).cast(kind)).otherwise(small)


def agreed(column: str, label: str) -> Column:
    """The one value of a group; rows that disagree, or mix null with a value, are an error."""
    differ = (F.min(column) != F.max(column)) | ((F.count(column) > 0) & (F.count(column) < F.count(F.lit(1))))
    return F.when(F.coalesce(differ, F.lit(False)), F.raise_error(F.lit(f"{column} is not the same in all rows of one {label}")).cast("double")).otherwise(F.max(column).cast("double"))


def bounded_items(rows: DataFrame, most: int | None) -> DataFrame:
    """Rows of the `most` lowest items of each origin and store that have target rows."""
    if most is None:
        return rows
    targets = rows.where("off > 0").select("origin", "store_nbr", "item_nbr").distinct()
    rank = F.row_number().over(Window.partitionBy("origin", "store_nbr").orderBy("item_nbr"))
    return rows.join(targets.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k"), ["origin", "store_nbr", "item_nbr"], "left_semi")


def model_table(base: DataFrame, origins: list[date], max_items: int | None = None, planned_promotion: bool = False, published_holidays: bool = False) -> DataFrame:
    """All columns of `TRAINING`, one row per observed target day of each origin and series.

    `base` has a row per (date, store_nbr, item_nbr) with the static attributes, sales,
    promotion, transactions of the store-day, oil price of the day and holiday fields.
    Static attributes are those of the last row at or before the origin; a target series
    without one, or with a null attribute, is an error, as are repeated grain rows and
    store-days or days that disagree on transactions or prices.  Promotion and holidays of
    a target day are null unless they are taken as planned or published ahead; those of a
    disaster stay null.
    """
    base = base.withColumn("date", F.to_date("date"))
    rows = bounded_items(by_origin(base, "date", origins), max_items)
    over = Window.partitionBy("origin", "store_nbr", "item_nbr")
    known = F.when(F.col("off") <= 0, F.col("date"))
    made = {f"sales_lag_{k}": F.max(F.when(F.col("off") == -k, F.col(TARGET))).over(over) for k in LAGS}
    made |= {f"sales_rolling_mean_{w}": complete(F.avg, TARGET, w, over) for w in MEANS}
    made |= {f"sales_rolling_std_{w}": complete(F.stddev_samp, TARGET, w, over) for w in STDS}
    made |= {"_static": F.max_by(F.struct(*STATIC), known).over(over), "_known": F.count(known).over(over)}
    made |= {"_twice": F.count(F.lit(1)).over(Window.partitionBy("origin", "store_nbr", "item_nbr", "date"))}
    out = rows.withColumns(made).where("off > 0").drop(*STATIC)
    found = F.when(F.col("_twice") > 1, F.raise_error(F.lit("repeated grain rows"))).when(F.col("_known") == 0, F.raise_error(F.lit("target series without static attributes at the origin")))
    whole = F.lit(False)
    for c in STATIC:
        whole = whole | F.col("_static")[c].isNull()
    found = found.when(whole, F.raise_error(F.lit("static attributes are null at the origin")))
    out = out.withColumns({c: F.when(found.isNull(), F.col("_static")[c]) for c in STATIC})
    out = out.withColumns(calendar_columns(F.col("date")))
    disaster = F.coalesce(F.col("holiday_description").rlike(DISASTER), F.lit(False))
    out = out.withColumn("onpromotion", F.when(F.lit(planned_promotion), F.col("onpromotion")))
    out = out.withColumns({c: F.when(F.lit(published_holidays) & ~disaster, F.col(c)) for c in HOLIDAY})
    # transactions and prices as the rows of the slice have them
    past = rows.where("off <= 0")
    days = past.groupBy("origin", "date", "off", "store_nbr").agg(agreed("transactions", "store-date").alias("v"))
    pick = lambda k: F.max(F.when(F.col("off") == -k, F.col("v")))
    mean = lambda w: F.when(F.count(F.when(_within(w, 0), F.col("v"))) == w, F.avg(F.when(_within(w, 0), F.col("v"))))
    stores = days.groupBy("origin", "store_nbr").agg(pick(0).alias(STORE_DAY[0]), mean(7).alias(STORE_DAY[1]), mean(14).alias(STORE_DAY[2]), pick(7).alias(STORE_DAY[3]), pick(14).alias(STORE_DAY[4]))
    prices = past.groupBy("origin", "date").agg(agreed("dcoilwtico", "date").alias("price"))
    oil = price_changes(prices.withColumn("off", F.datediff("date", "origin")).withColumnRenamed("date", "day"))
    out = out.join(stores, ["origin", "store_nbr"], "left").join(oil.withColumnsRenamed(dict(zip(["price_change_1", "price_change_7", "price_change_week", "price_volatility_week"], OIL, strict=True))), "origin", "left")
    out = out.withColumnsRenamed({"origin": AUDIT[0], "date": AUDIT[1], "off": AUDIT[2]})
    return out.select(*((narrow(c, TYPES[c]) if TYPES[c] in ("tinyint", "smallint", "int") else F.col(c).cast(TYPES[c])).alias(c) for c in TRAINING))


def check_contract(table: DataFrame) -> dict:
    """Facts of a model table, in one pass; raise where it breaks its contract."""
    if table.columns != TRAINING:
        raise ValueError("columns or their order differ from the contract")
    if {f.name: f.dataType.simpleString() for f in table.schema} != TYPES:
        raise ValueError("types differ from the contract")
    if FORBIDDEN & set(MODEL):
        raise ValueError("forbidden columns among the features")
    if TARGET in INFERENCE or [c for c in TRAINING if c != TARGET] != INFERENCE:
        raise ValueError("training and inference columns differ in more than the target")
    day = F.to_date("forecast_date")
    must = [*AUDIT, "store_nbr", "item_nbr", *STATIC, TARGET, *CALENDAR]
    keyed = F.struct("forecast_origin", "forecast_date", "store_nbr", "item_nbr")
    facts = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("forecast_horizon").between(1, HORIZON)).alias("bad_horizons"),
        F.count_if(day != F.date_add(F.to_date("forecast_origin"), F.col("forecast_horizon").cast("int"))).alias("bad_dates"),
        F.count_distinct(keyed).alias("grain"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        *(F.count_distinct(c).alias(f"n_{c}") for c in ("store_nbr", "item_nbr", "forecast_origin", "forecast_horizon")),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in TRAINING),
    ).first().asDict()
    broken = [k for k in ("bad_horizons", "bad_dates") if facts[k]] + [f"null_{c}" for c in must if facts[f"null_{c}"]] + (["repeated grain"] if facts["grain"] != facts["rows"] else [])
    if broken:
        raise ValueError(f"the table breaks its contract: {', '.join(broken)}")
    return facts
