"""Queries over the driver's tables, each with the DuckDB statement that must agree.

Retail concepts stand on TPC-H-like tables: sales are shipped quantities, a store is a
region, an item a part type; visits are orders a day, the market price is the mean
order total, missing at weekends.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sequences
from tidemark.plans import features, folds
from tidemark.sources import files
from tidemark.streaming import metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORIGINS = [date(1997, 3, 31), date(1998, 6, 30)]
FOLDS = [folds.Fold(1, date(1996, 6, 30)), folds.Fold(2, date(1997, 3, 31)), folds.Fold(3, date(1998, 6, 30))]


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


PANEL = """panel AS (
    SELECT l_shipdate::DATE AS day, n_regionkey AS store, p_type AS item, sum(l_quantity) AS sales
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
DAILY = "daily AS (SELECT l_shipdate::DATE AS day, sum(l_quantity) AS sales FROM lineitem GROUP BY ALL)"
STORE = """store_day AS (
    SELECT o_orderdate::DATE AS day, n_regionkey AS store, count(*) AS visits
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
PRICE = """price AS (
    SELECT day, CASE WHEN isodow(day) < 6 THEN p END AS price
    FROM (SELECT o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS p FROM orders GROUP BY ALL))"""
_DATES = ", ".join(f"DATE '{o}'" for o in ORIGINS)


def panel(t: Tables) -> DataFrame:
    """(day, store, item, sales): quantities are summed by the narrow keys before names are joined."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item"))
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("store"))
    rows = t.lineitem.select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity").join(place, "l_suppkey").join(part, "l_partkey")
    return rows.groupBy("day", "store", "item").agg(F.sum("l_quantity").alias("sales"))


def daily(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("sales"))


def store_day(t: Tables) -> DataFrame:
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("store"))
    return t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")).join(place, "o_custkey").groupBy("day", "store").agg(F.count(F.lit(1)).alias("visits"))


def price(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.groupBy(day.alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("p")).select("day", F.when(~cal.is_weekend(F.col("day")), F.col("p")).alias("price"))


@query(f"""
WITH {PANEL}, x AS (
    SELECT *, (day - origin)::BIGINT AS off FROM panel, (SELECT unnest([{_DATES}]) AS origin)
    WHERE day BETWEEN origin - 28 AND origin + 16
), h AS (
    SELECT origin, store, item, {", ".join(f"max(sales) FILTER (off = -{k}) AS sales_lag_{k}" for k in features.LAGS)},
    {", ".join(f"CASE WHEN count(*) FILTER (off BETWEEN -{w} AND -1) = {w} THEN avg(sales) FILTER (off BETWEEN -{w} AND -1) END AS sales_mean_{w}" for w in features.MEANS)},
    {", ".join(f"CASE WHEN count(*) FILTER (off BETWEEN -{w} AND -1) = {w} THEN stddev_samp(sales) FILTER (off BETWEEN -{w} AND -1) END AS sales_std_{w}" for w in features.STDS)},
    count(*) FILTER (off <= 0) AS known FROM x GROUP BY ALL
)
SELECT origin, day AS target_day, off::INT AS horizon, store, item, sales, {", ".join(f"sales_lag_{k}" for k in features.LAGS)},
    {", ".join(f"round(sales_mean_{w}, 6) AS sales_mean_{w}" for w in features.MEANS)}, {", ".join(f"round(sales_std_{w}, 6) AS sales_std_{w}" for w in features.STDS)},
    (isodow(day) - 1)::INT AS day_of_week, day(day)::INT AS day_of_month, week(day)::INT AS week_of_year, month(day)::INT AS month, quarter(day)::INT AS quarter, isodow(day) >= 6 AS is_weekend
FROM x JOIN h USING (origin, store, item) WHERE off > 0 AND known > 0""")
def feature_rows(spark, sf_dir):
    out = features.sales_features(panel(Tables(spark, sf_dir)), ORIGINS, unknown="drop")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("sales_mean", "sales_std"))})


@query(f"""
WITH {STORE}, x AS (SELECT *, (day - origin)::BIGINT AS off FROM store_day, (SELECT unnest([{_DATES}]) AS origin) WHERE day BETWEEN origin - 28 AND origin)
SELECT origin, store, max(visits) FILTER (off = 0)::DOUBLE AS visits_at_origin, max(visits) FILTER (off = -7)::DOUBLE AS visits_lag_7, max(visits) FILTER (off = -14)::DOUBLE AS visits_lag_14,
    CASE WHEN count(*) FILTER (off >= -6) = 7 THEN round(avg(visits) FILTER (off >= -6), 6) END AS visits_mean_7,
    CASE WHEN count(*) FILTER (off >= -13) = 14 THEN round(avg(visits) FILTER (off >= -13), 6) END AS visits_mean_14
FROM x GROUP BY ALL""")
def store_features(spark, sf_dir):
    out = features.store_features(store_day(Tables(spark, sf_dir)), ORIGINS)
    return out.withColumns({c: F.round(c, 6) for c in ("visits_mean_7", "visits_mean_14")})


@query(f"""
WITH {PRICE}, x AS (SELECT *, (day - origin)::BIGINT AS off FROM price, (SELECT unnest([{_DATES}]) AS origin) WHERE day BETWEEN origin - 28 AND origin),
e AS (SELECT origin, max(price) FILTER (off = 0) AS p0, max(price) FILTER (off = -1) AS p1, max(price) FILTER (off = -7) AS p7 FROM x GROUP BY ALL),
s AS (SELECT origin, day, price, lag(price) OVER (PARTITION BY origin ORDER BY day) AS before FROM x WHERE off >= -6 AND price IS NOT NULL),
r AS (SELECT origin, CASE WHEN count(*) >= 2 THEN arg_max(price, day) / nullif(arg_min(price, day), 0) - 1 END AS c,
    CASE WHEN count(*) >= 3 AND count(*) FILTER (before = 0) = 0 THEN stddev_samp(price / nullif(before, 0) - 1) END AS v FROM s GROUP BY ALL)
SELECT origin, round(p0 / nullif(p1, 0) - 1, 6) AS price_change_1, round(p0 / nullif(p7, 0) - 1, 6) AS price_change_7, round(c, 6) AS price_change_week, round(v, 6) AS price_volatility_week
FROM e LEFT JOIN r USING (origin)""")
def market_features(spark, sf_dir):
    out = features.market_features(price(Tables(spark, sf_dir)), ORIGINS)
    return out.select("origin", *(F.round(c, 6).alias(c) for c in out.columns if c != "origin"))


@query("""
SELECT r_name, c_mktsegment, count(*) AS n, count(c_custkey) AS n_matched, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_enrichment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    out = joins.many_to_one(t.orders, people, ["o_custkey"], matched="known")
    out = joins.many_to_one(out, t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    out = joins.many_to_one(out, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    return out.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("n_matched"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_EVENTS = [("1997-01-01", "Holiday", "National", "all", "New year", False), ("1997-03-01", "Event", "Regional", "EUROPE", "Spring fair", False), ("1997-03-01", "Holiday", "Local", "NATION_3", "Town day", True), ("1997-03-01", "Holiday", "Regional", "ASIA", " ", False), ("1997-05-01", "Work Day", "National", "all", "Bridge", False), ("1997-05-01", "Holiday", "Local", "nowhere", "Lost", False)]


@query(f"""
WITH e(day, kind, scope, scope_name, note, moved) AS (VALUES {", ".join(f"(DATE '{d}', '{k}', '{s}', '{n}', '{o}', {m})" for d, k, s, n, o, m in _EVENTS)}),
p AS (SELECT n_nationkey AS place, r_name AS region, n_name AS town FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT e.*, place FROM e JOIN p ON scope = 'National' OR (scope = 'Regional' AND scope_name = region) OR (scope = 'Local' AND scope_name = town))
SELECT day, place, bool_or(NOT moved AND kind <> 'Work Day') AS is_holiday, string_agg(DISTINCT note, ' | ' ORDER BY note) FILTER (trim(note) <> '') AS notes, count(*) AS n_events FROM x GROUP BY ALL""")
def scope_expansion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    events = spark.createDataFrame([(date.fromisoformat(d), *rest) for d, *rest in _EVENTS], "day date, kind string, scope string, scope_name string, note string, moved boolean")
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"), F.col("n_name").alias("town"))
    return joins.scope_expand(events, places).select("day", "place", "is_holiday", "notes", "n_events")


@query(f"""WITH {PANEL} SELECT day, store, item, sales, max(sales) OVER (w RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS lag_1, max(sales) OVER (w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS lag_7
FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY day)""")
def exact_lags(spark, sf_dir):
    return joins.exact_offset(panel(Tables(spark, sf_dir)), ["store", "item"], "day", "sales", [1, 7])


@query(f"""
WITH {PANEL.replace("panel AS (", "panel AS MATERIALIZED (")}, c AS (SELECT row_number() OVER () AS case_id, * FROM (FROM panel ORDER BY sales DESC, day, store, item LIMIT 20))
SELECT case_id::INT AS case_id, c.store, c.item, p.day, p.sales, (p.day - c.day)::INT AS relative_day FROM c JOIN (SELECT *, unnest(generate_series(-7, 7)) AS k FROM c) x USING (case_id) JOIN panel p ON p.store = c.store AND p.item = c.item AND p.day = c.day + x.k::INT""")
def interval_context(spark, sf_dir):
    facts = panel(Tables(spark, sf_dir))
    top = sequences.largest(facts, "sales", 20, ["day", "store", "item"])
    cases = top.withColumn("case_id", F.row_number().over(Window.orderBy(F.col("sales").desc(), "day", "store", "item")))
    return joins.around(cases, facts, ["store", "item"], "day").select("case_id", "store", "item", "day", "sales", "relative_day")


@query(f"""
WITH {PRICE}, c AS (SELECT day AS case_day FROM price WHERE price IS NULL),
x AS (SELECT * FROM c JOIN price ON day BETWEEN case_day - 5 AND case_day + 5)
SELECT case_day, arg_max(price, day) FILTER (day < case_day AND price IS NOT NULL) AS previous_price, arg_min(price, day) FILTER (day > case_day AND price IS NOT NULL) AS next_price FROM x GROUP BY ALL""")
def nearest_prices(spark, sf_dir):
    prices = price(Tables(spark, sf_dir))
    gaps = prices.where("price is null").select(F.col("day").alias("case_day"))
    # each case looks at eleven days: an equi-join instead of a range join
    near = gaps.withColumn("day", F.explode(F.sequence(F.date_sub("case_day", 5), F.date_add("case_day", 5)))).join(prices, "day")
    valid = F.col("price").isNotNull()
    return near.groupBy("case_day").agg(F.max_by("price", F.when(valid & (F.col("day") < F.col("case_day")), F.col("day"))).alias("previous_price"), F.min_by("price", F.when(valid & (F.col("day") > F.col("case_day")), F.col("day"))).alias("next_price"))


@query("""SELECT 'customer' AS kind, count(*) AS n FROM (SELECT DISTINCT o_custkey k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order', count(*) FROM (SELECT DISTINCT l_orderkey k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'idle customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphan_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = {"customer": joins.orphans(t.orders, t.customer, "o_custkey", "c_custkey"), "order": joins.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey"), "idle customer": joins.orphans(t.customer, t.orders, "c_custkey", "o_custkey")}
    parts = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT o_custkey, max(o_orderdate)::DATE AS day, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders WHERE o_orderdate::DATE <= DATE '1997-03-31' GROUP BY ALL""")
def latest_at_origin(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))
    return joins.latest_at(rows, ["o_custkey"], "day", ["day", "priority"], F.lit(ORIGINS[0]), ties=["o_orderdate", "o_orderkey"])


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT 'left' AS side, count(*) AS count FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT ALL FROM a)""")
def paired_differences(spark, sf_dir):
    a = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    return joins.differences(a, a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {f.number} AS fold, count(*) FILTER (d <= DATE '{f.origin}') AS n_train, count(*) FILTER (d BETWEEN DATE '{f.start}' AND DATE '{f.end}') AS n_validation, count(DISTINCT d) FILTER (d BETWEEN DATE '{f.start}' AND DATE '{f.end}') AS n_days FROM (SELECT l_shipdate::DATE AS d FROM lineitem)" for f in FOLDS) + ")")
def fold_populations(spark, sf_dir):
    folds.check(FOLDS, folds.Fold(4, date(2000, 6, 30)))
    return folds.populations(Tables(spark, sf_dir).lineitem.select(F.to_date("l_shipdate").alias("day")), "day", FOLDS)


@query(f"""WITH {PANEL} SELECT grouping_id(y, store, item)::BIGINT AS grain, y, store, item, sum(sales) AS sales, count(*) AS n FROM (SELECT *, year(day)::INT AS y FROM panel) GROUP BY GROUPING SETS ((), (y), (store), (item), (store, item), (y, store))""")
def grouped_totals(spark, sf_dir):
    keys = ["y", "store", "item"]
    rows = panel(Tables(spark, sf_dir)).withColumn("y", F.year("day"))
    return rows.groupingSets([(), ("y",), ("store",), ("item",), ("store", "item"), ("y", "store")], *keys).agg(F.grouping_id(*keys).alias("grain"), F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_shipdate::DATE) AS n_days, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_discount = 0) AS n_zero, count(*) FILTER (l_discount > 0) AS n_positive, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY ALL""")
def profile(spark, sf_dir):
    day = F.to_date("l_shipdate")
    return Tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_days"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_discount") == 0).alias("n_zero"), F.count_if(F.col("l_discount") > 0).alias("n_positive"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query(f"""WITH {PANEL} SELECT store, item, round(avg(sales), 6) AS mean, round(median(sales), 6) AS median, round(stddev_samp(sales), 6) AS std, min(sales) AS least, max(sales) AS most, round(stddev_samp(sales) / nullif(avg(sales), 0), 6) AS variation FROM panel GROUP BY ALL""")
def series_summary(spark, sf_dir):
    return panel(Tables(spark, sf_dir)).groupBy("store", "item").agg(*agg.describe("sales"), F.round(F.try_divide(F.stddev_samp("sales"), F.avg("sales")), 6).alias("variation"))


QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(f"SELECT q, round(v, 6) AS value FROM (SELECT unnest({QUANTILES})::DOUBLE AS q, unnest(quantile_cont(o_totalprice, {QUANTILES})) AS v FROM orders)")
def exact_quantiles(spark, sf_dir):
    return agg.quantiles(Tables(spark, sf_dir).orders, "o_totalprice", QUANTILES).select("q", F.round("value", 6).alias("value"))


@query("""WITH x AS (SELECT o_custkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) SELECT o_custkey, (count(DISTINCT p) + max((p IS NULL)::INT))::BIGINT AS n FROM x GROUP BY ALL""")
def distinct_with_null(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select("o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return rows.groupBy("o_custkey").agg(agg.count_with_null("p").cast("long").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, nullif(l_linestatus, 'O') AS s FROM lineitem) SELECT l_orderkey, min(s) AS least, max(s) AS most, count(s) AS n_values, count(*) AS n_rows FROM x GROUP BY ALL HAVING min(s) <> max(s) OR (count(s) > 0 AND count(s) < count(*))""")
def conflicting_keys(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", F.nullif("l_linestatus", F.lit("O")).alias("s"))
    return agg.conflicts(rows, ["l_orderkey"], "s")


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) FILTER (p_size > 40) AS kinds FROM part GROUP BY ALL""")
def distinct_text(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.withColumn("kind", F.when(F.col("p_size") > 40, F.col("p_type")))
    return rows.groupBy("p_brand").agg(joins.distinct_text("kind").alias("kinds"))


@query("""WITH x AS (SELECT nullif(event_type, 'view') AS k FROM events) SELECT k, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM x GROUP BY k""")
def value_counts(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.select(F.nullif("event_type", F.lit("view")).alias("k"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("k", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))  # one row per value


_GRAINS = [(), ("y",), ("m",), ("day",), ("store",), ("item",), ("family",), ("store", "item"), ("store", "day")]


@query(f"""WITH x AS (SELECT l_shipdate::DATE AS day, year(l_shipdate)::INT AS y, strftime(l_shipdate, '%Y-%m') AS m, n_regionkey AS store, p_brand AS item, p_type AS family, CASE WHEN l_shipdate < DATE '1996-01-01' THEN NULL ELSE l_discount >= 0.05 END AS promo
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
SELECT grouping_id(y, m, day, store, item, family)::BIGINT AS grain, y, m, day, store, item, family, count(*) FILTER (promo) AS n_true, count(*) FILTER (NOT promo) AS n_false, count(*) FILTER (promo IS NULL) AS n_missing, round(100.0 * count(*) FILTER (promo IS NULL) / count(*), 6) AS pct_missing
FROM x GROUP BY GROUPING SETS ({", ".join(f"({', '.join(g)})" for g in _GRAINS)})""")
def status_by_grain(spark, sf_dir):
    """Counts of true, false and missing overall and by year, month, date, store, item, family, store with item and store with date."""
    t = Tables(spark, sf_dir)
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("store"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"), F.col("p_type").alias("family"))
    rows = t.lineitem.select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("day"), F.when(F.col("l_shipdate") >= F.lit(date(1996, 1, 1)), F.col("l_discount") >= 0.05).alias("promo"))
    # rows of a day, store and item are counted once before they are spread over the grains
    cells = rows.join(place, "l_suppkey").join(part, "l_partkey").groupBy("day", "store", "item", "family", "promo").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"y": F.year("day"), "m": F.date_format("day", "yyyy-MM")})
    keys = ["y", "m", "day", "store", "item", "family"]
    return cells.groupingSets([tuple(g) for g in _GRAINS], *keys).agg(F.grouping_id(*keys).alias("grain"), *agg.status_sums("promo", "n"))


@query("""WITH x AS (SELECT l_partkey, sum(l_quantity) AS t FROM lineitem GROUP BY ALL), r AS (SELECT t, row_number() OVER (ORDER BY t DESC, l_partkey) AS k, count(*) OVER () AS n FROM x)
SELECT round(sum(t) FILTER (k = 1) / sum(t), 6) AS top_1, round(sum(t) FILTER (k <= 10) / sum(t), 6) AS top_10, round(sum(t) FILTER (k <= greatest(ceil(n * 0.2), 1)) / sum(t), 6) AS top_fifth FROM r""")
def concentration(spark, sf_dir):
    return agg.concentration(Tables(spark, sf_dir).lineitem, "l_partkey", "l_quantity")


@query(f"""WITH {DAILY}, {PRICE} SELECT round(corr(sales, price), 6) AS r, round(avg((price IS NOT NULL)::INT), 6) AS covered, count(*) AS n FROM daily LEFT JOIN price USING (day)""")
def aligned_correlation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return daily(t).join(price(t), "day", "left").agg(F.round(F.corr("sales", "price"), 6).alias("r"), F.round(F.avg(F.col("price").isNotNull().cast("int")), 6).alias("covered"), F.count(F.lit(1)).alias("n"))


@query("""SELECT sum(n - 1)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_grain(spark, sf_dir):
    return agg.duplicate_counts(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH x AS (SELECT nullif(o_orderstatus, 'F') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders)
SELECT 'o_orderstatus' AS column, count(*) FILTER (o_orderstatus IS NULL) AS n_null, round(100.0 * count(*) FILTER (o_orderstatus IS NULL) / count(*), 6) AS pct_null FROM x
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), round(100.0 * count(*) FILTER (o_orderpriority IS NULL) / count(*), 6) FROM x UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), round(100.0 * count(*) FILTER (o_totalprice IS NULL) / count(*), 6) FROM x""")
def null_counts(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_totalprice")
    return agg.null_counts(rows)


@query("""WITH s AS (SELECT l_partkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b, count(DISTINCT l_shipdate::DATE) AS o FROM lineitem GROUP BY ALL), x AS (SELECT *, (b - a) + 1 AS span, o / ((b - a) + 1)::DOUBLE AS share FROM s)
SELECT count(*) AS n_series, count(*) FILTER (span < 180 OR o < 60) AS n_short, count(*) FILTER (share < 0.25) AS n_intermittent, round(avg(share), 6) AS mean_share FROM x""")
def series_coverage(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_partkey", F.to_date("l_shipdate").alias("day"))
    return agg.coverage(rows, ["l_partkey"], "day")


@query("""SELECT p_brand, count(DISTINCT p_type) AS n_types FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1""")
def dependency_probe(spark, sf_dir):
    return Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n_types")).where("n_types > 1")


@query(f"""WITH {DAILY}, x AS (SELECT *, CASE WHEN day BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' THEN 'during' WHEN day BETWEEN DATE '1997-01-29' AND DATE '1997-02-28' THEN 'before' WHEN day BETWEEN DATE '1997-04-01' AND DATE '1997-05-01' THEN 'after' END AS period FROM daily),
s AS (SELECT period, count(*) AS n_days, avg(sales) AS m, median(sales) AS d FROM x WHERE period IS NOT NULL GROUP BY ALL), b AS (SELECT avg(sales) AS m, median(sales) AS d FROM x WHERE period IN ('before', 'after'))
SELECT period, n_days, round(s.m, 6) AS mean, round(100 * (s.m - b.m) / b.m, 6) AS mean_change, round(100 * (s.d - b.d) / b.d, 6) AS median_change FROM s, b""")
def period_comparison(spark, sf_dir):
    span = lambda a, b: F.col("day").between(F.lit(date.fromisoformat(a)), F.lit(date.fromisoformat(b)))
    rows = daily(Tables(spark, sf_dir)).withColumn("period", F.when(span("1997-03-01", "1997-03-31"), "during").when(span("1997-01-29", "1997-02-28"), "before").when(span("1997-04-01", "1997-05-01"), "after")).where("period is not null")
    base = rows.where("period <> 'during'").agg(F.avg("sales").alias("bm"), F.median("sales").alias("bd"))
    own = rows.groupBy("period").agg(F.count(F.lit(1)).alias("n_days"), F.avg("sales").alias("m"), F.median("sales").alias("d"))
    return own.crossJoin(F.broadcast(base)).select("period", "n_days", F.round("m", 6).alias("mean"), F.round(100 * (F.col("m") - F.col("bm")) / F.col("bm"), 6).alias("mean_change"), F.round(100 * (F.col("d") - F.col("bd")) / F.col("bd"), 6).alias("median_change"))  # base: one row


@query("""SELECT count(*) FILTER (abs(v - round_even(v, 0)) > 1e-9 + 1e-5 * abs(round_even(v, 0))) AS n_fractional, count(*) AS n FROM (SELECT l_extendedprice AS v FROM lineitem)""")
def fractional_values(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.agg(F.count_if(cal.fractional(F.col("l_extendedprice"))).alias("n_fractional"), F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice / 100 END AS v FROM lineitem)
SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v < 0 THEN 'negative' WHEN v = 0 THEN 'zero' WHEN v <= 10 THEN 'to 10' WHEN v <= 100 THEN 'to 100' ELSE 'above 100' END AS bucket, count(*) AS n FROM x GROUP BY ALL""")
def magnitude_buckets(spark, sf_dir):
    v = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(F.col("l_returnflag") != "A", F.col("l_extendedprice") / 100)
    return Tables(spark, sf_dir).lineitem.groupBy(cal.magnitude(v).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'no discount' AS rule, count(*) FILTER (l_discount = 0) AS n FROM lineitem UNION ALL SELECT 'large and open', count(*) FILTER (l_quantity > 45 AND l_linestatus = 'O') FROM lineitem UNION ALL SELECT 'never', count(*) FILTER (l_quantity < 0) FROM lineitem""")
def anomaly_rules(spark, sf_dir):
    return agg.rules(Tables(spark, sf_dir).lineitem, {"no discount": F.col("l_discount") == 0, "large and open": (F.col("l_quantity") > 45) & (F.col("l_linestatus") == "O"), "never": F.col("l_quantity") < 0})


@query(f"""WITH {PANEL}, m AS (SELECT item, strftime(day, '%Y-%m') AS month, sum(sales) AS s FROM panel GROUP BY ALL), x AS (SELECT *, lag(s) OVER (PARTITION BY item ORDER BY month) AS p FROM m)
SELECT item, month, s AS sales, s - p AS change, round((s - p) / nullif(p, 0), 6) AS pct FROM x WHERE p IS NOT NULL ORDER BY s - p DESC, item, month LIMIT 10""")
def monthly_movement(spark, sf_dir):
    months = panel(Tables(spark, sf_dir)).groupBy("item", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("sales").alias("sales"))
    before = F.lag("sales").over(Window.partitionBy("item").orderBy("month"))
    rows = months.withColumn("p", before).select("item", "month", "sales", (F.col("sales") - F.col("p")).alias("change"), F.round(cal.relative_change(F.col("sales"), F.col("p")), 6).alias("pct"))
    return sequences.largest(rows, "change", 10, ["item", "month"])


@query(f"""WITH {PANEL}, c AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day, store, item FROM (SELECT store, item, min(day) AS a, max(day) AS b FROM panel GROUP BY ALL)),
g AS (SELECT c.* FROM c ANTI JOIN panel USING (day, store, item)), r AS (SELECT *, day - row_number() OVER (PARTITION BY store, item ORDER BY day)::INT AS k FROM g)
SELECT store, item, min(day) AS start, max(day) AS "end", count(*) AS days FROM r GROUP BY store, item, k""")
def missing_runs(spark, sf_dir):
    rows = panel(Tables(spark, sf_dir))
    ends = rows.groupBy("store", "item").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select("store", "item", F.explode(F.sequence("a", "b")).alias("day"))
    return sequences.islands(spine.join(rows, ["day", "store", "item"], "left_anti"), ["store", "item"], "day")


@query(f"""WITH {PANEL}, r AS (SELECT store, item, day, day - row_number() OVER (PARTITION BY store, item ORDER BY day)::INT AS k FROM panel), i AS (SELECT store, item, min(day) AS start, max(day) AS "end", count(*) AS days FROM r GROUP BY store, item, k)
SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY store, item ORDER BY days DESC, start) = 1""")
def longest_runs(spark, sf_dir):
    return sequences.longest(sequences.islands(panel(Tables(spark, sf_dir)), ["store", "item"], "day"), ["store", "item"])


@query(f"""WITH {PANEL}, x AS (SELECT day, store, item, count(*) OVER w AS n, avg(sales) OVER w AS m, stddev_samp(sales) OVER w AS s FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT day, store, item, CASE WHEN n = 7 THEN round(m, 6) END AS mean_7, CASE WHEN n = 7 THEN round(s, 6) END AS std_7 FROM x""")
def complete_windows(spark, sf_dir):
    keys = ["store", "item"]
    rows, block = sequences.in_blocks(panel(Tables(spark, sf_dir)), keys, "day", 7), [*keys, "_block"]
    out = rows.withColumns({"mean_7": F.round(sequences.complete(F.avg, "sales", 7, block, "day"), 6), "std_7": F.round(sequences.complete(F.stddev_samp, "sales", 7, block, "day"), 6)})
    return sequences.own_rows(out).select("day", *keys, "mean_7", "std_7")


@query(f"""WITH {PANEL} SELECT store, item, (SELECT day FROM panel q WHERE q.store = p.store AND q.item = p.item ORDER BY sales DESC, day LIMIT 1) AS peak, (SELECT day FROM panel q WHERE q.store = p.store AND q.item = p.item ORDER BY sales, day LIMIT 1) AS low, arg_max(sales, day) AS latest FROM panel p GROUP BY ALL""")
def peaks(spark, sf_dir):
    return panel(Tables(spark, sf_dir)).groupBy("store", "item").agg(sequences.peak("day", "sales").alias("peak"), sequences.peak("day", "sales", lowest=True).alias("low"), F.max_by("sales", "day").alias("latest"))


@query(f"""WITH {PANEL}, m AS (SELECT store, strftime(day, '%Y-%m') AS month, sum(sales) AS s FROM panel GROUP BY ALL), x AS (SELECT *, min((s > 100)::INT) OVER (PARTITION BY store ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS holds FROM m)
SELECT store, min(month) FILTER (holds) AS since FROM x GROUP BY ALL""")
def holds_since(spark, sf_dir):
    months = panel(Tables(spark, sf_dir)).groupBy("store", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("sales").alias("s"))
    return months.withColumn("holds", sequences.from_then_on(F.col("s") > 100, ["month"], ["store"])).groupBy("store").agg(F.min(F.when(F.col("holds"), F.col("month"))).alias("since"))


@query(f"""WITH {PANEL} SELECT item, dayname(day) AS weekday, round(avg(sales), 6) AS mean, round(median(sales), 6) AS median, count(*) AS n, round(sum(sales) / sum(sum(sales)) OVER (PARTITION BY item), 6) AS share FROM panel GROUP BY item, dayname(day)""")
def seasonality(spark, sf_dir):
    s = panel(Tables(spark, sf_dir)).groupBy("item", F.date_format("day", "EEEE").alias("weekday")).agg(F.round(F.avg("sales"), 6).alias("mean"), F.round(F.median("sales"), 6).alias("median"), F.count(F.lit(1)).alias("n"), F.sum("sales").alias("t"))
    return s.withColumn("share", F.round(F.col("t") / F.sum("t").over(Window.partitionBy("item")), 6)).drop("t")


@query(f"""WITH {DAILY}, e AS (SELECT min(day) AS a, max(day) AS b FROM daily) SELECT (date_trunc('week', day)::DATE + 6) AS week_end, sum(sales) AS sales, (date_trunc('week', day)::DATE >= any_value(a) AND date_trunc('week', day)::DATE + 6 <= any_value(b)) AS whole FROM daily, e GROUP BY date_trunc('week', day)""")
def weekly_totals(spark, sf_dir):
    rows = daily(Tables(spark, sf_dir))
    ends = F.broadcast(rows.agg(F.min("day").alias("a"), F.max("day").alias("b")))  # one row
    weeks = rows.groupBy(cal.week_ending_sunday(F.col("day")).alias("week_end")).agg(F.sum("sales").alias("sales"))
    return weeks.crossJoin(ends).select("week_end", "sales", ((F.date_sub("week_end", 6) >= F.col("a")) & (F.col("week_end") <= F.col("b"))).alias("whole"))


@query(f"""WITH {STORE}, e AS (SELECT min(day) AS a, max(day) AS b FROM store_day), m AS (SELECT DISTINCT last_day(d::DATE) AS m FROM (SELECT unnest(generate_series(date_trunc('month', a), b::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM e)),
c AS (SELECT m, store FROM m, (SELECT DISTINCT store FROM store_day)), t AS (SELECT last_day(day) AS m, store, sum(visits) AS v FROM store_day GROUP BY ALL)
SELECT m AS month_end, store, coalesce(v, 0)::BIGINT AS visits, v::BIGINT AS visits_or_null, (date_trunc('month', m)::DATE >= a AND m <= b) AS whole FROM c LEFT JOIN t USING (m, store), e""")
def monthly_spine(spark, sf_dir):
    """Every month of every store: totals with 0 or null for months without rows, and whether the data hold the whole month."""
    rows = store_day(Tables(spark, sf_dir))
    ends = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    months = ends.select("a", "b", F.explode(F.sequence(F.trunc("a", "MM"), F.col("b"), F.expr("interval 1 month"))).alias("d")).select("a", "b", F.last_day("d").alias("month_end"))
    spine = rows.select("store").distinct().crossJoin(F.broadcast(months))  # a row per month of the calendar
    totals = rows.groupBy("store", F.last_day("day").alias("month_end")).agg(F.sum("visits").alias("v"))
    out = spine.join(totals, ["store", "month_end"], "left")
    return out.select("month_end", "store", F.coalesce("v", F.lit(0)).alias("visits"), F.col("v").alias("visits_or_null"), cal.whole_month(F.col("month_end"), F.col("a"), F.col("b")).alias("whole"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN k = 1 THEN 'least' WHEN k = n THEN 'most' ELSE 'middle' END AS pick FROM r WHERE k = 1 OR k = n OR k = n // 2 + 1""")
def representative_rows(spark, sf_dir):
    over = Window.partitionBy("o_custkey")
    r = Tables(spark, sf_dir).orders.withColumns({"k": F.row_number().over(over.orderBy("o_totalprice", "o_orderkey")), "n": F.count(F.lit(1)).over(over)})
    k, n = F.col("k"), F.col("n")
    return r.where((k == 1) | (k == n) | (k == F.floor(n / 2) + 1)).select("o_custkey", "o_orderkey", F.when(k == 1, "least").when(k == n, "most").otherwise("middle").alias("pick"))


@query("""SELECT l_suppkey, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS rate FROM lineitem GROUP BY ALL HAVING count(*) >= 20 ORDER BY avg((l_returnflag = 'R')::INT) DESC, l_suppkey LIMIT 15""")
def rate_ranking(spark, sf_dir):
    rates = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("rate")).where("n >= 20")
    return rates.orderBy(F.col("rate").desc(), "l_suppkey").limit(15).select("l_suppkey", "n", F.round("rate", 6).alias("rate"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_tax = 0)
SELECT 'union' AS kind, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b)""")
def key_sets(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem
    a = rows.where("l_returnflag = 'R' and l_discount = 0.1D").select(F.col("l_suppkey").alias("k")).distinct()
    b = rows.where("l_returnflag = 'N' and l_tax = 0").select(F.col("l_suppkey").alias("k")).distinct()
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("k").agg(F.sum("s").alias("s"))  # one shuffle for all three
    return both.agg(F.count(F.lit(1)).alias("u"), F.count_if(F.col("s") == 1).alias("e"), F.count_if(F.col("s") == 3).alias("i")).selectExpr("stack(3, 'union', u, 'except', e, 'intersect', i) as (kind, n)")


@query("""SELECT l_linestatus, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL""")
def pivoted(spark, sf_dir):
    wide = Tables(spark, sf_dir).lineitem.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).sum("l_quantity")
    return wide.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("""SELECT p_type, p_type ~* 'steel|copper' AS metal, contains(lower(p_type), 'ed') AS has_ed, len(string_split(p_type, ' '))::INT AS n_tokens, list_contains(string_split(p_type, ' '), 'ECONOMY') AS economy, trim(p_type) || '/' || c::VARCHAR AS label FROM (SELECT p_type, count(*) AS c FROM part GROUP BY ALL)""")
def text_functions(spark, sf_dir):
    kind = F.col("p_type")
    rows = Tables(spark, sf_dir).part.groupBy("p_type").agg(F.count(F.lit(1)).alias("c"))
    tokens = F.split(kind, " ")
    return rows.select("p_type", F.coalesce(kind.rlike("(?i)steel|copper"), F.lit(False)).alias("metal"), F.contains(F.lower(kind), F.lit("ed")).alias("has_ed"), F.size(tokens).alias("n_tokens"), F.array_contains(tokens, "ECONOMY").alias("economy"), F.concat_ws("/", F.trim(kind), F.col("c").cast("string")).alias("label"))


@query(f"""WITH {DAILY}, e AS (SELECT min(day) AS a, max(day) AS b FROM daily) SELECT CASE WHEN day - a <= 7 AND b - day <= 7 THEN 'both' WHEN day - a <= 7 THEN 'start' WHEN b - day <= 7 THEN 'end' ELSE 'interior' END AS place, count(*) AS n FROM daily, e GROUP BY ALL""")
def boundary_classes(spark, sf_dir):
    rows = daily(Tables(spark, sf_dir))
    ends = F.broadcast(rows.agg(F.min("day").alias("a"), F.max("day").alias("b")))  # one row
    return rows.crossJoin(ends).groupBy(cal.near_edge(F.col("day"), F.col("a"), F.col("b")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRICE} SELECT pattern, count(*) AS n FROM (SELECT s.day, CASE WHEN f.price IS NOT NULL AND m.price IS NOT NULL AND s.price IS NULL AND u.price IS NULL THEN 'bounded weekend' WHEN s.price IS NULL AND u.price IS NULL THEN 'open weekend' ELSE 'other' END AS pattern
FROM price s LEFT JOIN price f ON f.day = s.day - 1 LEFT JOIN price u ON u.day = s.day + 1 LEFT JOIN price m ON m.day = s.day + 2 WHERE isodow(s.day) = 6) GROUP BY ALL""")
def weekend_patterns(spark, sf_dir):
    order = Window.partitionBy(F.trunc(F.date_sub("day", 4), "WEEK")).orderBy(F.unix_date("day"))  # Friday to Monday fall in one cell
    at = lambda k: F.max("price").over(order.rangeBetween(k, k))
    rows = price(Tables(spark, sf_dir)).withColumns({"f": at(-1), "u": at(1), "m": at(2)}).where(F.weekday("day") == 5)
    gap = F.col("price").isNull() & F.col("u").isNull()
    return rows.groupBy(F.when(gap & F.col("f").isNotNull() & F.col("m").isNotNull(), "bounded weekend").when(gap, "open weekend").otherwise("other").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, coalesce(event_type, 'unknown') AS kind, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_error, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_counts(spark, sf_dir):
    return metrics.counts(Tables(spark, sf_dir).events)


_LE = ", ".join(f"({b}::DOUBLE)" for b in metrics.BUCKETS)


@query(f"""SELECT event_type AS kind, n, le, cumulative FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) JOIN (SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative FROM events, (VALUES {_LE}) b(le) GROUP BY ALL) USING (event_type)""")
def value_histogram(spark, sf_dir):
    return metrics.histogram(Tables(spark, sf_dir).events)


@query(f"""WITH h AS (SELECT event_type AS kind, le, count(*) FILTER (value <= le) AS c, count(*) AS n FROM events, (VALUES {_LE}) b(le) GROUP BY ALL), x AS (SELECT *, coalesce(lag(c) OVER w, 0) AS b, coalesce(lag(le) OVER w, 0) AS f FROM h WINDOW w AS (PARTITION BY kind ORDER BY le))
SELECT kind, round(coalesce(max(CASE WHEN c >= 0.95 * n AND b < 0.95 * n THEN f + (le - f) * (0.95 * n - b) / (c - b) END), max(le)), 6) AS quantile FROM x GROUP BY ALL""")
def histogram_quantile(spark, sf_dir):
    return metrics.quantile(metrics.histogram(Tables(spark, sf_dir).events), 0.95)


@query(f"""WITH {PANEL}, x AS (SELECT a.sales AS y, b.sales AS f, CASE WHEN a.store = 0 THEN 1.25 ELSE 1.0 END AS w FROM panel a JOIN panel b ON b.store = a.store AND b.item = a.item AND b.day = a.day - 7)
SELECT count(*) AS n, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(sum(abs(y - f)) / sum(abs(y)), 6) AS wape, round(avg(f - y), 6) AS bias, round(sqrt(sum(w * (ln(1 + f) - ln(1 + y)) ** 2) / sum(w)), 6) AS weighted_rmsle FROM x""")
def naive_forecast_errors(spark, sf_dir):
    rows = joins.exact_offset(panel(Tables(spark, sf_dir)), ["store", "item"], "day", "sales", [7]).where("lag_7 is not null")
    e, w = F.col("sales") - F.col("lag_7"), F.when(F.col("store") == 0, 1.25).otherwise(1.0)
    logs = F.pow(F.log1p("lag_7") - F.log1p("sales"), 2)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.sum(F.abs(e)) / F.sum(F.abs("sales")), 6).alias("wape"), F.round(F.avg(-e), 6).alias("bias"), F.round(F.sqrt(F.sum(w * logs) / F.sum(w)), 6).alias("weighted_rmsle"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, count(*) AS n FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY ALL""")
def modulus_sample(spark, sf_dir):
    """The sampling operator itself: one row in a hundred, by key."""
    rows = Tables(spark, sf_dir).lineitem.where(F.pmod("l_orderkey", F.lit(100)) == 0)
    return agg.with_median(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), rows, ["l_returnflag"], "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate BETWEEN DATE '1997-03-01' AND DATE '1997-03-07' AND l_suppkey IN (1, 2, 3, 5, 8)""")
def bounded_slice(spark, sf_dir):
    return files.slice_of(Tables(spark, sf_dir).lineitem, "l_shipdate", date(1997, 3, 1), date(1997, 3, 7), "l_suppkey", [1, 2, 3, 5, 8], ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"])


@query("""WITH e AS (SELECT *, lag(ts) OVER w AS p_ts, lag(user_id) OVER w AS p_user FROM events WINDOW w AS (ORDER BY event_id))
SELECT 'ts' AS name, count(*) AS rows, count(*) FILTER (ts <= p_ts) AS breaks FROM e UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id <= p_user) FROM e""")
def order_certificate(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    found = [sequences.order_breaks(events, "event_id", [k], block=1000).select(F.lit(k).alias("name"), "rows", "breaks") for k in ("ts", "user_id")]
    return found[0].unionByName(found[1])


@query("""WITH p AS (SELECT n_nationkey AS place, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT o_orderdate::DATE AS day, c_nationkey AS place FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT day, region, count(DISTINCT place) AS represented, any_value(n) AS expected, count(DISTINCT place) = any_value(n) AS consistent
FROM f JOIN p USING (place) JOIN (SELECT region, count(DISTINCT place) AS n FROM p GROUP BY ALL) USING (region) GROUP BY day, region""")
def scope_consistency(spark, sf_dir):
    t = Tables(spark, sf_dir)
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"))
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").alias("place"))
    return agg.scope_check(facts, places, "day", "region", "place")


@query(f"""WITH {PANEL}, top AS (SELECT store, item, day FROM panel ORDER BY sales DESC, day, store, item LIMIT 20),
often AS (SELECT store, item, max_by(day, (sales, -(day - DATE '1970-01-01'))) AS day FROM panel GROUP BY store, item ORDER BY count(*) DESC, store, item LIMIT 10),
c AS (SELECT row_number() OVER (ORDER BY sales DESC, day, store, item) AS case_id, * FROM panel JOIN (FROM top UNION FROM often) USING (store, item, day))
SELECT case_id::INT AS case_id, c.store, c.item, c.day, c.sales, count(*) AS n_days, round(avg(p.sales) FILTER (p.day < c.day), 6) AS before_mean, round(avg(p.sales) FILTER (p.day > c.day), 6) AS after_mean, round(any_value(c.sales) / sum(p.sales), 6) AS share
FROM c JOIN panel p ON p.store = c.store AND p.item = c.item AND p.day BETWEEN c.day - 7 AND c.day + 7 GROUP BY ALL""")
def case_studies(spark, sf_dir):
    """The largest days and the peaks of the busiest series, each with its surroundings."""
    facts, keys = panel(Tables(spark, sf_dir)), ["store", "item", "day"]
    top = sequences.largest(facts, "sales", 20, ["day", "store", "item"]).select(*keys)
    often = facts.groupBy("store", "item").agg(sequences.peak("day", "sales").alias("day"), F.count(F.lit(1)).alias("n"))
    often = sequences.largest(often, "n", 10, ["store", "item"]).select(*keys)
    cases = facts.join(F.broadcast(top.union(often).distinct()), keys)  # thirty at most
    cases = cases.withColumn("case_id", F.row_number().over(Window.orderBy(F.col("sales").desc(), "day", "store", "item")))
    near = joins.around(cases, facts, ["store", "item"], "day")
    about = near.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.round(F.avg(F.when(F.col("relative_day") < 0, F.col("sales"))), 6).alias("before_mean"),
        F.round(F.avg(F.when(F.col("relative_day") > 0, F.col("sales"))), 6).alias("after_mean"),
        F.sum("sales").alias("total"),
    )
    return cases.join(about, "case_id").select("case_id", *keys, "sales", "n_days", "before_mean", "after_mean", F.round(F.col("sales") / F.col("total"), 6).alias("share"))


@query("""WITH m AS (SELECT coalesce(event_type, 'unknown') AS kind, epoch_us(ts) AS t, 1 AS d FROM events WHERE value IS NOT NULL UNION ALL SELECT coalesce(event_type, 'unknown'), epoch_us(ts) + round(value * 1000000)::BIGINT, -1 FROM events WHERE value IS NOT NULL),
s AS (SELECT kind, t // 3600000000 AS hour, sum(d) OVER (PARTITION BY kind ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o, d FROM m WHERE t IS NOT NULL),
g AS (SELECT kind, hour, max(o) AS most, sum(d) AS change, sum(sum(d)) OVER (PARTITION BY kind ORDER BY hour) AS o FROM s GROUP BY kind, hour)
SELECT kind, hour, greatest(most, o - change)::BIGINT AS peak, o::BIGINT AS open FROM g""")
def in_progress(spark, sf_dir):
    return metrics.in_progress(Tables(spark, sf_dir).events)


_HOURS = "h AS (SELECT DISTINCT coalesce(event_type, 'unknown') AS kind, (ts::DATE - DATE '1970-01-01') * 24 + hour(ts) AS h FROM events WHERE ts IS NOT NULL)"


@query(f"""WITH {_HOURS}, t AS (SELECT DISTINCT kind, h + i AS h FROM h, range(6) r(i)), g AS (SELECT *, h - row_number() OVER (PARTITION BY kind ORDER BY h) AS k FROM t)
SELECT kind, min(h) AS pending, min(h) + 12 AS fires, max(h) + 1 AS resolved FROM g GROUP BY kind, k HAVING max(h) - min(h) >= 12""")
def raised_alerts(spark, sf_dir):
    return metrics.raised(Tables(spark, sf_dir).events, window=6, hold=12)


@query(f"""WITH {_HOURS.replace("ts IS NOT NULL", "ts IS NOT NULL AND value > 20")}, n AS (SELECT *, lead(h) OVER (PARTITION BY kind ORDER BY h) AS resolved FROM h)
SELECT kind, h + 1 AS pending, h + 2 AS fires, resolved FROM n WHERE resolved - h > 1""")
def silence_alerts(spark, sf_dir):
    """Hours without a slow event of a kind, between two such events."""
    return metrics.silent(Tables(spark, sf_dir).events.where("value > 20"), hold=1)
