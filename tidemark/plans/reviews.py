"""Further queries over the driver's tables: the model table, structural reviews, reshapes and rates.

They register in the same catalog, each with the DuckDB statement that must agree.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sequences
from tidemark.plans import catalog, features, folds
from tidemark.plans.catalog import DAILY, PANEL, PRICE, Tables, daily, panel, price, query
from tidemark.sources import files, footers
from tidemark.streaming import metrics

_ORIGINS = [date(1996, 9, 30), date(1997, 3, 31), date(1998, 6, 30)]
_EVENTS = [("1996-10-01", "Holiday", "National", "all", "Founding day", False), ("1997-04-02", "Event", "National", "all", "Terremoto Manabi", False), ("1997-04-05", "Holiday", "Regional", "R1", "Spring fair", False), ("1997-04-05", "Holiday", "Local", "T1", "Town day", True), ("1998-07-04", "Work Day", "Regional", "R2", "Bridge", False), ("1998-07-10", "Holiday", "Local", "T2", " ", False)]
_EVENT_ROWS = ", ".join(f"(DATE '{d}', '{k}', '{s}', '{n}', '{o}', {m})" for d, k, s, n, o, m in _EVENTS)
_BASE = f"""ev(day, kind, scope, scope_name, note, moved) AS (VALUES {_EVENT_ROWS}),
pl(place, region, town) AS (VALUES (1, 'R1', 'T1'), (2, 'R2', 'T2')),
hol AS (SELECT day, place, bool_or(NOT moved AND kind <> 'Work Day') AS is_holiday, string_agg(DISTINCT kind, ' | ' ORDER BY kind) AS holiday_type, string_agg(DISTINCT scope, ' | ' ORDER BY scope) AS holiday_locale,
    string_agg(DISTINCT note, ' | ' ORDER BY note) FILTER (trim(note) <> '') AS holiday_description, bool_or(moved) AS holiday_transferred, count(*) AS holiday_event_count
    FROM ev JOIN pl ON scope = 'National' OR (scope = 'Regional' AND scope_name = region) OR (scope = 'Local' AND scope_name = town) GROUP BY ALL),
sale AS (SELECT l_shipdate::DATE AS date, n_regionkey % 2 + 1 AS store_nbr, p_size % 3 + 1 AS item_nbr, sum(l_quantity) AS unit_sales, CASE WHEN l_shipdate::DATE < DATE '1997-01-01' THEN NULL ELSE bool_or(l_discount >= 0.05) END AS onpromotion
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY l_shipdate::DATE, n_regionkey % 2 + 1, p_size % 3 + 1),
visit AS (SELECT o_orderdate::DATE AS date, n_regionkey % 2 + 1 AS store_nbr, count(*) AS transactions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
{PRICE},
base AS (SELECT sale.*, 'F' || item_nbr AS family, item_nbr * 7 AS class, item_nbr % 2 AS perishable, 'C' || store_nbr AS city, 'S' || store_nbr AS state, CASE WHEN date < DATE '1997-04-05' THEN 'A' ELSE 'B' END AS store_type, year(date) % 5 AS cluster,
    transactions, price AS dcoilwtico, is_holiday, holiday_type, holiday_locale, holiday_description, holiday_transferred, holiday_event_count
    FROM sale LEFT JOIN visit USING (date, store_nbr) LEFT JOIN price ON price.day = date LEFT JOIN hol ON hol.day = date AND place = store_nbr)"""


def feature_base(t: Tables):
    """A base table of all columns that the model table is made from."""
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), (F.col("n_regionkey") % 2 + 1).alias("store_nbr"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3 + 1).alias("item_nbr"))
    day = F.to_date("l_shipdate").alias("date")
    sale = t.lineitem.select("l_suppkey", "l_partkey", day, "l_quantity", "l_discount").join(place, "l_suppkey").join(part, "l_partkey").groupBy("date", "store_nbr", "item_nbr").agg(F.sum("l_quantity").alias("unit_sales"), F.bool_or(F.col("l_discount") >= 0.05).alias("promo"))
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), (F.col("n_regionkey") % 2 + 1).alias("store_nbr"))
    visit = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("date")).join(home, "o_custkey").groupBy("date", "store_nbr").agg(F.count(F.lit(1)).alias("transactions"))
    events = t.spark.createDataFrame([(date.fromisoformat(d), *rest) for d, *rest in _EVENTS], "day date, kind string, scope string, scope_name string, note string, moved boolean")
    places = t.spark.createDataFrame([(1, "R1", "T1"), (2, "R2", "T2")], "place int, region string, town string")
    holiday = joins.scope_expand(events, places).select(F.col("day").alias("date"), F.col("place").alias("store_nbr"), "is_holiday", F.col("kinds").alias("holiday_type"), F.col("scopes").alias("holiday_locale"), F.col("notes").alias("holiday_description"), F.col("any_moved").alias("holiday_transferred"), F.col("n_events").alias("holiday_event_count"))
    out = sale.join(visit, ["date", "store_nbr"], "left").join(price(t).select(F.col("day").alias("date"), F.col("price").alias("dcoilwtico")), "date", "left").join(holiday, ["date", "store_nbr"], "left")
    item, store = F.col("item_nbr"), F.col("store_nbr")
    return out.withColumns(
        {
            "onpromotion": F.when(F.col("date") >= F.lit(date(1997, 1, 1)), F.col("promo")),
            "family": F.concat(F.lit("F"), item.cast("string")),
            "class": item * 7,
            "perishable": item % 2,
            "city": F.concat(F.lit("C"), store.cast("string")),
            "state": F.concat(F.lit("S"), store.cast("string")),
            "store_type": F.when(F.col("date") < F.lit(date(1997, 4, 5)), "A").otherwise("B"),
            "cluster": F.year("date") % 5,
        }
    ).drop("promo")


def _model_sql() -> str:
    dates = ", ".join(f"DATE '{o}'" for o in _ORIGINS)
    lags = ", ".join(f"max(unit_sales) FILTER (off = -{k}) AS sales_lag_{k}" for k in features.LAGS)
    rolled = ", ".join(f"CASE WHEN count(*) FILTER (off BETWEEN -{w} AND -1) = {w} THEN round({f}(unit_sales) FILTER (off BETWEEN -{w} AND -1), 6) END AS sales_rolling_{n}_{w}" for f, n, ws in (("avg", "mean", features.MEANS), ("stddev_samp", "std", features.STDS)) for w in ws)
    static = ", ".join(f"arg_max({c}, date) FILTER (off <= 0) AS {c}" for c in features.STATIC)
    return f"""WITH {_BASE}, x AS (SELECT base.*, origin, (date - origin)::BIGINT AS off FROM base, (SELECT unnest([{dates}]) AS origin) WHERE date BETWEEN origin - 28 AND origin + 16),
    h AS (SELECT origin, store_nbr, item_nbr, {lags}, {rolled}, {static} FROM x GROUP BY ALL),
    sd AS (SELECT DISTINCT origin, off, store_nbr, transactions AS v FROM x WHERE off <= 0),
    st AS (SELECT origin, store_nbr, max(v) FILTER (off = 0)::DOUBLE AS transactions_at_origin, max(v) FILTER (off = -7)::DOUBLE AS transactions_lag_7, max(v) FILTER (off = -14)::DOUBLE AS transactions_lag_14,
        CASE WHEN count(v) FILTER (off >= -6) = 7 THEN round(avg(v) FILTER (off >= -6), 6) END AS transactions_mean_7d, CASE WHEN count(v) FILTER (off >= -13) = 14 THEN round(avg(v) FILTER (off >= -13), 6) END AS transactions_mean_14d FROM sd GROUP BY ALL),
    pd AS (SELECT DISTINCT origin, off, dcoilwtico AS p FROM x WHERE off <= 0),
    pe AS (SELECT origin, max(p) FILTER (off = 0) AS p0, max(p) FILTER (off = -1) AS p1, max(p) FILTER (off = -7) AS p7 FROM pd GROUP BY ALL),
    ps AS (SELECT origin, off, p, lag(p) OVER (PARTITION BY origin ORDER BY off) AS b FROM pd WHERE off >= -6 AND p IS NOT NULL),
    pr AS (SELECT origin, CASE WHEN count(*) >= 2 THEN arg_max(p, off) / nullif(arg_min(p, off), 0) - 1 END AS c, CASE WHEN count(*) >= 3 AND count(*) FILTER (b = 0) = 0 THEN stddev_samp(p / nullif(b, 0) - 1) END AS v FROM ps GROUP BY ALL)
    SELECT origin::TIMESTAMP AS forecast_origin, date::TIMESTAMP AS forecast_date, off::TINYINT AS forecast_horizon, store_nbr::SMALLINT AS store_nbr, item_nbr, h.family, h.class::SMALLINT AS class, h.perishable::TINYINT AS perishable, h.city, h.state, h.store_type, h.cluster::TINYINT AS cluster, unit_sales,
        {", ".join(features.SALES)}, (isodow(date) - 1)::TINYINT AS day_of_week, day(date)::TINYINT AS day_of_month, week(date)::TINYINT AS week_of_year, month(date)::TINYINT AS month, quarter(date)::TINYINT AS quarter, isodow(date) >= 6 AS is_weekend,
        onpromotion, {", ".join(features.STORE_DAY)}, round(p0 / nullif(p1, 0) - 1, 6) AS oil_pct_change_1d, round(p0 / nullif(p7, 0) - 1, 6) AS oil_pct_change_7d, round(c, 6) AS oil_rolling_change_7d, round(v, 6) AS oil_rolling_volatility_7d,
        {", ".join(f"CASE WHEN NOT coalesce(regexp_matches(holiday_description, 'terremoto|earthquake|manabi', 'i'), false) THEN {k} END{'::SMALLINT' if k.endswith('count') else ''} AS {k}" for k in features.HOLIDAY)}
    FROM x JOIN h USING (origin, store_nbr, item_nbr) LEFT JOIN st USING (origin, store_nbr) LEFT JOIN pe USING (origin) LEFT JOIN pr USING (origin) WHERE off > 0"""


@query(_model_sql())
def model_table(spark, sf_dir):
    """The feature table of 43 columns, with promotion and holidays taken as known ahead."""
    out = features.model_table(feature_base(Tables(spark, sf_dir)), _ORIGINS, planned_promotion=True, published_holidays=True)
    rounded = [*(c for c in features.SALES if "rolling" in c), "transactions_mean_7d", "transactions_mean_14d", *features.OIL]
    return out.select(*(F.round(c, 6).alias(c) if c in rounded else c for c in features.TRAINING))


@query(f"""WITH {_BASE} SELECT origin::DATE AS origin, count(*) AS expected, count(DISTINCT (store_nbr, item_nbr)) AS series FROM base, (SELECT unnest([{", ".join(f"DATE '{o}'" for o in _ORIGINS)}]) AS origin) WHERE date BETWEEN origin + 1 AND origin + 16 GROUP BY ALL""")
def expected_targets(spark, sf_dir):
    """Observed target rows and series of each origin, counted on the source: what a build has to deliver."""
    rows = features.by_origin(feature_base(Tables(spark, sf_dir)), "date", _ORIGINS).where("off > 0")
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("expected"), F.count_distinct("store_nbr", "item_nbr").alias("series"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({f.number}, DATE '{f.origin}', DATE '{f.origin}' + 1, DATE '{f.origin}' + 16, 16, {str(f is folds.HOLDOUT).lower()})" for f in [*folds.APPROVED, folds.HOLDOUT]) + ") AS t(fold, origin, start, \"end\", days, holdout)")
def approved_folds(spark, sf_dir):
    folds.check_approved()
    return folds.table(spark, folds.APPROVED, folds.HOLDOUT)


# sources


@query("""SELECT column_index::INT - 1 AS position, column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, is_nullable AS nullable FROM duckdb_columns() WHERE table_name = 'orders'""")
def schema_columns(spark, sf_dir):
    """Position, name, type and nullability, by the schema alone."""
    return files.schema_table(Tables(spark, sf_dir).orders)


@query("SELECT 'lineitem' AS name, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'lineitem') AS n_columns UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'orders')")
def footer_facts(spark, sf_dir):
    """Rows and columns by the footers, without reading data."""
    found = [(n, footers.facts(spark, f"{sf_dir}/{n}.parquet")) for n in ("lineitem", "orders")]
    return spark.createDataFrame([(n, f["rows"], f["columns"]) for n, f in found], "name string, n_rows long, n_columns long")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def preview_rows(spark, sf_dir):
    return files.preview(Tables(spark, sf_dir).orders, 7, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT n_region AS region, count(*) AS n, sum(c_acctbal)::DOUBLE AS total, max(day) AS last_day FROM (SELECT n_regionkey AS n_region, round(c_acctbal) AS c_acctbal, DATE '2020-01-01' + (c_custkey % 500)::INT AS day FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL")
def csv_scan(spark, sf_dir):
    """A CSV with a header, read with a declared schema and date form, two of its columns left out."""
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), F.round("c_acctbal").alias("balance"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")), "dd/MM/yyyy").alias("day"))
    path = files.scratch(spark, "csv")
    rows.write.option("header", True).csv(path)
    back = files.read_csv(spark, path, "c_custkey long, region int, balance double, day date", ["region", "balance", "day"], dates="dd/MM/yyyy")
    return back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total"), F.max("day").alias("last_day"))


# projections, conditionals, joins


@query("""SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' ELSE 'over 1' END AS bucket, count(*) AS n, count(*) FILTER (n > 0 AND n < 4) AS n_between FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL""")
def count_buckets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.select("c_custkey").join(n, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy(cal.count_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(cal.within(F.col("n"), 0, 4)).alias("n_between"))


@query("""SELECT status, level, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS level FROM orders) GROUP BY ALL""")
def recodes(spark, sf_dir):
    """A recode that leaves other values, and a dictionary of which a miss is an error."""
    rows = Tables(spark, sf_dir).orders.select(cal.recoded(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "missing").alias("status"), "o_orderpriority")
    rows = joins.looked_up(rows, {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}, "o_orderpriority", "level")
    return rows.groupBy("status", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_type, r_name, c_mktsegment, count(*) AS n, count(o_orderkey) AS n_order, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def five_way_star(spark, sf_dir):
    """Facts with items, places, orders and their customers; every join many to one and counted."""
    t = Tables(spark, sf_dir)
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    facts = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")
    out = joins.many_to_one(facts, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), ["l_partkey"])
    out = joins.many_to_one(out, places.select(F.col("s_suppkey").alias("l_suppkey"), "r_name"), ["l_suppkey"])
    out = joins.many_to_one(out, t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"], matched="ordered")
    out = joins.many_to_one(out, t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"])
    return out.groupBy("p_type", "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if("ordered").alias("n_order"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def checked_attributes(spark, sf_dir):
    """One-to-one attributes; an unmatched key or a null one would be an error."""
    t = Tables(spark, sf_dir)
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    return joins.attributes(t.supplier.select("s_nationkey"), names, ["s_nationkey"]).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 1000 <> 3),
p AS (SELECT o.o_custkey AS a1, c.o_custkey AS b1, o.o_orderstatus AS a2, c.o_orderstatus AS b2, o.o_totalprice AS a3, c.o_totalprice AS b3 FROM orders o JOIN c USING (o_orderkey)), m AS (SELECT count(*) AS lost FROM orders WHERE o_orderkey % 1000 = 3)
SELECT "column", n_pairs, n_differ, lost AS only_source, 0::BIGINT AS only_copy FROM (SELECT 'o_custkey' AS "column", count(*) AS n_pairs, count(*) FILTER (a1 IS DISTINCT FROM b1) AS n_differ FROM p UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (a2 IS DISTINCT FROM b2) FROM p UNION ALL SELECT 'o_totalprice', count(*), count(*) FILTER (a3 IS DISTINCT FROM b3) FROM p), m""")
def copy_comparison(spark, sf_dir):
    """Column by column, a source against a changed copy."""
    a = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    b = a.where(key % 1000 != 3).withColumns({"o_orderstatus": F.when(key % 97 != 0, F.col("o_orderstatus")), "o_totalprice": F.when(key % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return joins.compared(a, b, ["o_orderkey"])


@query(f"""WITH {DAILY}, {PRICE} SELECT n_regionkey AS store, count(*) AS n, round(corr(l_quantity, price), 6) AS r, count(price) AS n_priced FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey LEFT JOIN price ON price.day = l_shipdate::DATE GROUP BY ALL""")
def dated_rows(spark, sf_dir):
    """Every row with what its day says."""
    t = Tables(spark, sf_dir)
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("store"))
    rows = t.lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity").join(place, "l_suppkey").join(price(t), "day", "left")
    return rows.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("l_quantity", "price"), 6).alias("r"), F.count("price").alias("n_priced"))


# aggregates


@query("""SELECT 'exact' AS kind, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag, l_quantity)""")
def repeated_rows(spark, sf_dir):
    return agg.repeated_rows(Tables(spark, sf_dir).lineitem.select("l_partkey", "l_returnflag", "l_quantity")).withColumn("kind", F.lit("exact"))


@query("""SELECT p_type, arg_min(p_name, p_partkey) AS first_name, min(p_partkey) AS first_key FROM part GROUP BY ALL""")
def first_values(spark, sf_dir):
    """The first row of each group in order of its key."""
    rows = sequences.first_rows(Tables(spark, sf_dir).part, ["p_type"], ["p_partkey"], 1)
    return rows.select("p_type", F.col("p_name").alias("first_name"), F.col("p_partkey").alias("first_key"))


@query("""WITH s AS (SELECT l_partkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY ALL), e AS (SELECT max(b) AS z FROM s) SELECT count(*) AS n, count(*) FILTER (a > z - 90) AS new, count(*) FILTER (b < z - 90) AS inactive FROM s, e""")
def activity(spark, sf_dir):
    return agg.activity(Tables(spark, sf_dir).lineitem.select("l_partkey", F.to_date("l_shipdate").alias("day")), "l_partkey", "day")


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag = 'A' END AS flag, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_quantity FROM lineitem), g AS (SELECT coalesce(flag::VARCHAR, 'missing') AS flag, count(*) AS n, count(*) FILTER (discount IS NULL) AS a, count(*) FILTER (tax IS NULL) AS b, count(*) FILTER (l_quantity IS NULL) AS c FROM x GROUP BY ALL)
SELECT flag, 'discount' AS "column", n, a AS n_null FROM g UNION ALL SELECT flag, 'tax', n, b FROM g UNION ALL SELECT flag, 'l_quantity', n, c FROM g""")
def null_matrix(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "A").alias("flag"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"), "l_quantity")
    return agg.null_matrix(rows, "flag", ["discount", "tax", "l_quantity"])


@query("""SELECT 'discounted return' AS rule, count(*) FILTER (h) AS n, count(*) FILTER (h AND l_tax = 0) AS explained, count(*) FILTER (h AND l_tax <> 0) AS unresolved, min(l_orderkey) FILTER (h AND l_tax <> 0) AS example FROM (SELECT *, l_returnflag = 'R' AND l_discount > 0.05 AS h FROM lineitem)
UNION ALL SELECT 'large', count(*) FILTER (h), count(*) FILTER (h AND l_linestatus = 'F'), count(*) FILTER (h AND l_linestatus <> 'F'), min(l_orderkey) FILTER (h AND l_linestatus <> 'F') FROM (SELECT *, l_quantity > 45 AS h FROM lineitem)""")
def rule_report(spark, sf_dir):
    rules = {"discounted return": ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), F.col("l_tax") == 0), "large": (F.col("l_quantity") > 45, F.col("l_linestatus") == "F")}
    return agg.rule_report(Tables(spark, sf_dir).lineitem, rules, "l_orderkey")


@query(f"""WITH {PANEL}, x AS (SELECT store, item, day, sales, day - lag(day) OVER w AS gap, sales - lag(sales) OVER w AS change FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY day))
SELECT store, count(*) AS n, round(avg(change), 6) AS mean, round(median(change), 6) AS median, round(stddev_samp(change), 6) AS std, min(change) AS least, max(change) AS most FROM x WHERE gap = 1 GROUP BY ALL""")
def daily_changes(spark, sf_dir):
    """First differences of value and date; only changes from one day to the next count."""
    rows = sequences.differenced(panel(Tables(spark, sf_dir)), ["store", "item"], "day", "sales").where("gap = 1")
    own = rows.groupBy("store").agg(F.count(F.lit(1)).alias("n"), *(c for c, n in zip(agg.describe("change"), agg.DESCRIBED, strict=True) if n != "median"))
    return agg.with_median(own, rows, ["store"], "change")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier),
x AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both) SELECT *, only_a = 0 AS a_in_b, only_a = 0 AND only_b = 0 AS equal FROM x""")
def key_relation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return agg.key_relation(t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "k"), t.supplier.withColumnRenamed("s_suppkey", "k"), "k")


# sequences


@query(f"""WITH {PANEL}, d AS (SELECT DISTINCT day FROM panel), c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d), g AS (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS k FROM c ANTI JOIN d USING (day)), r AS (SELECT min(day) AS a, count(*) AS n FROM g GROUP BY k)
SELECT count(*) AS gaps, coalesce(max(n), 0) AS longest, coalesce(sum(n), 0)::BIGINT AS days FROM r""")
def global_gaps(spark, sf_dir):
    """Days without any row, as runs of the whole calendar."""
    days = panel(Tables(spark, sf_dir)).select("day").distinct()
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    runs = sequences.islands(spine.join(days, "day", "left_anti"), [], "day")  # days of a calendar
    return runs.agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.max("days"), F.lit(0)).alias("longest"), F.coalesce(F.sum("days"), F.lit(0)).alias("days"))


@query(f"""WITH {PANEL}, c AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day, store, item FROM (SELECT store, item, min(day) AS a, max(day) AS b FROM panel GROUP BY ALL)), g AS (SELECT *, day - row_number() OVER (PARTITION BY store, item ORDER BY day)::INT AS k FROM c ANTI JOIN panel USING (day, store, item)),
r AS (SELECT store, item, k, count(*) AS days FROM g GROUP BY ALL) SELECT store, count(*) AS gaps, round(avg(days), 6) AS mean, round(median(days), 6) AS median, max(days) AS longest FROM r GROUP BY ALL""")
def gap_statistics(spark, sf_dir):
    runs = catalog.missing_runs(spark, sf_dir)
    own = runs.groupBy("store").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.avg("days"), 6).alias("mean"), F.max("days").alias("longest"))
    return agg.with_median(own, runs, ["store"], "days")


@query(f"""WITH {PANEL}, h AS (SELECT store, item, day, day - row_number() OVER (PARTITION BY store, item ORDER BY day)::INT AS k FROM panel WHERE sales > 20), i AS (SELECT store, item, min(day) AS start, max(day) AS "end", count(*) AS days FROM h GROUP BY store, item, k)
SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY store, item ORDER BY days DESC, start) = 1""")
def longest_busy_runs(spark, sf_dir):
    """The longest run of consecutive days on which a condition holds."""
    keys = ["store", "item"]
    return sequences.longest(sequences.islands(panel(Tables(spark, sf_dir)).where("sales > 20"), keys, "day"), keys)


@query(f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY sales DESC, day, item) AS k FROM panel) SELECT store, item, day, sales FROM x WHERE k <= 3""")
def first_rows(spark, sf_dir):
    return sequences.first_rows(panel(Tables(spark, sf_dir)), ["store"], [F.col("sales").desc(), "day", "item"], 3).select("store", "item", "day", "sales")


@query(f"""WITH {PANEL}, m AS (SELECT store, item, strftime(day, '%Y-%m') AS month, sum(sales) AS s FROM panel GROUP BY ALL), x AS (SELECT *, lag(s) OVER (PARTITION BY store, item ORDER BY month) AS p FROM m), d AS (SELECT store, item, count(*) FILTER (sales > a) AS above FROM panel JOIN (SELECT store, item, avg(sales) AS a FROM panel GROUP BY ALL) USING (store, item) GROUP BY ALL)
SELECT store, item, arg_max(s, month) AS latest, arg_max(p, month) AS previous, round((arg_max(s, month) - arg_max(p, month)) / nullif(arg_max(p, month), 0), 6) AS pct, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_samp(s), 6) AS std, min(s) AS least, max(s) AS most, min(month) FILTER (s = g) AS peak, min(month) FILTER (s = l) AS low, any_value(above) AS above_mean
FROM (SELECT *, max(s) OVER (PARTITION BY store, item) AS g, min(s) OVER (PARTITION BY store, item) AS l FROM x) JOIN d USING (store, item) GROUP BY ALL""")
def period_behaviour(spark, sf_dir):
    """Of each series: months summarised, their peak and low, the latest against the one before, and days above the own mean."""
    keys = ["store", "item"]
    rows = panel(Tables(spark, sf_dir))
    months = rows.groupBy(*keys, F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("sales").alias("s"))
    months = months.withColumn("p", F.lag("s").over(Window.partitionBy(*keys).orderBy("month")))
    latest, before = F.max_by("s", "month"), F.max_by("p", "month")
    peak, low = F.min_by("month", F.struct(-F.col("s"), "month")), F.min_by("month", F.struct("s", "month"))
    summary = months.groupBy(*keys).agg(latest.alias("latest"), before.alias("previous"), F.round(cal.relative_change(latest, before), 6).alias("pct"), F.count(F.lit(1)).alias("n"), *agg.describe("s"), peak.alias("peak"), low.alias("low"))
    above = rows.withColumn("a", F.avg("sales").over(Window.partitionBy(*keys))).groupBy(*keys).agg(F.count_if(F.col("sales") > F.col("a")).alias("above_mean"))
    return summary.join(above, keys)


@query(f"""WITH {DAILY}, x AS (SELECT day, sales, sales - lag(sales) OVER (ORDER BY day) AS change FROM daily), m AS (SELECT day AS drop_day FROM x ORDER BY change, day LIMIT 1) SELECT drop_day, day, (day - drop_day)::INT AS relative_day, sales, change FROM x, m WHERE day BETWEEN drop_day - 7 AND drop_day + 7""")
def largest_drop(spark, sf_dir):
    """The day of the largest fall, and the fortnight around it."""
    days = daily(Tables(spark, sf_dir))
    x = days.select("day", "sales", (F.col("sales") - F.lag("sales").over(Window.orderBy("day"))).alias("change"))  # a row per day
    worst = F.broadcast(x.where("change is not null").agg(F.min_by("day", F.struct("change", "day")).alias("drop_day")))
    near = x.crossJoin(worst).where(F.abs(F.datediff("day", "drop_day")) <= 7)
    return near.select("drop_day", "day", F.datediff("day", "drop_day").alias("relative_day"), "sales", "change")


@query("""WITH r AS (SELECT p_partkey, sum(l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY t DESC, p_partkey) AS k FROM r) SELECT p_partkey, t AS total FROM k WHERE k <= 3 OR p_partkey IN (7, 11)""")
def chosen_keys(spark, sf_dir):
    """The largest keys, and those asked for."""
    totals = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("total"))
    return sequences.chosen(totals, "p_partkey", "total", 3, [7, 11])


# calendar and reshaping


@query(f"""WITH {PANEL} SELECT item, monthname(day) AS month, round(avg(sales), 6) AS mean, round(median(sales), 6) AS median, count(*) AS n, round(sum(sales) / sum(sum(sales)) OVER (PARTITION BY item), 6) AS share FROM panel GROUP BY item, monthname(day)""")
def month_profile(spark, sf_dir):
    s = panel(Tables(spark, sf_dir)).groupBy("item", F.date_format("day", "MMMM").alias("month")).agg(F.round(F.avg("sales"), 6).alias("mean"), F.round(F.median("sales"), 6).alias("median"), F.count(F.lit(1)).alias("n"), F.sum("sales").alias("t"))
    return s.withColumn("share", F.round(F.col("t") / F.sum("t").over(Window.partitionBy("item")), 6)).drop("t")


@query(f"""WITH {PRICE}, g AS (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS k FROM price WHERE price IS NULL), r AS (SELECT min(day) AS start, max(day) AS "end" FROM g GROUP BY k), w AS (SELECT start, "end", list_sort(list_distinct(list_transform(generate_series(start, "end", INTERVAL 1 DAY), lambda d: (isodow(d) - 1)::INT))) AS d FROM r)
SELECT array_to_string(d, ',') AS weekdays, list_contains(d, 5) OR list_contains(d, 6) AS has_weekend, len(list_filter(d, lambda x: x < 5)) > 0 AS has_weekday, count(*) AS n FROM w GROUP BY ALL""")
def gap_weekdays(spark, sf_dir):
    """Which weekdays the runs of missing prices touch."""
    runs = sequences.islands(price(Tables(spark, sf_dir)).where("price is null").select("day"), [], "day")  # days of a calendar
    d = runs.select(cal.weekdays_of(F.col("start"), F.col("end")).alias("d"))
    d = d.select(F.array_join("d", ",").alias("weekdays"), F.exists("d", lambda x: x >= 5).alias("has_weekend"), F.exists("d", lambda x: x < 5).alias("has_weekday"))
    return d.groupBy("weekdays", "has_weekend", "has_weekday").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_orderpriority AS p, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'X') AS x FROM orders GROUP BY ALL) SELECT p AS priority, status, round(total, 2) AS total FROM (SELECT p, 'o' AS status, o AS total FROM g UNION ALL SELECT p, 'f', f FROM g UNION ALL SELECT p, 'x', x FROM g) WHERE total IS NOT NULL""")
def melted(spark, sf_dir):
    """Wide to long, nulls dropped."""
    wide = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["O", "F", "X"]).sum("o_totalprice").withColumnsRenamed({"O": "o", "F": "f", "X": "x"})
    return wide.unpivot(["priority"], ["o", "f", "x"], "status", "total").where("total is not null").select("priority", "status", F.round("total", 2).alias("total"))


@query("""SELECT c AS kind, i AS place, coalesce(n, 0) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'refund'), (3, 'error')) v(i, c) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) ON event_type = c""")
def filled_categories(spark, sf_dir):
    """Counts in a given order of categories, 0 for those without rows."""
    counts = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    order = spark.createDataFrame(list(enumerate(["view", "click", "refund", "error"])), "place int, kind string")
    return order.join(counts, "kind", "left").select("kind", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT '#' || p_size AS label, strftime(DATE '1995-01-01' + p_size, '%Y-%m-%d') AS iso, p_size::TINYINT AS small, count(*) AS n FROM part GROUP BY p_size""")
def renderings(spark, sf_dir):
    """ISO dates, labels and a checked cast to a narrow type."""
    sizes = Tables(spark, sf_dir).part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("label"), F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("iso"), features.narrow("p_size", "tinyint").alias("small"), "n")


# periods, forecasts and rates


@query(f"""WITH {DAILY}, n AS (SELECT * FROM (VALUES (DATE '1997-03-05', 'Flood in the valley'), (DATE '1997-03-19', 'flood relief'), (DATE '1997-06-01', 'Fair')) t(day, note)), p AS (SELECT min(day) AS a, max(day) AS b FROM n WHERE contains(lower(note), 'flood')),
x AS (SELECT CASE WHEN day BETWEEN a AND b THEN 'during' WHEN day BETWEEN a - (b - a + 1)::INT AND a - 1 THEN 'before' WHEN day BETWEEN b + 1 AND b + (b - a + 1)::INT THEN 'after' END AS period, sales FROM daily, p), s AS (SELECT period, count(*) AS n_days, avg(sales) AS m, median(sales) AS d FROM x WHERE period IS NOT NULL GROUP BY ALL), r AS (SELECT avg(sales) AS m, median(sales) AS d FROM x WHERE period IN ('before', 'after'))
SELECT period, n_days, round(s.m, 6) AS mean, round(s.d, 6) AS median, round(100 * (s.m - r.m) / r.m, 6) AS mean_change, round(100 * (s.d - r.d) / r.d, 6) AS median_change FROM s, r""")
def discovered_period(spark, sf_dir):
    """The span of the events whose notes name a disaster, against spans of equal length around it."""
    notes = spark.createDataFrame([(date(1997, 3, 5), "Flood in the valley"), (date(1997, 3, 19), "flood relief"), (date(1997, 6, 1), "Fair")], "day date, note string")
    return sequences.against_baseline(daily(Tables(spark, sf_dir)), sequences.span_of(notes, "note", "flood"), "day", "sales")


@query(f"""WITH {PANEL}, x AS (SELECT store, sales AS y, avg(sales) OVER w AS f, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT store, count(*) AS n, round(avg(abs(y - f)), 6) AS mae, round(avg(2 * abs(y - f) / (abs(y) + abs(f))), 6) AS smape, round(avg(f - y), 6) AS bias FROM x WHERE n >= 3 GROUP BY ALL""")
def moving_average_errors(spark, sf_dir):
    """A moving-average baseline of the observed days of the week before, and its errors."""
    week = Window.partitionBy("store", "item").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    rows = panel(Tables(spark, sf_dir)).withColumns({"f": F.avg("sales").over(week), "n": F.count(F.lit(1)).over(week)}).where("n >= 3")
    e = F.abs(F.col("sales") - F.col("f"))
    return rows.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 6).alias("mae"), F.round(F.avg(2 * e / (F.abs("sales") + F.abs("f"))), 6).alias("smape"), F.round(F.avg(F.col("f") - F.col("sales")), 6).alias("bias"))


@query("""WITH s AS (SELECT event_type AS kind, epoch_us(ts) AS t, user_id % 3 AS instance, event_id % 97 AS v FROM events WHERE event_type IS NOT NULL), d AS (SELECT *, lag(v) OVER (PARTITION BY kind, instance ORDER BY t, v) AS p FROM s),
i AS (SELECT kind, t // 300000000 AS slot, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS inc FROM d), g AS (SELECT kind, slot, sum(inc)::BIGINT AS inc FROM i GROUP BY ALL)
SELECT kind, slot::BIGINT AS slot, sum(inc) OVER (PARTITION BY kind ORDER BY slot RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS increase, round(sum(inc) OVER (PARTITION BY kind ORDER BY slot RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) / 900.0, 9) AS rate FROM g""")
def counter_rates(spark, sf_dir):
    """Increase and rate of counters that reset, over a window that slides by five minutes, summed by kind."""
    samples = Tables(spark, sf_dir).events.where("event_type is not null").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("instance"), "ts", (F.col("event_id") % 97).alias("v"))
    return metrics.rates(samples, ["kind"], "instance", "ts", "v", step=300, steps=3)
