"""Queries in depth: quantiles of groups, contexts of all rows, carried values, footers and join statistics.

They register in the same catalog, each with the DuckDB statement that must agree.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sequences
from tidemark.plans.catalog import DAILY, PANEL, QUANTILES, QUERIES, STORE, Tables, daily, panel, query, store_day
from tidemark.sources import digests, footers
from tidemark.streaming import metrics

# quantiles of groups


_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'missing' WHEN l_returnflag = 'A' THEN 'true' ELSE 'false' END"


@query(f"""SELECT status, q, round(v, 6) AS value FROM (SELECT status, unnest({QUANTILES})::DOUBLE AS q, unnest(quantile_cont(p, {QUANTILES})) AS v FROM (SELECT {_STATUS} AS status, l_extendedprice AS p FROM lineitem) GROUP BY status)""")
def status_quantiles(spark, sf_dir):
    """Nine exact quantiles of each status, of which no task holds all rows."""
    status = F.when(F.col("l_returnflag") == "R", "missing").when(F.col("l_returnflag") == "A", "true").otherwise("false")
    rows = Tables(spark, sf_dir).lineitem.select(status.alias("status"), "l_extendedprice")
    return agg.quantiles(rows, "l_extendedprice", QUANTILES, ["status"]).select("status", "q", F.round("value", 6).alias("value"))


@query(f"""SELECT status, n, round(quantile_cont(p, 0.25), 6) AS q1, round(quantile_cont(p, 0.5), 6) AS q2, round(quantile_cont(p, 0.75), 6) AS q3 FROM (SELECT {_STATUS} AS status, l_extendedprice AS p, count(*) OVER (PARTITION BY {_STATUS}) AS n FROM lineitem WHERE l_orderkey % 100 = 0) GROUP BY ALL""")
def sampled_quantiles(spark, sf_dir):
    """Quartiles of each status over the sampling operator's one row in a hundred, by key."""
    status = F.when(F.col("l_returnflag") == "R", "missing").when(F.col("l_returnflag") == "A", "true").otherwise("false")
    rows = Tables(spark, sf_dir).lineitem.where(F.pmod("l_orderkey", F.lit(100)) == 0).select(status.alias("status"), "l_extendedprice")
    wide = agg.quantiles(rows, "l_extendedprice", [0.25, 0.5, 0.75], ["status"])
    wide = wide.groupBy("status").agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(f"q{i + 1}") for i, q in enumerate((0.25, 0.5, 0.75))))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(wide, "status")


@query("""SELECT l_returnflag, count(*) AS n, round(greatest((sum(x * x) - sum(x) ** 2 / count(*)) / (count(*) - 1), 0), 4) AS variance, round(sqrt(greatest((sum(x * x) - sum(x) ** 2 / count(*)) / (count(*) - 1), 0)), 4) AS deviation FROM (SELECT l_returnflag, l_quantity::DOUBLE AS x FROM lineitem) GROUP BY ALL""")
def variance_by_sums(spark, sf_dir):
    """Sample variance by count, sum and sum of squares, as partial results add it up."""
    x = F.col("l_quantity").cast("double")
    sums = Tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    v = agg.variance_from_sums(F.col("n"), F.col("s"), F.col("ss"))
    return sums.select("l_returnflag", "n", F.round(v, 4).alias("variance"), F.round(F.sqrt(v), 4).alias("deviation"))


# contexts and carried values


@query(f"""WITH {PANEL} SELECT day, store, item, count(*) OVER w AS n_days, round(avg(sales) OVER (p RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS before_mean, round(avg(sales) OVER (p RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING), 6) AS after_mean
FROM panel WINDOW p AS (PARTITION BY store, item ORDER BY day), w AS (PARTITION BY store, item ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING)""")
def context_of_all(spark, sf_dir):
    """Every row as a case, with the days around it: an interval join of the whole panel with itself."""
    facts, keys = panel(Tables(spark, sf_dir)), ["store", "item"]
    cases = facts.select(F.struct("day", *keys).alias("case_id"), "day", *keys)
    near, d = joins.around(cases, facts, keys, "day"), F.col("relative_day")
    side = lambda c: F.round(F.avg(F.when(c, F.col("sales"))), 6)
    return near.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_days"), side(d < 0).alias("before_mean"), side(d > 0).alias("after_mean")).select("case_id.*", "n_days", "before_mean", "after_mean")


@query(f"""WITH {PANEL}, {STORE}, c AS (SELECT DISTINCT store, day FROM panel WHERE sales > 40)
SELECT c.store, c.day, (s.day - c.day)::INT AS relative_day, s.visits, round(s.visits / avg(s.visits) OVER (PARTITION BY c.store, c.day), 6) AS share FROM c JOIN store_day s ON s.store = c.store AND s.day BETWEEN c.day - 7 AND c.day + 7""")
def store_day_context(spark, sf_dir):
    """What stores did in the fortnight around each of their days with a large sale."""
    t = Tables(spark, sf_dir)
    days = panel(t).where("sales > 40").select("store", "day").distinct()
    near = joins.around(days.withColumn("case_id", F.struct("store", "day")), store_day(t), ["store"], "day")
    share = F.col("visits") / F.avg("visits").over(Window.partitionBy("case_id"))  # fifteen rows a case
    return near.select("store", F.col("case_id.day").alias("day"), "relative_day", "visits", F.round(share, 6).alias("share"))


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, CASE WHEN isodow(o_orderdate) < 6 THEN sum(round(o_totalprice * 100)::BIGINT)::BIGINT END AS cents FROM orders GROUP BY o_orderdate::DATE, isodow(o_orderdate)), k AS (SELECT * FROM d WHERE cents IS NOT NULL), g AS (SELECT day FROM d WHERE cents IS NULL)
SELECT g.day, p.cents AS previous, p.day AS previous_day, n.cents AS "next", n.day AS next_day FROM g ASOF LEFT JOIN k p ON g.day > p.day ASOF LEFT JOIN k n ON g.day < n.day""")
def gap_neighbours(spark, sf_dir):
    """For every day without a total the nearest known ones before and after it, however far."""
    day = F.to_date("o_orderdate")
    totals = Tables(spark, sf_dir).orders.groupBy(day.alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("t"))
    rows = totals.select("day", F.when(~cal.is_weekend(F.col("day")), F.col("t")).alias("cents"))
    return sequences.nearest_known(rows, [], "day", "cents").where("cents is null").drop("cents")


@query(f"""WITH {PANEL}, k AS (SELECT * FROM panel WHERE sales > 30)
SELECT x.store, x.item, x.day, p.sales AS previous, (x.day - p.day)::INT AS days_since, (n.day - x.day)::INT AS days_until FROM panel x ASOF LEFT JOIN k p ON p.store = x.store AND p.item = x.item AND x.day > p.day ASOF LEFT JOIN k n ON n.store = x.store AND n.item = x.item AND x.day < n.day""")
def last_large_sale(spark, sf_dir):
    """For every day of every series the large sale before it, how long ago, and how long until the next."""
    rows = panel(Tables(spark, sf_dir)).withColumn("large", F.when(F.col("sales") > 30, F.col("sales")))
    near = sequences.nearest_known(rows, ["store", "item"], "day", "large")
    return near.select("store", "item", "day", "previous", F.datediff("day", "previous_day").alias("days_since"), F.datediff("next_day", "day").alias("days_until"))


# joins


@query("""WITH x AS (SELECT p_partkey AS a, s_suppkey AS b, o_orderkey AS c, c_custkey AS d FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
y AS (SELECT 'part' AS source, count(*) AS n_rows, count(a) AS n_matched FROM x UNION ALL SELECT 'supplier', count(*), count(b) FROM x UNION ALL SELECT 'order', count(*), count(c) FROM x UNION ALL SELECT 'customer', count(*), count(d) FROM x)
SELECT *, n_rows - n_matched AS n_unmatched, round(100.0 * n_matched / n_rows, 6) AS pct_matched FROM y""")
def join_statistics(spark, sf_dir):
    """Rows that each source of a star matches, counted in the query that joins them and checks their keys."""
    t = Tables(spark, sf_dir)
    out = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey")
    out = joins.many_to_one(out, t.part.select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"], matched="part")
    out = joins.many_to_one(out, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"], matched="supplier")
    out = joins.many_to_one(out, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"], matched="order")
    out = joins.many_to_one(out, t.customer.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], matched="customer")
    return joins.match_statistics(out, {s: s for s in ("part", "supplier", "order", "customer")})


@query("""WITH j AS (SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT (SELECT count(*) FROM lineitem) AS n_base, (SELECT count(*) FROM j) AS n_joined, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))::BIGINT AS base_duplicates, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM j GROUP BY l_orderkey, l_linenumber))::BIGINT AS joined_duplicates)
SELECT *, n_base = n_joined AND base_duplicates = joined_duplicates AS kept FROM f""")
def grain_after_join(spark, sf_dir):
    """Rows and duplicates of the grain, before and after a join that must change neither."""
    t = Tables(spark, sf_dir)
    base = t.lineitem.select("l_orderkey", "l_linenumber")
    joined = joins.many_to_one(base, t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"])
    return joins.kept_grain(base, joined, ["l_orderkey", "l_linenumber"])


# sources


@query("""WITH e AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem, e WHERE l_orderkey BETWEEN a + (b - a) // 4 AND a + (b - a) // 2 GROUP BY ALL""")
def row_group_scan(spark, sf_dir):
    """A range of the second quarter of keys: bounds from footers, and a scan of the row groups that can hold it."""
    path = f"{sf_dir}/lineitem.parquet"
    zones = footers.footers(spark, path)
    ends = zones.where("column = 'l_orderkey'").agg(F.min(F.col("least").cast("long")).alias("a"), F.max(F.col("most").cast("long")).alias("b")).first()
    low, high = ends["a"] + (ends["b"] - ends["a"]) // 4, ends["a"] + (ends["b"] - ends["a"]) // 2
    groups = footers.kept_groups(zones, "l_orderkey", "long", low, high).where("kept")
    rows = footers.scan(groups, spark.read.parquet(path), ["l_orderkey", "l_returnflag", "l_quantity"])
    return rows.where(F.col("l_orderkey").between(low, high)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def source_digests(spark, sf_dir):
    """SHA-256 of the files of two tables, by ranges; SQL cannot see files, so tests compare with hashlib."""
    found = digests.digests(spark, f"{sf_dir}/lineitem.parquet").unionByName(digests.digests(spark, f"{sf_dir}/orders.parquet"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "n_ranges", "digest")


QUERIES["source_digests"] = source_digests


# rules, buckets, scopes, movements


@query("""WITH x AS (SELECT 'discounted return' AS rule, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_tax <> 0 UNION ALL SELECT 'large', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_linestatus <> 'F')
SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY l_orderkey, l_linenumber)::INT AS place, l_orderkey, l_linenumber FROM x QUALIFY place <= 5""")
def rule_examples(spark, sf_dir):
    """The first five rows that each rule marks and nothing explains."""
    rules = {"discounted return": ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), F.col("l_tax") == 0), "large": (F.col("l_quantity") > 45, F.col("l_linestatus") == "F")}
    return agg.rule_examples(Tables(spark, sf_dir).lineitem, rules, ["l_orderkey", "l_linenumber"])


@query("""SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v < 0 THEN 'negative' WHEN v = 0 THEN 'zero' WHEN v <= 10 THEN 'to 10' WHEN v <= 100 THEN 'to 100' ELSE 'above 100' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS v FROM customer) GROUP BY ALL""")
def covered_buckets(spark, sf_dir):
    """Magnitudes of balances, with a check that every row is in one bucket."""
    rows = Tables(spark, sf_dir).customer.select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("v"))
    return agg.covered(rows.groupBy(cal.magnitude(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "n", rows)


@query("""WITH p AS (SELECT n_nationkey AS place, r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey), v AS (SELECT place, unnest([{'l': 'all', 's': 'all'}, {'l': 'region', 's': region}, {'l': 'nation', 's': nation}]) AS u FROM p),
w AS (SELECT place, u.l AS level, u.s AS scope FROM v), f AS (SELECT DISTINCT o_orderdate::DATE AS day, c_nationkey AS place FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT day, level, scope, count(DISTINCT place) AS represented, any_value(n) AS expected, count(DISTINCT place) = any_value(n) AS consistent FROM f JOIN w USING (place) JOIN (SELECT level, scope, count(*) AS n FROM w GROUP BY ALL) USING (level, scope) GROUP BY day, level, scope""")
def scope_levels(spark, sf_dir):
    """Places represented against places there are: by date, by date and region, by date and nation."""
    t = Tables(spark, sf_dir)
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").alias("place"))
    return agg.scope_levels(facts, places, "day", "place", ["region", "nation"])


@query(f"""WITH {PANEL}, m AS (SELECT item, strftime(day, '%Y-%m') AS month, sum(sales) AS s FROM panel GROUP BY ALL), x AS (SELECT item, month, s, s - lag(s) OVER (PARTITION BY item ORDER BY month) AS c FROM m)
SELECT * FROM (SELECT 'up' AS direction, item, month, s AS sales, c AS change FROM x WHERE c IS NOT NULL ORDER BY c DESC, item, month LIMIT 10) UNION ALL (SELECT 'down', item, month, s, c FROM x WHERE c IS NOT NULL ORDER BY c, item, month LIMIT 10)""")
def monthly_extremes(spark, sf_dir):
    """The ten largest movements up and the ten largest down."""
    months = panel(Tables(spark, sf_dir)).groupBy("item", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("sales").alias("sales"))
    rows = months.withColumn("change", F.col("sales") - F.lag("sales").over(Window.partitionBy("item").orderBy("month")))
    ends = {"up": sequences.largest(rows, "change", 10, ["item", "month"]), "down": sequences.smallest(rows, "change", 10, ["item", "month"])}
    up, down = (df.select(F.lit(k).alias("direction"), *rows.columns) for k, df in ends.items())
    return up.unionByName(down)


@query(f"""WITH {DAILY}, x AS (SELECT a.day, a.sales AS y, coalesce(b.sales, c.sales) AS f, CASE WHEN b.day IS NOT NULL THEN 'year' WHEN c.day IS NOT NULL THEN 'week' END AS basis FROM daily a LEFT JOIN daily b ON b.day = a.day - 364 LEFT JOIN daily c ON c.day = a.day - 7)
SELECT basis, count(*) AS n, round(avg(abs(y - f)), 6) AS mae, round(avg(f - y), 6) AS bias FROM x WHERE basis IS NOT NULL GROUP BY ALL""")
def comparable_period_errors(spark, sf_dir):
    """A baseline of the last comparable period: the same weekday a year before, or else a week before."""
    rows = joins.exact_offset(daily(Tables(spark, sf_dir)), [], "day", "sales", [7, 364])
    basis = F.when(F.col("lag_364").isNotNull(), "year").when(F.col("lag_7").isNotNull(), "week")
    x = rows.select(basis.alias("basis"), "sales", F.coalesce("lag_364", "lag_7").alias("f")).where("basis is not null")
    return x.groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("sales") - F.col("f"))), 6).alias("mae"), F.round(F.avg(F.col("f") - F.col("sales")), 6).alias("bias"))


# service metrics


_LE = ", ".join(f"({i}, {b}::DOUBLE, {metrics.BUCKETS[i - 1] if i else 0.0}::DOUBLE)" for i, b in enumerate(metrics.BUCKETS))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, coalesce(event_type, 'unknown') AS kind, value FROM events WHERE ts IS NOT NULL), h AS (SELECT start, kind, i, le, lo, count(*) FILTER (value <= le) AS c, count(value) AS n FROM w, (VALUES {_LE}) b(i, le, lo) GROUP BY ALL),
x AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY start, kind ORDER BY i), 0) AS b FROM h)
SELECT start, kind, any_value(n) AS n, CASE WHEN any_value(n) > 0 THEN round(coalesce(min(CASE WHEN c >= 0.9 * n AND b < 0.9 * n THEN lo + (le - lo) * (0.9 * n - b) / (c - b) END), {metrics.BUCKETS[-1]}), 6) END AS quantile FROM x GROUP BY start, kind""")
def hourly_quantiles(spark, sf_dir):
    """The ninth decile of every hour and kind, from a histogram; the same plan runs on a stream."""
    return metrics.windowed_quantile(Tables(spark, sf_dir).events.where("ts is not null"), 0.9)


@query("""WITH h AS (SELECT DISTINCT coalesce(event_type, 'unknown') AS kind, epoch_us(ts) // 60000000 AS h FROM events WHERE ts IS NOT NULL AND value > 20), t AS (SELECT DISTINCT kind, h + i AS h FROM h, range(5) r(i)), g AS (SELECT *, h - row_number() OVER (PARTITION BY kind ORDER BY h) AS k FROM t),
r AS (SELECT kind, min(h) AS p, max(h) AS l FROM g GROUP BY kind, k)
SELECT kind, 'pending' AS state, p AS at FROM r UNION ALL SELECT kind, 'firing', p + 5 FROM r WHERE l - p >= 5 UNION ALL SELECT kind, CASE WHEN l - p >= 5 THEN 'resolved' ELSE 'dismissed' END, l + 1 FROM r""")
def slow_event_alerts(spark, sf_dir):
    """By the minute: slow events within five minutes, for more than five minutes; every change of state."""
    return metrics.raised_states(Tables(spark, sf_dir).events.where("value > 20"), window=5, hold=5)


@query("""WITH h AS (SELECT DISTINCT coalesce(event_type, 'unknown') AS kind, epoch_us(ts) // 60000000 AS h FROM events WHERE ts IS NOT NULL), n AS (SELECT *, lead(h) OVER (PARTITION BY kind ORDER BY h) AS r FROM h QUALIFY r - h > 2)
SELECT kind, 'pending' AS state, h + 1 AS at FROM n UNION ALL SELECT kind, 'firing', h + 3 FROM n UNION ALL SELECT kind, 'resolved', r FROM n""")
def down_alerts(spark, sf_dir):
    """By the minute: kinds without an event for two minutes; every change of state."""
    return metrics.silent_states(Tables(spark, sf_dir).events, hold=2)
