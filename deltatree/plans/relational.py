"""Sources, filters, projections, joins, aggregates and ordering."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltatree.functions import scalar as S
from deltatree.functions.periods import (
    Period, last_days, period_labels, previous_columns,
)
from deltatree.operators import decompose as D
from deltatree.operators import quality as Q
from deltatree.operators import values as V
from deltatree.operators.calendar import events_near, in_promotion
from deltatree.plans.calendar import derived_calendar
from deltatree.plans.common import (
    BASE, CURRENT, IN_BASE, IN_CURRENT, IN_WEEK, SLICES, WEEK, cte, lines_cube, margin, orders_cube, query,
    r, retail, span,
)
from deltatree.session import scratch_path
from deltatree.sources import facts as X
from deltatree.sources import tables as T
from deltatree.sources.store import read_results, write_results

BOTH = span(BASE, CURRENT)
IN_BOTH = f"day BETWEEN DATE '{BOTH.start}' AND DATE '{BOTH.end}'"


def lit_day(text: str):
    return F.lit(date.fromisoformat(text))


# --- sources and sinks ------------------------------------------------------

@query("src1_load_facts", f"SELECT day, orders, lines, units, revenue_cents FROM daily WHERE {IN_CURRENT}")
def _(spark, d):
    return orders_cube(spark, d, period=CURRENT, measures=("orders", "lines", "units", "revenue_cents"))


def derived_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the channels and regions in revenue, as a parameter list."""
    cube = orders_cube(spark, d, ("channel", "region"), measures=("revenue_cents",))
    sums = V.slice_sets(cube, [], [("channel",), ("region",)], [F.sum("revenue_cents").cast("double").alias("s")])
    sums = sums.select(
        F.when(F.col("channel").isNotNull(), "channel").otherwise("region").alias("scope"),
        F.coalesce("channel", "region").alias("code"), "s")
    code = F.col("code")
    return Q.normalise(sums, ["scope"], "s", "value").select(
        F.concat(F.col("scope"), F.lit("_weight."), F.regexp_replace(code, " ", "_")).alias("param_key"), "scope",
        F.round("value", 8).alias("value"), F.lit("share").alias("unit"),
        F.when(code.startswith("1"), "estimated").when(code.startswith("A"), "derived").otherwise("official").alias("source_type"),
        F.lit("sales history").alias("source_name"),
        F.when(code == "EUROPE", "").otherwise("https://example.org/weights").alias("source_url"),
        F.when(code == "ASIA", "Jan 1998").otherwise("1998-01-28").alias("captured_on"),
        F.lit("weights").alias("used_for"), F.lit("").alias("note"),
    )


cte("params", """
SELECT 'channel_weight.' || replace(channel, ' ', '_') AS param_key, 'channel' AS scope,
       round(s / SUM(s) OVER (), 8) AS value,
       CASE WHEN channel LIKE '1%' THEN 'estimated' WHEN channel LIKE 'A%' THEN 'derived' ELSE 'official' END AS source_type,
       'https://example.org/weights' AS source_url, '1998-01-28' AS captured_on
FROM (SELECT channel, CAST(SUM(revenue_cents) AS DOUBLE) AS s FROM v GROUP BY 1)
UNION ALL
SELECT 'region_weight.' || replace(region, ' ', '_'), 'region', round(s / SUM(s) OVER (), 8),
       CASE WHEN region LIKE '1%' THEN 'estimated' WHEN region LIKE 'A%' THEN 'derived' ELSE 'official' END,
       CASE WHEN region = 'EUROPE' THEN NULL ELSE 'https://example.org/weights' END,
       CASE WHEN region = 'ASIA' THEN 'Jan 1998' ELSE '1998-01-28' END
FROM (SELECT region, CAST(SUM(revenue_cents) AS DOUBLE) AS s FROM v GROUP BY 1)
""")


@query("src3_load_parameters", "SELECT param_key, scope, value, source_type, source_url FROM params")
def _(spark, d):
    path = T.write_parameters(derived_parameters(spark, d), scratch_path(spark, "parameters"))
    return T.load_parameters(spark, path).select("param_key", "scope", "value", "source_type", "source_url")


@query("src4_load_events", """
SELECT event_id, name, type, start_day, end_day, ev_channel AS channels, ev_region AS regions FROM ev
""")
def _(spark, d):
    path = scratch_path(spark, "events")
    derived_calendar(spark, d).write.json(path)
    return T.load_events(spark, path).select(
        "event_id", "name", "type", "start_day", "end_day",
        F.array_join(F.col("dims")["channel"], ",").alias("channels"),
        F.array_join(F.col("dims")["region"], ",").alias("regions"),
    )


@query("src7_write_results", """
SELECT 'retail' AS scenario, 'run-1' AS run_id, 'contribution' AS kind, slice_id, 'revenue' AS node,
       f.factor, round(f.c, 2) AS contribution
FROM (SELECT slice_id, unnest(['orders', 'basket', 'price_per_unit']) AS factor,
             unnest([c_orders, c_basket, c_price]) AS c FROM yr_lmdi) f
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel", "region"))
    pairs = V.period_values(cube, retail(), YEAR0, YEAR1, ((), ("channel",), ("region",)))
    rows = D.decompose(pairs, retail(), ["slice_id"]).select("slice_id", "node", "factor", "contribution")
    path = scratch_path(spark, "results")
    write_results(rows, path, "retail", "run-1", "contribution", ("slice_id",))
    back = read_results(spark, path, "retail", "run-1", "contribution", "node string, factor string, contribution double")
    return back.withColumn("contribution", r("contribution", 2))


YEAR0, YEAR1 = Period("1997-01-01", "1997-12-31"), Period("1998-01-01", "1998-12-31")

cte("yr", """
SELECT CASE WHEN GROUPING(channel) = 0 THEN 'channel=' || channel
            WHEN GROUPING(region) = 0 THEN 'region=' || region ELSE 'all' END AS slice_id,
       CAST(COUNT(DISTINCT order_id) FILTER (WHERE year(day) = 1997) AS DOUBLE) AS o0,
       CAST(COUNT(DISTINCT order_id) FILTER (WHERE year(day) = 1998) AS DOUBLE) AS o1,
       CAST(SUM(units) FILTER (WHERE year(day) = 1997) AS DOUBLE) AS u0,
       CAST(SUM(units) FILTER (WHERE year(day) = 1998) AS DOUBLE) AS u1,
       CAST(SUM(revenue_cents) FILTER (WHERE year(day) = 1997) AS DOUBLE) AS r0,
       CAST(SUM(revenue_cents) FILTER (WHERE year(day) = 1998) AS DOUBLE) AS r1
FROM v WHERE year(day) IN (1997, 1998) GROUP BY GROUPING SETS ((), (channel), (region))
""")
cte("yr_lmdi", """
SELECT *, lm * ln(o1 / o0) AS c_orders, lm * ln((u1 / o1) / (u0 / o0)) AS c_basket,
       lm * ln((r1 / u1) / (r0 / u0)) AS c_price
FROM (SELECT *, CASE WHEN r1 = r0 THEN r1 ELSE (r1 - r0) / (ln(r1) - ln(r0)) END AS lm FROM yr)
""")


@query("src8_write_fact", """
SELECT strftime(day, '%Y-%m') AS month, COUNT(DISTINCT day) AS n_days,
       CAST(SUM(units) AS BIGINT) AS units, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v WHERE day BETWEEN DATE '1997-06-10' AND DATE '1998-03-20' GROUP BY 1
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), measures=("units", "revenue_cents"))
    path = X.write_fact(cube, scratch_path(spark, "fact"), cluster_by=("channel",))
    fact = X.load_facts(X.open_fact(spark, path), ("day", "units", "revenue_cents"), "1997-06-10", "1998-03-20")
    return fact.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.countDistinct("day").alias("n_days"), F.sum("units").alias("units"),
        F.sum("revenue_cents").alias("revenue_cents"))


# --- filters and projections ------------------------------------------------

@query("flt1_period", f"""
SELECT channel, CAST(SUM(lines) AS BIGINT) AS lines, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM daily_channel WHERE {IN_CURRENT} GROUP BY channel
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), CURRENT, ("lines", "revenue_cents"))
    return cube.groupBy("channel").agg(F.sum("lines").alias("lines"), F.sum("revenue_cents").alias("revenue_cents"))


cte("sliced", """
SELECT * FROM (SELECT *, unnest([
  'all', CASE WHEN channel = '1-URGENT' THEN 'urgent' END,
  CASE WHEN channel IN ('1-URGENT', '2-HIGH') AND region = 'ASIA' THEN 'fast_asia' END,
  CASE WHEN segment = 'AUTOMOBILE' THEN 'cars' END,
  CASE WHEN channel = '5-LOW' AND region IN ('AMERICA', 'EUROPE') THEN 'west_low' END]) AS slice_id FROM v)
WHERE slice_id IS NOT NULL
""")


@query("flt2_slice", """
SELECT slice_id, COUNT(DISTINCT order_id) AS orders, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM sliced GROUP BY slice_id
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel", "region", "segment"), measures=("orders", "revenue_cents"))
    return V.tag_slices(cube, SLICES).groupBy("slice_id").agg(
        F.sum("orders").alias("orders"), F.sum("revenue_cents").alias("revenue_cents"))


@query("flt2_slice_table", """
SELECT slice_id, COUNT(DISTINCT order_id) AS orders, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM (
  SELECT order_id, revenue_cents, 'pair/' || channel || '/' || region AS slice_id FROM v
  UNION ALL SELECT order_id, revenue_cents, 'one/' || channel FROM v
  UNION ALL SELECT order_id, revenue_cents, 'total' FROM v)
GROUP BY slice_id
""")
def _(spark, d):
    """Many slices given as a table: one per pair of codes that occurs, one per channel, one total."""
    cube = orders_cube(spark, d, ("channel", "region"), measures=("orders", "revenue_cents"))
    codes = cube.select("channel", "region").distinct()
    pair = codes.select(
        F.concat_ws("/", F.lit("pair"), "channel", "region").alias("slice_id"),
        F.create_map(F.lit("channel"), F.array("channel"), F.lit("region"), F.array("region")).alias("dims"))
    one = codes.select("channel").distinct().select(
        F.concat_ws("/", F.lit("one"), "channel").alias("slice_id"),
        F.create_map(F.lit("channel"), F.array("channel")).alias("dims"))
    total = spark.createDataFrame([("total", {})], pair.schema)
    slices = pair.unionByName(one).unionByName(total)
    return V.join_slices(cube, slices, ("channel", "region")).groupBy("slice_id").agg(
        F.sum("orders").alias("orders"), F.sum("revenue_cents").alias("revenue_cents"))


@query("flt3_bridge_slice", """
SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1
""")
def _(spark, d):
    """Slice by region although orders carry only a customer: region -> nation -> customer -> order."""
    region = X.table(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nation = X.table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customer = X.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = X.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    per_order = X.order_rows(spark, d, measures=("revenue_cents",))
    kept = per_order.join(orders, F.col("order_id") == F.col("o_orderkey"), "left_semi")
    return kept.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("revenue_cents").alias("revenue_cents"))


@query("flt4_codes", """
SELECT q.code, CAST(n_nationkey AS INT) AS id, CASE WHEN n_nationkey IS NULL THEN 'unknown' ELSE 'known' END AS status
FROM (SELECT DISTINCT 'NATION_' || CAST(n_nationkey + 3 AS VARCHAR) AS code FROM nation JOIN customer ON c_nationkey = n_nationkey) q
LEFT JOIN nation ON n_name = q.code
""")
def _(spark, d):
    nation = X.table(spark, d, "nation")
    used = X.table(spark, d, "customer").select("c_nationkey").distinct()
    requested = used.select(F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 3).cast("string")).alias("code"))
    return X.resolve_codes(requested, nation, "n_name", "n_nationkey")


@query("flt4_refused", """
SELECT 'own ' || channel AS slice_id, 'ok' AS status FROM (SELECT DISTINCT channel FROM v)
UNION ALL SELECT 'lower ' || channel, 'unknown_code' FROM (SELECT DISTINCT channel FROM v)
UNION ALL SELECT 'empty ' || channel, 'empty_codes' FROM (SELECT DISTINCT channel FROM v)
UNION ALL SELECT 'other ' || channel, 'unknown_dimension' FROM (SELECT DISTINCT channel FROM v)
""")
def _(spark, d):
    """Slices asked for as a table: those with an unknown code or dimension, or no code, are refused, not widened or lost."""
    cube = orders_cube(spark, d, ("channel", "region"), measures=("orders",))
    def ask(name, dim, codes):
        return F.struct(F.concat(F.lit(name + " "), "channel").alias("slice_id"), F.create_map(F.lit(dim), codes).alias("dims"))

    none = F.array().cast("array<string>")
    wanted = F.array(ask("own", "channel", F.array("channel")), ask("lower", "channel", F.array("channel", F.concat(F.lower("channel"), F.lit("?")))),
                     ask("empty", "region", none), ask("other", "sku", F.array("channel")))
    slices = cube.select("channel").distinct().select(F.inline(wanted))
    return V.check_slices(slices, cube, ("channel", "region"))


@query("flt5_previous_period", """
SELECT month AS start_day, last_day(month) AS end_day,
       CAST(month - CAST(last_day(month) - month + 1 AS INT) AS DATE) AS previous_start, month - 1 AS previous_end
FROM (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM cal_days)
""")
def _(spark, d):
    months = X.order_heads(spark, d).select(F.trunc("day", "month").alias("start_day")).distinct()
    start, end = previous_columns(F.col("start_day"), F.last_day("start_day"))
    return months.select("start_day", F.last_day("start_day").alias("end_day"),
                         start.alias("previous_start"), end.alias("previous_end"))


@query("flt6_trailing", """
SELECT n, MIN(day) AS start_day, MAX(day) AS end_day, COUNT(*) AS n_days, MAX(day) - (n - 1) AS calendar_start
FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS i FROM cal_days) d
JOIN (SELECT unnest([7, 28, 60, 120]) AS n) k ON d.i <= k.n GROUP BY n
""")
def _(spark, d):
    rows = last_days(X.order_heads(spark, d), (7, 28, 60, 120))
    return rows.withColumn("calendar_start", F.date_sub("end_day", F.col("n") - 1))


@query("flt7_narrow", """
WITH locked AS (
  SELECT segment, list_sort(list(DISTINCT channel)) AS channels FROM v WHERE revenue_cents > 9000000 GROUP BY segment)
SELECT l.segment AS slice_id,
       array_to_string(list_sort(list_intersect(l.channels, ['1-URGENT', '5-LOW'])), ',') AS channels,
       l.segment AS segments, 'ASIA' AS regions,
       CASE WHEN len(list_intersect(l.channels, ['1-URGENT', '5-LOW'])) = 0 THEN 'conflict' ELSE 'ok' END AS status
FROM locked l
UNION ALL
SELECT 'not ' || l.segment, array_to_string(l.channels, ','), '', 'ASIA', 'conflict' FROM locked l
""")
def _(spark, d):
    rows = X.order_heads(spark, d, ("channel", "segment"))
    lines = X.table(spark, d, "lineitem").where(X.cents(F.col("l_extendedprice")) > 9_000_000)
    rows = rows.join(lines, F.col("order_id") == F.col("l_orderkey"), "left_semi")
    locked = rows.groupBy("segment").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    want = F.create_map(F.lit("channel"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")),
                        F.lit("region"), F.array(F.lit("ASIA")))
    clash = F.create_map(F.lit("segment"), F.array(F.lit("none")), F.lit("region"), F.array(F.lit("ASIA")))
    base = F.create_map(F.lit("channel"), F.col("channels"), F.lit("segment"), F.array("segment"))
    both = locked.select(F.explode(F.array(
        F.struct(F.col("segment").alias("slice_id"), base.alias("locked"), want.alias("extra")),
        F.struct(F.concat(F.lit("not "), "segment").alias("slice_id"), base.alias("locked"), clash.alias("extra")),
    )).alias("s")).select("s.*")
    narrowed = Q.narrow_slices(both)
    return narrowed.select(
        "slice_id", F.array_join(F.col("dims")["channel"], ",").alias("channels"),
        F.array_join(F.col("dims")["segment"], ",").alias("segments"),
        F.array_join(F.col("dims")["region"], ",").alias("regions"), "status")


@query("flt8_event_list", """
SELECT event_id, name, type, start_day FROM ev WHERE type = 'promotion' AND start_day >= DATE '1997-01-01' AND end_day <= DATE '1999-12-31'
""")
def _(spark, d):
    events = T.load_events(spark, derived_calendar(spark, d))
    return Q.list_events(events, kind="promotion", start="1997-01-01", end="1999-12-31").select(
        "event_id", "name", "type", "start_day")


cte("return_ratio", """
SELECT day, sku, CAST(SUM(CASE WHEN status = 'R' THEN units END) AS DOUBLE)
       / NULLIF(CAST(SUM(CASE WHEN status = 'A' THEN units ELSE 0 END) AS DOUBLE), 0) AS value
FROM v GROUP BY day, sku
""")


def _return_ratio(spark, d):
    cube = lines_cube(spark, d, ("sku", "status"), measures=("units",))
    value = S.ratio(F.sum(F.when(F.col("status") == "R", F.col("units"))),
                    F.sum(F.when(F.col("status") == "A", F.col("units")).otherwise(0)))
    return cube, value


@query("flt9_drop_null", """
SELECT sku, COUNT(*) AS observed, round(AVG(value), 6) AS mean_value FROM return_ratio WHERE value IS NOT NULL GROUP BY sku
""")
def _(spark, d):
    cube, value = _return_ratio(spark, d)
    return V.daily_series(cube, value, ("sku",)).groupBy("sku").agg(
        F.count("value").alias("observed"), r(F.avg("value")).alias("mean_value"))


@query("flt11_finite_guard", """
SELECT sku, CASE WHEN value IS NULL THEN 'missing' WHEN isnan(value) THEN 'nan' WHEN isinf(value) THEN 'infinite' ELSE 'ok' END AS status,
       COUNT(*) AS n
FROM (SELECT sku, CASE WHEN den = 0 AND num = 0 THEN CAST('NaN' AS DOUBLE) WHEN den = 0 THEN CAST('Infinity' AS DOUBLE) ELSE num / den END AS value
      FROM (SELECT day, sku, CAST(SUM(CASE WHEN status = 'R' THEN units END) AS DOUBLE) AS num,
                   CAST(SUM(CASE WHEN status = 'A' THEN units ELSE 0 END) AS DOUBLE) AS den FROM v GROUP BY day, sku))
GROUP BY 1, 2
""")
def _(spark, d):
    cube = lines_cube(spark, d, ("sku", "status"), measures=("units",))
    sums = cube.groupBy("day", "sku").agg(
        F.sum(F.when(F.col("status") == "R", F.col("units"))).cast("double").alias("num"),
        F.sum(F.when(F.col("status") == "A", F.col("units")).otherwise(0)).cast("double").alias("den"))
    value = (F.when((F.col("den") == 0) & (F.col("num") == 0), F.lit(float("nan")))
             .when(F.col("den") == 0, F.lit(float("inf"))).otherwise(F.try_divide("num", "den")))
    return sums.withColumn("value", value).groupBy("sku", S.finite_status(F.col("value")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prj1_metric_values", f"""
SELECT region, SUM(revenue_cents - discount_cents - tax_cents - material_cents)::DOUBLE AS profit,
       SUM(revenue_cents)::DOUBLE AS revenue, SUM(units)::DOUBLE AS units,
       round(SUM(revenue_cents)::DOUBLE / SUM(units), 6) AS avg_price, SUM(discount_cents)::DOUBLE AS discount_cost,
       round(SUM(discount_cents)::DOUBLE / COUNT(*), 6) AS discount_per_line,
       SUM(material_cents)::DOUBLE AS material_cost, round(SUM(material_cents)::DOUBLE / SUM(units), 6) AS material_per_unit
FROM v GROUP BY region
""")
def _(spark, d):
    wide = V.wide_values(lines_cube(spark, d, ("region",)), margin(), ["region"])
    return wide.select("region", "profit", "revenue", "units", r("avg_price").alias("avg_price"), "discount_cost",
                       r("discount_per_line").alias("discount_per_line"), "material_cost", r("material_per_unit").alias("material_per_unit"))


@query("prj2_unknown_label", """
SELECT COALESCE(n_name, 'unknown') AS nation, COUNT(*) AS orders
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def _(spark, d):
    """Orders by nation; those whose customer or nation is in no dimension table are kept as 'unknown'."""
    partial = X.table(spark, d, "nation")
    orders = X.table(spark, d, "orders").join(
        X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = orders.join(partial, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.coalesce("n_name", F.lit(X.UNKNOWN)).alias("nation")).agg(F.count(F.lit(1)).alias("orders"))


@query("prj3_period_label", f"""
SELECT label, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents FROM daily
JOIN (VALUES ('base', DATE '{BASE.start}', DATE '{BASE.end}'), ('current', DATE '{CURRENT.start}', DATE '{CURRENT.end}'),
             ('winter', DATE '1997-12-21', DATE '1998-03-20'), ('history', DATE '1990-01-01', DATE '2010-12-31')) p(label, s, e)
  ON day BETWEEN s AND e GROUP BY label
""")
def _(spark, d):
    periods = {"base": BASE, "current": CURRENT, "winter": Period("1997-12-21", "1998-03-20"),
               "history": Period("1990-01-01", "2010-12-31")}
    cube = orders_cube(spark, d, measures=("revenue_cents",))
    return cube.withColumn("label", F.explode(period_labels(F.col("day"), periods))).groupBy("label").agg(
        F.sum("revenue_cents").alias("revenue_cents"))


# --- joins ------------------------------------------------------------------

@query("jn1_star", f"""
SELECT channel, region, segment, COUNT(DISTINCT order_id) AS orders, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v GROUP BY 1, 2, 3
""")
def _(spark, d):
    dims = ("channel", "region", "segment")
    return orders_cube(spark, d, dims, measures=("orders", "revenue_cents")).groupBy(*dims).agg(
        F.sum("orders").alias("orders"), F.sum("revenue_cents").alias("revenue_cents"))


@query("jn2_bridge", "SELECT nation, region, CAST(SUM(units) AS BIGINT) AS units FROM v GROUP BY 1, 2")
def _(spark, d):
    return orders_cube(spark, d, ("nation", "region"), measures=("units",)).groupBy("nation", "region").agg(
        F.sum("units").alias("units"))


@query("jn3_proxy", """
SELECT day, round(CAST(SUM(CASE WHEN channel IN ('1-URGENT', '2-HIGH') THEN units ELSE 0 END) AS DOUBLE) / SUM(units), 6) AS paid_share
FROM v GROUP BY day
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), measures=("units",))
    dim = X.order_heads(spark, d, ("channel",)).select("channel").distinct().withColumn(
        "is_paid", F.col("channel").isin("1-URGENT", "2-HIGH"))
    joined = cube.join(dim, "channel", "left")
    share = S.ratio(F.sum(F.when(F.col("is_paid"), F.col("units")).otherwise(0)), F.sum("units"))
    return joined.groupBy("day").agg(r(share).alias("paid_share"))


@query("jn4_outer", f"""
SELECT channel, category, sku, COALESCE(b, 0)::BIGINT AS base, COALESCE(c, 0)::BIGINT AS current,
       CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'vanished' ELSE '' END AS note
FROM (SELECT channel, category, sku,
             SUM(revenue_cents) FILTER (WHERE {IN_BASE}) AS b, SUM(revenue_cents) FILTER (WHERE {IN_CURRENT}) AS c
      FROM v WHERE {IN_BOTH} GROUP BY 1, 2, 3)
""")
def _(spark, d):
    from deltatree.operators.pivot import combination_pairs, exact_contributions

    dims = ("category", "channel", "sku")
    cube = lines_cube(spark, d, dims, BOTH, ("revenue_cents",))
    rows = exact_contributions(combination_pairs(cube, retail().root, [dims], BASE, CURRENT))
    return rows.select("channel", "category", "sku", F.col("base").cast("long").alias("base"),
                       F.col("current").cast("long").alias("current"), "note")


@query("jn5_align", """
SELECT channel, COUNT(*) AS pairs, CAST(SUM(revenue_cents) AS BIGINT) AS target, round(AVG(price), 4) AS mean_price
FROM (SELECT channel, day, revenue_cents FROM daily_channel) a
JOIN (SELECT channel, day, CAST(returned AS DOUBLE) / units AS price FROM
  (SELECT channel, day, SUM(units) FILTER (WHERE status = 'R') AS returned, SUM(units) AS units FROM v GROUP BY 1, 2) WHERE returned IS NOT NULL) b USING (channel, day)
GROUP BY channel
""")
def _(spark, d):
    from deltatree.operators.whatif import align

    cube = lines_cube(spark, d, ("channel", "status"), measures=("units", "revenue_cents"))
    target = V.daily_series(cube, retail().root, ("channel",))
    # the share of returned units, which days without a return don't have
    price = V.daily_series(cube, S.ratio(F.sum(F.when(F.col("status") == "R", F.col("units"))), F.sum("units")), ("channel",))
    return align(target, price, ("channel",)).groupBy("channel").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("y").cast("long").alias("target"), r(F.avg("x"), 4).alias("mean_price"))


@query("jn6_weekly_lags", """
SELECT a.channel, a.day, k, a.day - 7 * k AS lag_day, b.revenue_cents AS lag_value
FROM daily_channel a, (SELECT unnest([1, 2, 3, 4]) AS k) w, daily_channel b
WHERE b.channel = a.channel AND b.day = a.day - 7 * k
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), measures=("revenue_cents",))
    series = V.daily_series(cube, retail().root, ("channel",))
    lags = V.weekly_lags(series.select("channel", "day"), series, ["channel"])
    return lags.select("channel", "day", "k", "lag_day", F.col("lag_value").cast("long").alias("lag_value"))


cte("weeks", """
SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS window_start, CAST(date_trunc('week', day) AS DATE) + 6 AS window_end FROM cal_days
""")


def data_weeks(spark, d):
    weeks = X.order_heads(spark, d).select(F.date_trunc("week", "day").cast("date").alias("window_start")).distinct()
    return weeks.withColumn("window_end", F.date_add("window_start", 6)).withColumn(
        "window_id", F.col("window_start").cast("string"))


@query("jn7_events_near", """
SELECT CAST(window_start AS VARCHAR) AS window_id, event_id,
       CAST(CASE WHEN end_day < window_start THEN window_start - end_day WHEN start_day > window_end THEN start_day - window_end ELSE 0 END AS INT) AS gap
FROM weeks JOIN ev ON start_day <= window_end + 3 AND (end_day IS NULL OR end_day >= window_start - 3)
""")
def _(spark, d):
    events = T.load_events(spark, derived_calendar(spark, d))
    return events_near(data_weeks(spark, d), events, within=3).select("window_id", "event_id", "gap")


PROMOTIONS = [
    # name, first month/day, last month/day, lift; the later ones give way where windows overlap
    ("stocktaking", 2, 10, 2, 20, 1.15),
    ("spring_cleaning", 4, 4, 4, 12, 1.25),
    ("back_to_work", 8, 20, 9, 2, 1.35),
    ("harvest", 10, 5, 10, 9, 1.20),
    ("harvest_rest", 10, 8, 10, 21, 1.05),
    ("turn_of_the_year", 12, 27, 1, 3, 1.50),
]


def in_promotion_sql(day: str) -> str:
    """Whether the month and day of ``day`` lie in a window ``s`` to ``e``, which may reach over the year's end."""
    at = f"(month({day}) * 100 + day({day}))"
    return f"CASE WHEN s <= e THEN {at} BETWEEN s AND e ELSE {at} >= s OR {at} <= e END"


PROMO_SQL = ", ".join(f"({i}, '{n}', {a * 100 + b}, {c * 100 + e}, {lift}::DOUBLE)" for i, (n, a, b, c, e, lift) in enumerate(PROMOTIONS))
cte("promo_days", f"""
SELECT day, arg_min(name, i) AS promo_name, arg_min(lift, i) AS promo_lift
FROM cal_days JOIN (VALUES {PROMO_SQL}) p(i, name, s, e, lift) ON {in_promotion_sql("day")} GROUP BY day
""")


@query("jn8_promo_days", """
SELECT cal_days.day, promo_name IS NOT NULL AS is_promo, promo_name, COALESCE(promo_lift, 1.0) AS promo_lift
FROM cal_days LEFT JOIN promo_days USING (day)
""")
def _(spark, d):
    days = X.order_heads(spark, d).select("day").distinct()
    return in_promotion(days, PROMOTIONS).select("day", "is_promo", "promo_name", "promo_lift")


@query("jn9_semi_anti", """
SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)
            THEN 'inside' ELSE 'outside' END AS side, COUNT(*) AS orders, CAST(SUM(round(o_totalprice * 100)) AS BIGINT) AS total_cents
FROM orders GROUP BY 1
""")
def _(spark, d):
    nation = X.table(spark, d, "nation").where(F.col("n_regionkey") == 2)
    customer = X.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = X.table(spark, d, "orders").select("o_custkey", X.cents(F.col("o_totalprice")).alias("cents"))
    on = F.col("o_custkey") == F.col("c_custkey")
    parts = [
        orders.join(customer, on, how).agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("total_cents"))
        .select(F.lit(side).alias("side"), "orders", "total_cents")
        for side, how in (("inside", "left_semi"), ("outside", "left_anti"))
    ]
    return parts[0].unionByName(parts[1])


@query("jn10_dense_grid", """
SELECT day, COUNT(*) AS cells, COUNT(*) FILTER (WHERE u IS NULL) AS filled, CAST(SUM(COALESCE(u, 0)) AS BIGINT) AS units
FROM (SELECT g.day, g.channel, g.region, g.segment, u FROM
  (SELECT day, channel, region, segment FROM cal_days, (SELECT DISTINCT channel FROM v), (SELECT DISTINCT region FROM v), (SELECT DISTINCT segment FROM v)) g
  LEFT JOIN (SELECT day, channel, region, segment, SUM(units) AS u FROM v GROUP BY 1, 2, 3, 4) f USING (day, channel, region, segment))
GROUP BY day
""")
def _(spark, d):
    dims = ("channel", "region", "segment")
    cube = orders_cube(spark, d, dims, measures=("units",))
    codes = {
        "channel": X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("channel")),
        "region": X.table(spark, d, "region").select(F.col("r_name").alias("region")),
        "segment": X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")),
    }
    return X.densify(cube, codes, X.order_heads(spark, d).select("day"), ["units"]).groupBy("day").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("filled").alias("filled"), F.sum("units").alias("units"))


cte("daily_booked", """
SELECT day, CAST(SUM(CASE WHEN status = 'N' THEN units ELSE 0 END) AS BIGINT) AS paid_units,
       CAST(SUM(CASE WHEN status = 'R' THEN revenue_cents ELSE 0 END) AS BIGINT) AS refund_cents
FROM v GROUP BY day
""")


@query("jn11_reconcile", """
SELECT COALESCE(a.day, b.day) AS day, a.c AS order_cents, b.c AS line_cents,
       CASE WHEN a.day IS NULL THEN 'daily_missing' WHEN b.day IS NULL THEN 'detail_missing' WHEN a.c = b.c THEN 'equal' ELSE 'mismatch' END AS status
FROM (SELECT CAST(o_orderdate AS DATE) AS day, CAST(SUM(round(o_totalprice * 100)) AS BIGINT) AS c FROM orders GROUP BY 1) a
FULL JOIN (SELECT day, CAST(SUM(revenue_cents) AS BIGINT) AS c FROM v GROUP BY 1) b USING (day)
""")
def _(spark, d):
    """Two books of the same days, order totals and lines, compared day by day."""
    orders = X.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(X.cents(F.col("o_totalprice"))).alias("cents"))
    lines = orders_cube(spark, d, measures=("revenue_cents",)).select("day", F.col("revenue_cents").alias("cents"))
    rows = Q.reconcile(orders, lines, ["day"], ["cents"])
    return rows.select("day", F.col("daily_cents").alias("order_cents"), F.col("detail_cents").alias("line_cents"), "status")


@query("jn12_run_log", """
WITH months AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS start_day FROM cal_days),
log AS (
  SELECT year(day) * 10000 + month(day) * 100 + day(day) AS id, CASE WHEN day(day) % 4 = 0 THEN 'margin' ELSE 'retail' END AS scenario, CASE WHEN day(day) % 2 = 0 THEN 'revenue' ELSE 'orders' END AS metric,
         CAST(date_trunc('month', day) AS DATE) AS start_day,
         CASE WHEN day(day) % 3 = 0 THEN 'failed' WHEN day(day) % 3 = 1 THEN 'running' ELSE 'done' END AS status
  FROM cal_days WHERE weekday(day) = 1),
runs AS (SELECT scenario, metric, start_day, COUNT(*) AS n_runs, arg_max(status, id) AS latest_status, string_agg(id, ',' ORDER BY id) AS run_ids FROM log GROUP BY 1, 2, 3)
SELECT m.scenario, m.code, m.start_day, n_runs IS NOT NULL AS started, COALESCE(n_runs, 0) AS n_runs, latest_status, COALESCE(run_ids, '') AS run_ids
FROM (SELECT start_day, unnest(['retail', 'retail', 'retail', 'margin']) AS scenario, unnest(['revenue', 'orders', 'basket', 'revenue']) AS code FROM months) m
LEFT JOIN runs ON runs.scenario = m.scenario AND runs.metric = m.code AND runs.start_day = m.start_day
""")
def _(spark, d):
    """A run log with one run each Monday, texts of both period forms, matched to month results."""
    from deltatree.operators.anomaly import run_status

    days = X.order_heads(spark, d).select("day").distinct()
    month = F.trunc("day", "month")
    log = days.where(F.weekday("day") == 0).select(
        (F.year("day") * 10000 + F.month("day") * 100 + F.dayofmonth("day")).alias("id"),
        F.when(F.dayofmonth("day") % 4 == 0, "margin").otherwise("retail").alias("scenario"),
        F.when(F.dayofmonth("day") % 2 == 0, "revenue").otherwise("orders").alias("metric"),
        F.when(F.dayofmonth("day") % 5 == 0, month.cast("string"))
        .otherwise(F.concat_ws("..", month.cast("string"), F.last_day("day").cast("string"))).alias("period"),
        F.when(F.dayofmonth("day") % 3 == 0, "failed").when(F.dayofmonth("day") % 3 == 1, "running")
        .otherwise("done").alias("status"),
    )
    codes = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(c).alias("code")) for s, c in (
        ("retail", "revenue"), ("retail", "orders"), ("retail", "basket"), ("margin", "revenue"))])
    rows = days.select(month.alias("start_day")).distinct().select("start_day", F.inline(codes))
    return run_status(rows, log, "code", "start_day").select(
        "scenario", "code", "start_day", "started", "n_runs", "latest_status", F.array_join("run_ids", ",").alias("run_ids"))


# --- aggregates -------------------------------------------------------------

@query("ag1_period_values", f"""
SELECT slice_id, code, base, current FROM (
  SELECT slice_id, unnest(['revenue', 'orders', 'basket', 'price_per_unit']) AS code,
         unnest([r0, o0, round(u0 / o0, 6), round(r0 / u0, 6)]) AS base, unnest([r1, o1, round(u1 / o1, 6), round(r1 / u1, 6)]) AS current FROM yr)
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel", "region"))
    pairs = V.period_values(cube, retail(), YEAR0, YEAR1, ((), ("channel",), ("region",)))
    rows = V.long_pairs(pairs, retail(), ["slice_id"])
    return rows.where(F.col("code").isin("revenue", "orders", "basket", "price_per_unit")).select(
        "slice_id", "code", r("base").alias("base"), r("current").alias("current"))


@query("ag2_totals", "SELECT channel, category, region, SUM(revenue_cents)::DOUBLE AS value FROM v GROUP BY 1, 2, 3")
def _(spark, d):
    dims = ("category", "channel", "region")
    return V.metric_totals(lines_cube(spark, d, dims, measures=("revenue_cents",)), retail().root, dims).select(
        "channel", "category", "region", "value")


@query("ag2_totals_null", """
SELECT channel, category, sku, value FROM (
  SELECT channel, category, sku, round(CAST(SUM(CASE WHEN status = 'R' THEN units END) AS DOUBLE)
         / NULLIF(SUM(CASE WHEN status = 'A' AND units > 48 THEN units ELSE 0 END), 0), 6) AS value FROM v GROUP BY 1, 2, 3)
""")
def _(spark, d):
    """A ratio which some combinations do not have: they stay in the result as NULL."""
    rows = X.line_rows(spark, d, ("channel", "category", "sku", "status"), ("units",))
    bulk = rows.withColumn("bulk", F.when(F.col("units") > 48, F.col("units")).otherwise(0))
    value = S.ratio(F.sum(F.when(F.col("status") == "R", F.col("units"))),
                    F.sum(F.when(F.col("status") == "A", F.col("bulk")).otherwise(0)))
    return V.metric_totals(bulk, r(value), ("channel", "category", "sku"))


@query("ag3_daily_series", "SELECT day, segment, region, SUM(revenue_cents)::DOUBLE AS value FROM v GROUP BY 1, 2, 3")
def _(spark, d):
    dims = ("segment", "region")
    return V.daily_series(orders_cube(spark, d, ("region", "segment"), measures=("revenue_cents",)), retail().root, dims)


@query("ag4_conditional", """
SELECT day, CAST(SUM(CASE WHEN status = 'N' THEN revenue_cents ELSE 0 END) AS BIGINT) AS paid_cents,
       CAST(SUM(CASE WHEN status = 'R' THEN revenue_cents ELSE 0 END) AS BIGINT) AS refund_cents,
       COUNT(*) FILTER (WHERE status = 'A') AS cancelled_lines
FROM v GROUP BY day
""")
def _(spark, d):
    rows = lines_cube(spark, d, ("status",), measures=("lines", "revenue_cents"))
    return rows.groupBy("day").agg(
        F.sum(F.when(F.col("status") == "N", F.col("revenue_cents")).otherwise(0)).alias("paid_cents"),
        F.sum(F.when(F.col("status") == "R", F.col("revenue_cents")).otherwise(0)).alias("refund_cents"),
        F.sum(F.when(F.col("status") == "A", F.col("lines")).otherwise(0)).alias("cancelled_lines"))


@query("ag5_ratios", """
SELECT month, slice_id, round(lines / orders, 6) AS lines_per_order, round(units / lines, 6) AS units_per_line,
       round(units / orders, 6) AS basket, round(revenue / units, 6) AS price_per_unit FROM month_sums
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel", "region")).withColumn("month", F.trunc("day", "month"))
    wide = V.slice_sets(cube, ["month"], ((), ("channel",), ("region",), ("channel", "region")), retail().values())
    names = ("lines_per_order", "units_per_line", "basket", "price_per_unit")
    return wide.select("month", "slice_id", *[r(n).alias(n) for n in names])


PIVOT_DIMS = ("channel", "region", "segment")
PIVOT_SETS = [(a,) for a in PIVOT_DIMS] + [("channel", "region"), ("channel", "segment"), ("region", "segment"), PIVOT_DIMS]


@query("ag6_pivots", """
SELECT channel, region, segment, CAST(GROUPING(channel, region, segment) AS BIGINT) AS grouping_id,
       CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents, COUNT(DISTINCT order_id) AS orders
FROM v GROUP BY GROUPING SETS ((channel), (region), (segment), (channel, region), (channel, segment), (region, segment), (channel, region, segment))
""")
def _(spark, d):
    cube = orders_cube(spark, d, PIVOT_DIMS, measures=("orders", "revenue_cents"))
    out = V.slice_sets(cube, [], PIVOT_SETS, [F.sum("revenue_cents").alias("revenue_cents"), F.sum("orders").alias("orders")])
    return out.select("channel", "region", "segment", "grouping_id", "revenue_cents", "orders")


@query("ag7_cross_check", """
SELECT t.grouping_id, t.s AS sum_of_rows, g.s AS root_total, t.s = g.s AS passed FROM
 (SELECT grouping_id, CAST(SUM(revenue_cents) AS BIGINT) AS s FROM (
    SELECT CAST(GROUPING(channel, region, segment) AS BIGINT) AS grouping_id, SUM(revenue_cents) AS revenue_cents
    FROM v GROUP BY GROUPING SETS ((channel), (region), (segment), (channel, region), (channel, segment), (region, segment), (channel, region, segment)))
  GROUP BY 1) t,
 (SELECT CAST(SUM(revenue_cents) AS BIGINT) AS s FROM v) g
""")
def _(spark, d):
    """Root total from the lines alone against the sum of every pivot."""
    cube = orders_cube(spark, d, PIVOT_DIMS, measures=("revenue_cents",))
    sums = V.slice_sets(cube, [], PIVOT_SETS, [F.sum("revenue_cents").alias("revenue_cents")]).groupBy("grouping_id").agg(
        F.sum("revenue_cents").alias("sum_of_rows"))
    root = X.order_rows(spark, d, measures=("revenue_cents",)).agg(F.sum("revenue_cents")).scalar()
    return sums.withColumn("root_total", root).withColumn("passed", F.col("sum_of_rows") == F.col("root_total"))


@query("ag8_daily_fact", """
SELECT day, channel, category, sku, COUNT(*) AS lines, CAST(SUM(units) AS BIGINT) AS units, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents,
       CAST(SUM(discount_cents) AS BIGINT) AS discount_cents, CAST(SUM(tax_cents) AS BIGINT) AS tax_cents, CAST(SUM(material_cents) AS BIGINT) AS material_cents
FROM v GROUP BY 1, 2, 3, 4
""")
def _(spark, d):
    return lines_cube(spark, d, ("channel", "category", "sku"))


@query("ag9_fingerprint", """
SELECT sha256(string_agg(h, '' ORDER BY day)) AS digest, COUNT(*) AS n_days FROM (
  SELECT day, sha256(concat_ws('|', CAST(day AS VARCHAR), orders, lines, units, revenue_cents)) AS h FROM daily)
""")
def _(spark, d):
    cube = orders_cube(spark, d, measures=("orders", "lines", "units", "revenue_cents"))
    return Q.fingerprint(cube, "day", ["orders", "lines", "units", "revenue_cents"])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


@query("ag10_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n_rows FROM {t}" for t in TABLES))
def _(spark, d):
    return Q.row_counts({t: X.table(spark, d, t) for t in TABLES})


@query("ag11_weight_sums", """
SELECT split_part(param_key, '.', 1) AS prefix, round(SUM(value), 6) AS total, abs(SUM(value) - 1) <= 1e-6 AS closed FROM params GROUP BY 1
""")
def _(spark, d):
    return Q.weight_sums(derived_parameters(spark, d)).select("prefix", r("total").alias("total"), "closed")


@query("ag12_normalise", """
SELECT category, sku, round(w / SUM(w) OVER (PARTITION BY category), 6) AS weight
FROM (SELECT category, sku, SUM(units)::DOUBLE / SUM(revenue_cents) AS w FROM v GROUP BY 1, 2)
""")
def _(spark, d):
    cube = lines_cube(spark, d, ("category", "sku"), measures=("units", "revenue_cents"))
    rows = cube.groupBy("category", "sku").agg(S.ratio(F.sum("units"), F.sum("revenue_cents")).alias("w"))
    return Q.normalise(rows, ["category"], "w").select("category", "sku", r("weight").alias("weight"))


@query("ag13_band_stats", """
SELECT channel, round(AVG(m), 4) AS mean_median, round(AVG(s), 4) AS mean_sigma, COUNT(*) AS n_days FROM (
  SELECT a.channel, a.day, median(b.revenue_cents) AS m, CASE WHEN COUNT(*) > 1 THEN stddev_pop(b.revenue_cents) END AS s
  FROM daily_channel a, (SELECT unnest([1, 2, 3, 4]) AS k) w, daily_channel b
  WHERE b.channel = a.channel AND b.day = a.day - 7 * k GROUP BY 1, 2) GROUP BY channel
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), measures=("revenue_cents",))
    series = V.daily_series(cube, retail().root, ("channel",))
    lags = V.weekly_lags(series.select("channel", "day"), series, ["channel"])
    per_day = lags.groupBy("channel", "day").agg(
        F.median("lag_value").alias("m"), F.when(F.count("lag_value") > 1, F.stddev_pop("lag_value")).alias("s"))
    return per_day.groupBy("channel").agg(
        r(F.avg("m"), 4).alias("mean_median"), r(F.avg("s"), 4).alias("mean_sigma"), F.count(F.lit(1)).alias("n_days"))


# --- ordering and sets ------------------------------------------------------

@query("so5_last_days", "SELECT day FROM cal_days ORDER BY day DESC LIMIT 28")
def _(spark, d):
    return X.order_heads(spark, d).select("day").distinct().orderBy(F.col("day").desc()).limit(28)


@query("so6_row_cap", """
SELECT day, channel, revenue_cents, 'overflow' AS status FROM daily_channel ORDER BY revenue_cents DESC, day, channel LIMIT 100
""")
def _(spark, d):
    cube = orders_cube(spark, d, ("channel",), measures=("revenue_cents",))
    return T.limited(cube.select("day", "channel", "revenue_cents"), 100, [F.col("revenue_cents").desc(), "day", "channel"])


@query("set1_key_union", f"""
SELECT channel, category, sku FROM v WHERE {IN_BASE} UNION SELECT channel, category, sku FROM v WHERE {IN_CURRENT}
""")
def _(spark, d):
    dims = ("category", "channel", "sku")
    parts = [lines_cube(spark, d, dims, p, ("lines",)).select(*dims) for p in (BASE, CURRENT)]
    return parts[0].union(parts[1]).distinct().select("channel", "category", "sku")


@query("set2_factor_mismatch", f"""
WITH a AS (SELECT DISTINCT channel, sku AS factor FROM v WHERE {IN_WEEK} AND region = 'ASIA'),
     b AS (SELECT DISTINCT channel, sku AS factor FROM v WHERE {IN_WEEK} AND region = 'EUROPE')
SELECT channel, factor, 'base_only' AS side FROM a ANTI JOIN b USING (channel, factor)
UNION ALL SELECT channel, factor, 'current_only' FROM b ANTI JOIN a USING (channel, factor)
""")
def _(spark, d):
    cube = lines_cube(spark, d, ("channel", "region", "sku"), WEEK, ("lines",)).withColumnRenamed("sku", "factor")
    return D.factor_mismatch(cube.where(F.col("region") == "ASIA"), cube.where(F.col("region") == "EUROPE"), ["channel"])
