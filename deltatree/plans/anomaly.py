"""Anomaly detection over one week, for the total and every channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.operators import anomaly as A
from deltatree.operators import values as V
from deltatree.operators.calendar import date_table, month_factors
from deltatree.plans.common import WEEK, amount, amount_sql, cte, orders_cube, query, r, r_sql, retail, in_money, in_money_sql
from deltatree.plans.relational import PROMOTIONS
from deltatree.sources import facts as X

SETS = ((), ("channel",))

NODE_SQL = {
    "revenue": ("r", True), "orders": ("o", True), "basket": ("u / o", False), "lines_per_order": ("l / o", False),
    "units_per_line": ("u / l", False), "price_per_unit": ("r / u", False),
}
SUMS = ("CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS o, CAST(COUNT(*) AS DOUBLE) AS l, "
        "CAST(SUM(units) AS DOUBLE) AS u, CAST(SUM(revenue_cents) AS DOUBLE) AS r")


def long_nodes(source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{code}' AS code, {str(total).upper()} AS is_total, {e} AS value FROM {source}"
        for code, (e, total) in NODE_SQL.items())


def in_period(p) -> str:
    return f"day BETWEEN DATE '{p.start}' AND DATE '{p.end}'"


cte("day_sums", f"""
SELECT day, CASE WHEN GROUPING(channel) = 0 THEN 'channel=' || channel ELSE 'all' END AS slice_id, {SUMS}
FROM v GROUP BY GROUPING SETS ((day), (day, channel))
""")
cte("day_nodes", long_nodes("day_sums", "day, slice_id"))
cte("season", "SELECT month(day) AS month, AVG(revenue_cents) / (SELECT AVG(revenue_cents) FROM daily) AS season_factor FROM daily GROUP BY 1")


def band_chain(p: str, period) -> None:
    """Subqueries which score one period: change, band, z-score and verdict."""
    cte(f"{p}_sums", f"""
SELECT CASE WHEN {in_period(period)} THEN 'c' ELSE 'b' END AS side,
       CASE WHEN GROUPING(channel) = 0 THEN 'channel=' || channel ELSE 'all' END AS slice_id, {SUMS}
FROM v WHERE {in_period(period)} OR {in_period(period.previous())} GROUP BY GROUPING SETS ((1), (1, channel))
""")
    cte(f"{p}_nodes", long_nodes(f"{p}_sums", "side, slice_id"))
    cte(f"{p}_change", f"""
SELECT *, current - base AS delta, (current - base) / NULLIF(base, 0) AS change_rate FROM (
 SELECT slice_id, code, is_total, COALESCE(MAX(value) FILTER (WHERE side = 'b'), 0) AS base, COALESCE(MAX(value) FILTER (WHERE side = 'c'), 0) AS current
 FROM {p}_nodes GROUP BY 1, 2, 3)
""")
    cte(f"{p}_days", f"""
SELECT slice_id, code, d, median(value) AS m, CASE WHEN COUNT(*) > 1 THEN stddev_pop(value) END AS s FROM (
 SELECT n.slice_id, n.code, p.d, n.value FROM (SELECT DATE '{period.start}' + CAST(i AS INT) AS d FROM range({period.days}) t(i)) p,
  (SELECT unnest([1, 2, 3, 4]) AS k) w, day_nodes n
 WHERE n.day = p.d - 7 * k AND n.day < DATE '{period.start}' AND n.day >= DATE '{A.history_start(period)}')
GROUP BY 1, 2, 3
""")
    cte(f"{p}_band", f"""
SELECT slice_id, code, AVG(m) AS centre, COALESCE(AVG(s), 0) AS sigma, COUNT(*) AS covered_days FROM {p}_days GROUP BY 1, 2
""")
    cte(f"{p}_scored", f"""
SELECT *, CASE WHEN sigma <> 0 THEN (compared - centre) / sigma END AS z,
       COALESCE(compared BETWEEN centre - 2 * sigma AND centre + 2 * sigma, TRUE) AS inside
FROM (SELECT c.*, b.centre, b.sigma, COALESCE(b.covered_days, 0) AS covered_days, basis,
             CASE WHEN basis = 'daily_mean' AND is_total THEN current / {period.days} ELSE current END AS compared
      FROM {p}_change c LEFT JOIN {p}_band b USING (slice_id, code), (SELECT unnest(['daily_mean', 'period_total']) AS basis) k)
""")
    cte(f"{p}_verdicts", f"""
SELECT *, COALESCE(abs(change_rate) > 0.05, FALSE) AND (COALESCE(abs(z) > 2, FALSE) OR (z IS NULL AND COALESCE(sigma, 0) = 0)) AS is_anomaly,
       COALESCE(abs(z), abs(COALESCE(change_rate, 0)) * 10) AS severity,
       CASE WHEN centre IS NULL THEN 'no history' WHEN sigma = 0 THEN 'no spread in history' ELSE '' END AS note
FROM {p}_scored
""")


band_chain("an", WEEK)
#: The days of a chart; its band is that of the days themselves.
SHOWN = WEEK.trailing(60)
band_chain("sb", SHOWN)


def cube(spark, d):
    return orders_cube(spark, d, ("channel",))


@query("an1_change", f"""
SELECT slice_id, code, {amount_sql('base', in_money_sql('code'))} AS base, {amount_sql('current', in_money_sql('code'))} AS current, {amount_sql('delta', in_money_sql('code'))} AS delta, {r_sql('change_rate')} AS change_rate FROM an_change
""")
def _(spark, d):
    changes, _ = A.node_changes(cube(spark, d), retail(), WEEK, sets=SETS)
    return changes.select("slice_id", "code", amount("base", money=in_money("code")), amount("current", money=in_money("code")), amount("delta", money=in_money("code")), r("change_rate").alias("change_rate"))


BAND = f"{amount_sql('centre', in_money_sql('code'))} AS baseline_value, {amount_sql('sigma', in_money_sql('code'))} AS sigma, {amount_sql('centre - 2 * sigma', in_money_sql('code'))} AS baseline_low, {amount_sql('centre + 2 * sigma', in_money_sql('code'))} AS baseline_high, covered_days"


def band_columns():
    return [amount("baseline_value", money=in_money("code")), amount("sigma", money=in_money("code")), amount("baseline_low", money=in_money("code")), amount("baseline_high", money=in_money("code")), "covered_days"]


@query("an2_band", f"SELECT slice_id, code, {BAND} FROM an_band")
def _(spark, d):
    _, series = A.node_changes(cube(spark, d), retail(), WEEK, sets=SETS)
    return A.baseline_band(series, WEEK, ["slice_id", "code"]).select("slice_id", "code", *band_columns())


@query("an3_season", f"""
SELECT slice_id, code, {amount_sql('centre * season_factor', in_money_sql('code'))} AS baseline_value, {amount_sql('sigma', in_money_sql('code'))} AS sigma, {r_sql('season_factor')} AS season_factor FROM an_band, season
WHERE month = month(DATE '{WEEK.start}')
""")
def _(spark, d):
    """The centre moves with the mean season factor of the period's days; the width does not."""
    _, series = A.node_changes(cube(spark, d), retail(), WEEK, sets=SETS)
    bounds = X.order_heads(spark, d).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    factors = month_factors(orders_cube(spark, d, measures=("revenue_cents",)), "revenue_cents")
    season = date_table(bounds, PROMOTIONS, factors).select("day", "season_factor")
    band = A.baseline_band(series, WEEK, ["slice_id", "code"], season=season)
    return band.select("slice_id", "code", amount("baseline_value", money=in_money("code")), amount("sigma", money=in_money("code")), r("season_factor").alias("season_factor"))


@query("an4_z_score", f"""
SELECT slice_id, code, {amount_sql('compared', in_money_sql('code'))} AS compared_value, {r_sql('z', 4)} AS z_score, inside AS in_normal_band FROM an_scored WHERE basis = 'daily_mean'
""")
def _(spark, d):
    rows = A.anomalies(cube(spark, d), retail(), WEEK, sets=SETS)
    return rows.select("slice_id", "code", amount("compared_value", money=in_money("code")), r("z_score", 4).alias("z_score"), "in_normal_band")


def verdict_sql(basis: str) -> str:
    return f"""
SELECT slice_id, code, {r_sql('change_rate')} AS change_rate, {r_sql('z', 4)} AS z_score, is_anomaly, {r_sql('severity', 4)} AS severity, note
FROM an_verdicts WHERE basis = '{basis}'"""


def verdicts(spark, d, basis):
    rows = A.anomalies(cube(spark, d), retail(), WEEK, basis=basis, sets=SETS)
    return rows.select("slice_id", "code", r("change_rate").alias("change_rate"), r("z_score", 4).alias("z_score"),
                       "is_anomaly", r("severity", 4).alias("severity"), "note")


@query("an5_verdict", verdict_sql("daily_mean"))
def _(spark, d):
    return verdicts(spark, d, "daily_mean")


@query("an5_verdict_total", verdict_sql("period_total"))
def _(spark, d):
    return verdicts(spark, d, "period_total")


@query("an6_list", f"""
WITH runs AS (SELECT CASE WHEN day(day) % 2 = 0 THEN 'revenue' ELSE 'basket' END AS code, COUNT(*) AS n_runs,
                     arg_max(CASE WHEN day(day) % 3 = 0 THEN 'failed' ELSE 'done' END, day) AS latest_status
              FROM cal_days WHERE {in_period(WEEK)} GROUP BY 1)
SELECT slice_id, code, is_anomaly, {r_sql('severity', 4)} AS severity, n_runs IS NOT NULL AS started, COALESCE(n_runs, 0) AS n_runs, latest_status
FROM an_verdicts LEFT JOIN runs USING (code) WHERE basis = 'daily_mean'
""")
def _(spark, d):
    """All nodes of the tree, with the state of earlier runs for the same week."""
    rows = A.anomalies(cube(spark, d), retail(), WEEK, sets=SETS).withColumn("start_day", F.lit(WEEK.start).cast("date")).withColumn("scenario", F.lit("retail"))
    days = X.order_heads(spark, d, (), WEEK.start, WEEK.end).select("day").distinct()
    log = days.select(
        F.datediff("day", F.lit("1970-01-01").cast("date")).alias("id"), F.lit("retail").alias("scenario"),
        F.when(F.dayofmonth("day") % 2 == 0, "revenue").otherwise("basket").alias("metric"),
        F.lit(f"{WEEK.start}..{WEEK.end}").alias("period"),
        F.when(F.dayofmonth("day") % 3 == 0, "failed").otherwise("done").alias("status"))
    joined = A.run_status(rows, log, "code", "start_day")
    return joined.select("slice_id", "code", "is_anomaly", r("severity", 4).alias("severity"), "started", "n_runs", "latest_status")


@query("an7_series_band", f"""
SELECT n.slice_id, n.code, n.day, {amount_sql('n.value', in_money_sql('code'))} AS value, {amount_sql('centre', in_money_sql('code'))} AS baseline_value, {amount_sql('centre - 2 * sigma', in_money_sql('code'))} AS baseline_low,
       {amount_sql('centre + 2 * sigma', in_money_sql('code'))} AS baseline_high
FROM day_nodes n LEFT JOIN sb_band b USING (slice_id, code) WHERE {in_period(SHOWN)}
""")
def _(spark, d):
    rows = A.series_with_band(cube(spark, d), retail(), SHOWN, sets=SETS)
    return rows.select("slice_id", "code", "day", amount("value", money=in_money("code")), amount("baseline_value", money=in_money("code")), amount("baseline_low", money=in_money("code")), amount("baseline_high", money=in_money("code")))


@query("so2_severity_order", f"""
SELECT slice_id, code, {r_sql('severity', 4)} AS severity FROM an_verdicts WHERE basis = 'daily_mean'
""")
def _(spark, d):
    rows = A.by_severity(A.anomalies(cube(spark, d), retail(), WEEK, sets=SETS))
    return rows.select("slice_id", "code", r("severity", 4).alias("severity"))
