"""Elasticities of revenue to price over 120 days, and the curves they imply."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions.replicates import BOOTSTRAPS
from deltatree.operators import values as V
from deltatree.operators import whatif as W
from deltatree.plans.anomaly import in_period
from deltatree.plans.common import CURRENT, WHATIF, cte, orders_cube, query, r, r_sql, retail, sig, sig_sql, trees
from deltatree.plans.statistics import channel_slices, stored_cube
from deltatree.session import cut_lineage

SETS = ((), ("channel",), ("channel", "region"))
KEYS = ["slice_id"]
ADJUSTMENT_SQL = "[" + ", ".join(f"{a}::DOUBLE" for a in W.ADJUSTMENTS) + "]"

SLICE_SQL = """CASE WHEN GROUPING(region) = 0 THEN 'channel=' || channel || '&region=' || region
 WHEN GROUPING(channel) = 0 THEN 'channel=' || channel ELSE 'all' END AS slice_id"""


def elasticity_chain(p: str) -> None:
    """Subqueries of the estimate for the series ``{p}_raw`` (slice_id, day, x, y), up to ``{p}_est``."""
    cte(f"{p}_xy", f"""
SELECT slice_id, day, y, x, CASE WHEN x > 0 THEN ln(x) END AS lx, CASE WHEN y > 0 THEN ln(y) END AS ly, row_number() OVER (PARTITION BY slice_id ORDER BY day) - 1 AS i FROM {p}_raw
""")
    cte(f"{p}_fit", f"""
SELECT slice_id, n, CASE WHEN ok THEN slope END AS slope, CASE WHEN ok THEN intercept END AS intercept, CASE WHEN ok THEN r2 END AS r2 FROM (
 SELECT slice_id, COUNT(*) AS n, bool_and(x > 0 AND y > 0) AND var_pop(lx) > 0 AS ok, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept,
  CASE WHEN var_pop(ly) > 0 THEN regr_r2(ly, lx) ELSE 0 END AS r2 FROM {p}_xy GROUP BY 1)
""")
    cte(f"{p}_half", f"""
SELECT slice_id, CASE WHEN n >= 4 THEN ((y1 - y0) / NULLIF(y0, 0)) / NULLIF((x1 - x0) / NULLIF(x0, 0), 0) END AS fd, last_x FROM (
 SELECT slice_id, COUNT(*) AS n, arg_max(x, i) AS last_x, AVG(x) FILTER (WHERE i < n // 2) AS x0, AVG(x) FILTER (WHERE i >= n // 2) AS x1,
  AVG(y) FILTER (WHERE i < n // 2) AS y0, AVG(y) FILTER (WHERE i >= n // 2) AS y1
 FROM (SELECT *, COUNT(*) OVER (PARTITION BY slice_id) AS n FROM {p}_xy) GROUP BY 1)
""")
    cte(f"{p}_draws", f"""
SELECT k.slice_id, rep, regr_slope(ly, lx) AS slope FROM (
 SELECT slice_id, rep, {R.position_sql("row", "j")} % n AS pick FROM (
  SELECT slice_id, n, rep, {R.row_sql("slice_id", "rep")} AS row, unnest(range(n)) AS j FROM {p}_fit, (SELECT unnest(range({BOOTSTRAPS})) AS rep) WHERE n >= 60 AND slope IS NOT NULL)) k
JOIN {p}_xy x ON x.slice_id = k.slice_id AND x.i = k.pick GROUP BY 1, 2
""")
    cte(f"{p}_ci", f"SELECT slice_id, COUNT(slope) AS valid, quantile_cont(slope, 0.05) AS lo, quantile_cont(slope, 0.95) AS hi FROM {p}_draws GROUP BY 1")
    cte(f"{p}_est", f"""
SELECT *, CASE WHEN value IS NULL THEN 'refused' WHEN regress THEN 'log_log' ELSE 'finite_difference' END AS method,
  least(round(0.4 * sp + 0.3 * fp + 0.3 * wp, 4), CASE WHEN r2u IS NULL THEN 0.5 WHEN r2u < 0.3 THEN 0.4 ELSE 1.0 END) AS trust FROM (
 SELECT *, least(1.0, n / 60.0::DOUBLE) AS sp, COALESCE(greatest(0.0, least(1.0, r2u)), 0.0) AS fp,
   1.0 / (1.0 + greatest(0.0, (high - low) / greatest(abs(value), 1e-6) - 1.0)) AS wp FROM (
  SELECT *, CASE WHEN regress THEN least(CASE WHEN valid >= {BOOTSTRAPS // 2} THEN lo ELSE value * 0.5 END, value) ELSE value * 0.5 END AS low,
    CASE WHEN regress THEN greatest(CASE WHEN valid >= {BOOTSTRAPS // 2} THEN hi ELSE value * 1.5 END, value) ELSE value * 1.5 END AS high,
    CASE WHEN regress THEN r2 END AS r2u FROM (
   SELECT f.slice_id, n, r2, lo, hi, COALESCE(valid, 0) AS valid, last_x, n >= 60 AND slope IS NOT NULL AS regress,
     CASE WHEN n >= 60 AND slope IS NOT NULL THEN slope ELSE fd END AS value
   FROM {p}_fit f JOIN {p}_half USING (slice_id) LEFT JOIN {p}_ci USING (slice_id))))
""")


cte("wi_raw", f"""
SELECT slice_id, day, y, y / u AS x FROM (
 SELECT day, {SLICE_SQL}, CAST(SUM(revenue_cents) AS DOUBLE) AS y, CAST(SUM(units) AS DOUBLE) AS u
 FROM v WHERE {in_period(WHATIF)} GROUP BY GROUPING SETS ((day), (day, channel), (day, channel, region)))
""")
elasticity_chain("wi")
cte("wi_base", f"""
SELECT {SLICE_SQL}, CAST(SUM(revenue_cents) AS DOUBLE) AS base_value, CAST(SUM(revenue_cents) AS DOUBLE) / SUM(units) AS factor_base
FROM v WHERE {in_period(CURRENT)} GROUP BY GROUPING SETS ((), (channel), (channel, region))
""")


def curve_cte(name: str, factor_base: str, est: str = "wi_est", base: str = "wi_base") -> None:
    cte(name, f"""
SELECT slice_id, method, reason, a AS adjustment, fb * (1 + a) AS factor_value, base_value * pow(1 + a, value) AS expected,
  least(base_value * pow(1 + a, value), base_value * pow(1 + a, low), base_value * pow(1 + a, high)) AS expected_low,
  greatest(base_value * pow(1 + a, value), base_value * pow(1 + a, low), base_value * pow(1 + a, high)) AS expected_high, base_value
FROM (SELECT *, unnest(CASE WHEN reason = '' THEN {ADJUSTMENT_SQL} ELSE [NULL::DOUBLE] END) AS a FROM (
 SELECT e.*, b.base_value, {factor_base} AS fb, CASE WHEN value IS NULL THEN 'no elasticity' WHEN NOT COALESCE(base_value > 0, FALSE) THEN 'base value not positive'
   WHEN NOT COALESCE({factor_base} > 0, FALSE) THEN 'factor base not positive' ELSE '' END AS reason
 FROM {est} e LEFT JOIN {base} b USING (slice_id)))
""")


curve_cte("wi_curve", "b.factor_base")
curve_cte("wi_combo_curve", "e.last_x")


def price_pairs(cube, sets=SETS):
    """Days with revenue (y) and price (x) per slice, from one aggregate of the cube."""
    daily = V.slice_sets(cube.where(WHATIF.holds(F.col("day"))), ["day"], sets, [retail().root.value("y"), retail().find("price_per_unit").value("x")])
    return daily.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("slice_id", "day", "x", "y")


def priced_cube(spark, d):
    return orders_cube(spark, d, ("channel", "region"), WHATIF)


def estimates(spark, d):
    return W.estimate(price_pairs(priced_cube(spark, d)), KEYS, BOOTSTRAPS)


@query("wi1_log_log", f"SELECT slice_id, n, {r_sql('slope')} AS slope, {r_sql('intercept')} AS intercept, {r_sql('r2')} AS r_squared FROM wi_fit")
def _(spark, d):
    fit = W.log_log_fit(price_pairs(priced_cube(spark, d)), KEYS)
    return fit.select("slice_id", "n", r("slope").alias("slope"), r("intercept").alias("intercept"), r("r_squared").alias("r_squared"))


@query("wi2_bootstrap", f"SELECT slice_id, valid AS valid_draws, {r_sql('lo')} AS draw_low, {r_sql('hi')} AS draw_high FROM wi_ci")
def _(spark, d):
    packed = W.pack(price_pairs(priced_cube(spark, d)), KEYS).where(F.size("_rows") >= W.MIN_OBSERVATIONS)
    return W.bootstrap_slopes(packed, KEYS, BOOTSTRAPS).select(
        "slice_id", "valid_draws", r("draw_low").alias("draw_low"), r("draw_high").alias("draw_high"))


@query("wi3_finite_difference", f"SELECT slice_id, {r_sql('fd')} AS elasticity FROM wi_half")
def _(spark, d):
    rows = W.finite_difference(W.pack(price_pairs(priced_cube(spark, d)), KEYS))
    return rows.select("slice_id", r("finite_difference").alias("elasticity"))


@query("wi4_estimate", f"SELECT slice_id, n, method, {r_sql('value')} AS value, {r_sql('low')} AS low, {r_sql('high')} AS high FROM wi_est")
def _(spark, d):
    return estimates(spark, d).select("slice_id", "n", "method", r("value").alias("value"), r("low").alias("low"), r("high").alias("high"))


@query("wi5_confidence", f"SELECT slice_id, {r_sql('sp', 4)} AS sample_part, {r_sql('fp', 4)} AS fit_part, {r_sql('wp', 4)} AS width_part, CASE WHEN value IS NOT NULL THEN {r_sql('trust', 4)} END AS confidence FROM wi_est")
def _(spark, d):
    return estimates(spark, d).select("slice_id", *[r(c, 4).alias(c) for c in ("sample_part", "fit_part", "width_part", "confidence")])


CURVE_SQL = f"""SELECT slice_id, method, reason, adjustment, {r_sql('factor_value', 4)} AS factor_value, {sig_sql('expected / base_value')} AS expected_ratio,
 {sig_sql('expected_low / base_value')} AS low_ratio, {sig_sql('expected_high / base_value')} AS high_ratio FROM """


def curve_columns(rows):
    return rows.select(
        "slice_id", "method", "reason", "adjustment", r("factor_value", 4).alias("factor_value"),
        sig(F.col("expected") / F.col("base_value")).alias("expected_ratio"),
        sig(F.col("expected_low") / F.col("base_value")).alias("low_ratio"),
        sig(F.col("expected_high") / F.col("base_value")).alias("high_ratio"))


def with_base(est, cube):
    """Elasticities with the revenue and price of the current period."""
    now = V.slice_sets(cube.where(CURRENT.holds(F.col("day"))), [], SETS, [
        retail().root.value("base_value"), retail().find("price_per_unit").value("factor_base")])
    return est.join(now.select("slice_id", "base_value", "factor_base"), KEYS, "left")


def whatif_curve(spark, d, last_observation=False, sets=SETS, **options):
    cube = cut_lineage(priced_cube(spark, d), "priced")
    est = with_base(W.estimate(price_pairs(cube, sets), KEYS, BOOTSTRAPS), cube)
    if last_observation:
        est = est.withColumn("factor_base", F.col("last_x"))
    return W.curve(est, [*KEYS, "base_value"], **options)


@query("wi6_curve", f"""
SELECT slice_id, adjustment, {sig_sql('expected / base_value')} AS expected_ratio, abs(adjustment) > 0.25 AS out_of_range FROM wi_curve WHERE reason = ''
""")
def _(spark, d):
    rows = whatif_curve(spark, d, max_adjustment=0.25).where(F.col("reason") == "")
    return rows.select("slice_id", "adjustment", sig(F.col("expected") / F.col("base_value")).alias("expected_ratio"), "out_of_range")


KNOBS = (
    W.Knob("margin", "avg_price", "Average price", "CAST(SUM(fact.revenue_cents) AS DOUBLE) / NULLIF(SUM(fact.units), 0)"),
    W.Knob("margin", "tax_rate", "Tax rate", "CAST(SUM(fact.tax_cents) AS DOUBLE) / NULLIF(SUM(fact.revenue_cents), 0)"),
    W.Knob("margin", "lines_mix", "Mix of lines", "", "the mix of lines follows from the customers' orders"),
)


@query("wi7_knobs", """
SELECT channel, factor, CASE factor WHEN 'ship_date' THEN 'not_intervenable' WHEN 'lines_mix' THEN 'not_estimable' ELSE 'ok' END AS status,
       CASE factor WHEN 'lines_mix' THEN 'the mix of lines follows from the customers'' orders' WHEN 'ship_date' THEN NULL ELSE '' END AS reject_reason
FROM (SELECT DISTINCT channel FROM v), (SELECT unnest(['avg_price', 'tax_rate', 'lines_mix', 'ship_date']) AS factor)
""")
def _(spark, d):
    channels = orders_cube(spark, d, ("channel",), measures=("orders",)).select("channel").distinct()
    wanted = F.array(*[F.lit(x) for x in ("avg_price", "tax_rate", "lines_mix", "ship_date")])
    requests = channels.select("channel", F.lit("margin").alias("scenario"), F.explode(wanted).alias("factor"))
    declared = {"margin": trees()["margin"].intervenable_factors}
    return W.resolve_knobs(requests, declared, KNOBS).select("channel", "factor", "status", "reject_reason")


@query("wi8_whatif", CURVE_SQL + "wi_curve")
def _(spark, d):
    return curve_columns(whatif_curve(spark, d))


@query("wi9_by_combination", CURVE_SQL + "wi_combo_curve WHERE slice_id LIKE '%&%'")
def _(spark, d):
    """Per combination the anchor is the price last observed."""
    return curve_columns(whatif_curve(spark, d, last_observation=True, sets=(("channel", "region"),)))


# --- what-if from the knob's own expression ----------------------------------

RUSH = ("1-URGENT", "2-HIGH")
RETAIL_KNOBS = (
    W.Knob("retail", "avg_price", "Price of a unit", "CAST(SUM(fact.revenue_cents) AS DOUBLE) / NULLIF(SUM(fact.units), 0)"),
    W.Knob("retail", "tax_rate", "Tax rate", "CAST(SUM(fact.tax_cents) AS DOUBLE) / NULLIF(SUM(fact.revenue_cents), 0)"),
    W.Knob("retail", "rush_share", "Share of units sold in a hurry", "CAST(SUM(CASE WHEN is_rush THEN fact.units ELSE 0 END) AS DOUBLE) / NULLIF(SUM(fact.units), 0)",
           proxy="urgency"),
    W.Knob("retail", "lines_mix", "Mix of lines", "", "the mix of lines follows from the customers' orders"),
)
WANTED = (*[k.code for k in RETAIL_KNOBS], "ship_date")
KNOB_DIMS = ("channel", "region")
_rush = ", ".join(f"'{c}'" for c in RUSH)

cte("wk_rows", """
SELECT 'all' AS slice_id, v.* FROM v UNION ALL SELECT 'channel=' || channel, v.* FROM v
UNION ALL SELECT 'ends', v.* FROM v WHERE region IN ((SELECT MIN(region) FROM v), (SELECT MAX(region) FROM v)) AND channel IN ((SELECT MIN(channel) FROM v), (SELECT MAX(channel) FROM v))
""")


def knob_sql(rows: str, period: str, keys: str, day: str, x: str, y: str) -> str:
    """Target and knobs of rows by key, as the proxies' expressions give them."""
    return f"""
SELECT {keys} || '/' || factor {"|| '/' || channel || '/' || region" if 'combo' in rows else ''} AS slice_id, {day} {y}, {x} FROM (
 SELECT *, unnest(['avg_price', 'tax_rate', 'rush_share']) AS factor, unnest([{y} / u, t / {y}, h / u]) AS {x} FROM (
  SELECT {keys}, {day} {"channel, region," if 'combo' in rows else ''} CAST(SUM(revenue_cents) AS DOUBLE) AS {y}, CAST(SUM(units) AS DOUBLE) AS u, CAST(SUM(tax_cents) AS DOUBLE) AS t,
   CAST(SUM(CASE WHEN channel IN ({_rush}) THEN units ELSE 0 END) AS DOUBLE) AS h FROM {rows} WHERE {period} GROUP BY ALL))
"""


cte("wk_combo", "SELECT * FROM wk_rows WHERE slice_id = 'all'")
cte("wk_raw", knob_sql("wk_rows", in_period(WHATIF), "slice_id", "day,", "x", "y"))
cte("wk_base", knob_sql("wk_rows", in_period(CURRENT), "slice_id", "", "factor_base", "base_value"))
elasticity_chain("wk")
curve_cte("wk_curve", "b.factor_base", "wk_est", "wk_base")
cte("wc_raw", knob_sql("wk_combo", in_period(WHATIF), "slice_id", "day,", "x", "y"))
cte("wc_base", knob_sql("wk_combo", in_period(CURRENT), "slice_id", "", "factor_base", "base_value"))
elasticity_chain("wc")
curve_cte("wc_curve", "e.last_x", "wc_est", "wc_base")


def knob_slices(cube):
    """The total, every channel, a slice of several codes in two dimensions, and one whose code doesn't occur."""
    codes = cube.agg(*[f(d).alias(f"{d}{i}") for d in KNOB_DIMS for i, f in enumerate((F.min, F.max))])
    ends = codes.select(F.lit("ends").alias("slice_id"), F.create_map(*[
        x for d in KNOB_DIMS for x in (F.lit(d), F.array_distinct(F.array(f"{d}0", f"{d}1")))]).alias("dims"))
    lost = codes.select(F.lit("lost").alias("slice_id"), F.create_map(F.lit("channel"), F.array(F.lit("no such channel"))).alias("dims"))
    return channel_slices(cube).select("slice_id", "dims").unionByName(ends).unionByName(lost)


def knob_inputs(spark, d):
    """Cube, slices and the proxy tables: which channels are urgent, from the orders themselves."""
    cube = stored_cube(spark, d, KNOB_DIMS)
    urgency = cube.select(F.col("channel").alias("code")).distinct().withColumn("is_rush", F.col("code").isin(*RUSH))
    return cube, knob_slices(cube), {"urgency": W.Proxy("channel", urgency)}


def knob_requests(spark, d):
    cube, slices, proxies = knob_inputs(spark, d)
    requests = slices.select("slice_id", F.explode(F.array(*[F.lit(w) for w in WANTED])).alias("factor")).withColumn(
        "request_id", F.concat_ws("/", "slice_id", "factor"))
    return W.run_whatif(requests, cube, slices, KNOB_DIMS, retail(), RETAIL_KNOBS, proxies, WHATIF, CURRENT)


def knob_curve_columns(rows, *first):
    """Logarithms of the ratios: few days give elasticities whose ratios have thirty digits."""
    return rows.select(
        *first, "reason", "method", "adjustment", r("factor_value").alias("factor_value"), *[
            r(F.ln(F.col(c) / F.col("base_value"))).alias(f"log_{c}") for c in ("expected", "expected_low", "expected_high")])


KNOB_CURVE = f"reason, method, adjustment, {r_sql('factor_value')} AS factor_value, " + ", ".join(
    f"{r_sql(f'ln({c} / base_value)')} AS log_{c}" for c in ("expected", "expected_low", "expected_high"))


@query("wi8_knob_curves", f"""
SELECT slice_id AS request_id, 'ok' AS status, {KNOB_CURVE} FROM wk_curve
UNION ALL SELECT 'lost/' || f, 'ok', 'no observations', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(['avg_price', 'tax_rate', 'rush_share']) AS f)
UNION ALL SELECT s || '/' || f, st, re, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT slice_id AS s FROM wk_rows UNION ALL SELECT 'lost'),
 (VALUES ('lines_mix', 'not_estimable', 'the mix of lines follows from the customers'' orders'), ('ship_date', 'not_intervenable', 'not_intervenable')) t(f, st, re)
""")
def _(spark, d):
    return knob_curve_columns(knob_requests(spark, d), "request_id", "status")


@query("wi9_knob_combinations", f"""
SELECT 'all' AS slice_id, split_part(slice_id, '/', 2) AS factor, split_part(slice_id, '/', 3) AS channel, split_part(slice_id, '/', 4) AS region, n, {KNOB_CURVE}
FROM wc_curve JOIN (SELECT slice_id, n FROM wc_est) USING (slice_id)
""")
def _(spark, d):
    cube, slices, proxies = knob_inputs(spark, d)
    rows = W.whatif_by(cube, slices.where("slice_id = 'all'"), KNOB_DIMS, ("channel", "region"), retail(), RETAIL_KNOBS, proxies, WHATIF, CURRENT)
    return knob_curve_columns(rows, "slice_id", "factor", "channel", "region", "n")


@query("jn5_knob_series", f"SELECT slice_id AS series, COUNT(*) AS n, {r_sql('SUM(x)')} AS sum_x, SUM(y) AS sum_y FROM wk_raw GROUP BY 1")
def _(spark, d):
    cube, slices, proxies = knob_inputs(spark, d)
    knobs = W.estimable_knobs(RETAIL_KNOBS, retail())
    rows = V.join_slices(W.with_proxies(cube.where(WHATIF.holds(F.col("day"))), knobs, proxies), slices, KNOB_DIMS)
    pairs = W.knob_values(rows, ["slice_id", "day"], retail().root.value("_target"), knobs, ("y", "x"))
    return pairs.groupBy(F.concat_ws("/", "slice_id", "factor").alias("series")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("x")).alias("sum_x"), F.sum("y").alias("sum_y"))


@query("set3_warnings", """
SELECT slice_id, array_to_string(list_concat(['extrapolated'], list_concat(CASE WHEN method = 'finite_difference' THEN ['fallback'] ELSE [] END,
   list_concat(CASE WHEN regress AND r2u < 0.3 THEN ['weak fit'] ELSE [] END, CASE WHEN NOT regress AND n < 60 THEN ['small sample'] ELSE [] END))), ',') AS warnings
 FROM wi_est JOIN (SELECT DISTINCT slice_id FROM wi_curve WHERE reason = '') USING (slice_id)
""")
def _(spark, d):
    """Warnings of curve and estimate in order, each once."""
    rows = whatif_curve(spark, d, max_adjustment=0.25).where(F.col("reason") == "")
    return rows.select("slice_id", F.array_join("warnings", ",").alias("warnings")).distinct()
