"""Data quality, injected shocks and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.functions import scalar as S
from deltatree.functions.periods import Period, last_days
from deltatree.operators import decompose as D
from deltatree.operators import hypotheses as H
from deltatree.operators import quality as Q
from deltatree.operators import shocks as K
from deltatree.operators import values as V
from deltatree.operators.calendar import date_table, month_factors
from deltatree.plans.anomaly import in_period
from deltatree.plans.common import amount_sql, amount, cte, lines_cube, margin, orders_cube, query, r, r_sql, retail, in_money, in_money_sql
from deltatree.plans.relational import PROMOTIONS, TABLES, derived_parameters, in_promotion_sql
from deltatree.plans.statistics import DIMS, chain, stored_cube, stored_run
from deltatree.session import cut_lineage
from deltatree.sources import facts as X

@query("dq1_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS name, COUNT(*) AS n_rows, CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {t}"
    for t in TABLES))
def _(spark, d):
    return Q.table_status(spark, d, TABLES)


@query("dq2_reconcile", """
SELECT status, COUNT(*) AS n_days FROM (
 SELECT 'equal' AS status FROM (SELECT day, SUM(units) AS a FROM v GROUP BY 1)) GROUP BY 1
""")
def _(spark, d):
    """Orders summed before the join against lines summed after it: two independent plans."""
    measures = ["lines", "units", "revenue_cents"]
    daily = orders_cube(spark, d, measures=measures)
    detail = lines_cube(spark, d, measures=(*measures, "material_cents"))
    return Q.reconcile(daily, detail, ["day"], measures).groupBy("status").agg(F.count(F.lit(1)).alias("n_days"))


cte("last28", "SELECT MIN(day) AS s, MAX(day) AS e FROM (SELECT day FROM cal_days ORDER BY day DESC LIMIT 28)")


@query("dq3_metric_values", f"""
SELECT code, {amount_sql('value', in_money_sql('code'))} AS value, TRUE AS passed FROM (
 SELECT unnest(['profit', 'revenue', 'units', 'avg_price', 'discount_cost', 'discount_lines', 'discount_per_line', 'tax_cost', 'material_cost', 'material_lines', 'units_in_line', 'material_per_unit']) AS code,
  unnest([r - dc - t - m, r, u, r / u, dc, l, dc / l, t, m, l, u / l, m / u]) AS value
 FROM (SELECT SUM(revenue_cents)::DOUBLE AS r, COUNT(*)::DOUBLE AS l, SUM(units)::DOUBLE AS u, SUM(discount_cents)::DOUBLE AS dc, SUM(tax_cents)::DOUBLE AS t, SUM(material_cents)::DOUBLE AS m
       FROM v, last28 WHERE day BETWEEN s AND e))
""")
def _(spark, d):
    """Every node over the last 28 days of the data; the window is a scalar subquery."""
    cube = lines_cube(spark, d)
    first = last_days(X.order_heads(spark, d), (28,)).select("start_day").scalar()
    return Q.validate_nodes(cube.where(F.col("day") >= first), margin()).select("code", amount("value", money=in_money("code")), "passed")


@query("dq4_identities", f"""
WITH t AS (SELECT COUNT(DISTINCT order_id)::DOUBLE AS o, COUNT(*)::DOUBLE AS l, SUM(units)::DOUBLE AS u, SUM(revenue_cents)::DOUBLE AS r, SUM(discount_cents)::DOUBLE AS dc,
                  SUM(tax_cents)::DOUBLE AS t, SUM(material_cents)::DOUBLE AS m FROM v),
x AS (SELECT unnest(['retail', 'retail', 'margin', 'margin', 'margin', 'margin']) AS scenario, unnest(['revenue', 'basket', 'profit', 'revenue', 'discount_cost', 'material_cost']) AS node,
             unnest([r, u / o, r - dc - t - m, r, dc, m]) AS declared, unnest([o * (u / o) * (r / u), (l / o) * (u / l), r - dc - t - m, u * (r / u), l * (dc / l), l * (u / l) * (m / u)]) AS derived FROM t)
SELECT scenario, node, {amount_sql('declared', in_money_sql('node'))} AS declared, {amount_sql('derived', in_money_sql('node'))} AS derived, abs(declared - derived) / greatest(abs(derived), 1) < 1e-9 AS passed FROM x
""")
def _(spark, d):
    """All identities of both trees over the whole history."""
    parts = []
    for tree, cube in ((retail(), orders_cube(spark, d)), (margin(), lines_cube(spark, d))):
        wide = cube.alias("fact").agg(*tree.values()).withColumn("scenario", F.lit(tree.scenario))
        parts.append(D.node_identities(wide, tree, ["scenario"]).select(
            "scenario", "node", amount("declared", money=in_money("node")), amount("derived", money=in_money("node")), "passed"))
    return parts[0].unionByName(parts[1])


# --- shocks -----------------------------------------------------------------

SHOCKS = (
    K.Shock("price_urgent", "price_per_unit", ("revenue_cents",), 0.6, Period("1998-01-05", "1998-01-11"), {"channel": ["1-URGENT"]}),
    K.Shock("basket_asia", "basket", ("units", "revenue_cents"), 1.5, Period("1998-03-02", "1998-03-08"), {"region": ["ASIA"]}),
    K.Shock("orders_cars", "orders", ("orders", "lines", "units", "revenue_cents"), 3.0, Period("1998-05-04", "1998-05-17"), {"segment": ["AUTOMOBILE"]}),
    K.Shock("price_all", "price_per_unit", ("revenue_cents",), 1.3, Period("1998-07-06", "1998-07-12"), {}),
)
MASKS = {s.id: " AND ".join([in_period(s.window)] + [f"{k} IN ({', '.join(repr(c) for c in codes)})" for k, codes in s.slice.items()]) for s in SHOCKS}
BEFORE = {s.id: " AND ".join([in_period(s.window.previous())] + [f"{k} IN ({', '.join(repr(c) for c in codes)})" for k, codes in s.slice.items()]) for s in SHOCKS}

cte("cells", """
SELECT day, channel, region, segment, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS lines, CAST(SUM(units) AS BIGINT) AS units, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v GROUP BY 1, 2, 3, 4
""")


def shocked_column(column: str) -> str:
    """CASE over the shocks that scale a column; their masks do not overlap."""
    arms = " ".join(f"WHEN {MASKS[s.id]} THEN CAST(round_even({column} * {s.multiplier}::DOUBLE, 0) AS BIGINT)" for s in SHOCKS if column in s.columns)
    return f"CASE {arms} ELSE {column} END AS {column}" if arms else column


MEASURES = ("orders", "lines", "units", "revenue_cents")
cte("shocked", f"SELECT day, channel, region, segment, {', '.join(shocked_column(c) for c in MEASURES)} FROM cells")


def cells(spark, d):
    return orders_cube(spark, d, DIMS, measures=MEASURES)


FUNNEL = K.Shock("funnel", "orders", ("lines", "orders"), 4.0, Period("1998-02-02", "1998-02-15"), {"region": ["EUROPE", "ASIA"]}, stages=("units", "lines", "orders"))


@query("pe1_inject", f"""
WITH f AS (SELECT *, {in_period(FUNNEL.window)} AND region IN ('EUROPE', 'ASIA') AS hit FROM shocked),
h AS (SELECT *, CASE WHEN hit THEN least(CAST(round_even(lines * 4.0::DOUBLE, 0) AS BIGINT), units) ELSE lines END AS l2 FROM f)
SELECT day, channel, CAST(SUM(units) AS BIGINT) AS units, CAST(SUM(l2) AS BIGINT) AS lines,
       CAST(SUM(CASE WHEN hit THEN least(CAST(round_even(orders * 4.0::DOUBLE, 0) AS BIGINT), l2) ELSE orders END) AS BIGINT) AS orders,
       CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM h GROUP BY 1, 2
""")
def _(spark, d):
    rows = K.inject_shocks(cells(spark, d), (*SHOCKS, FUNNEL))
    return rows.groupBy("day", "channel").agg(*[F.sum(c).alias(c) for c in ("units", "lines", "orders", "revenue_cents")])


_truths = []
for _s in SHOCKS:
    _both = "units" in _s.columns
    _truths.append(f"""SELECT '{_s.id}' AS truth_id, '{_s.factor}' AS factor, observed, {'w0' if _both else 'm0 / w0'} AS x0, {'w1' if _both else 'observed / w1'} AS x1 FROM (
 SELECT SUM(c.revenue_cents)::DOUBLE AS m0, SUM(c.units)::DOUBLE AS w0, SUM(k.revenue_cents)::DOUBLE AS observed, SUM(k.units)::DOUBLE AS w1
 FROM cells c JOIN shocked k USING (day, channel, region, segment) WHERE {MASKS[_s.id]})""")
cte("truths", f"""
SELECT *, CAST(round(observed * x0 / x1) AS BIGINT) AS counterfactual FROM ({' UNION ALL '.join(_truths)})
""")


#: The closed form of one moving factor gives the contribution to a cent.
_recheck = """COALESCE(abs(CASE WHEN counterfactual > 0 AND observed > 0 AND x0 > 0 AND x1 > 0 THEN
 CASE WHEN observed = counterfactual THEN 0.0 ELSE (observed - counterfactual) / ln(observed / counterfactual) * ln(x1 / x0) END END - (observed - counterfactual)) <= 1.0, FALSE)"""


@query("pe2_truth", f"""
SELECT truth_id, factor, {r_sql('x0')} AS factor_base, {r_sql('x1')} AS factor_injected, counterfactual, CAST(observed AS BIGINT) AS observed,
       CAST(observed AS BIGINT) - counterfactual AS contribution, {_recheck} AS recheck_ok FROM truths
""")
def _(spark, d):
    rows = K.truth_rows(cells(spark, d), SHOCKS, "revenue_cents", "units")
    return rows.select("truth_id", "factor", r("factor_base").alias("factor_base"), r("factor_injected").alias("factor_injected"),
                       "counterfactual", "observed", "contribution", "recheck_ok")


_now = " UNION ALL ".join(
    f"SELECT '{_s.id}' AS truth_id, SUM(revenue_cents)::DOUBLE AS m, SUM(units)::DOUBLE AS w FROM shocked WHERE {MASKS[_s.id]}" for _s in SHOCKS)


@query("dq5_truth_recheck", f"""
SELECT truth_id, observed = m AS metric_equal, COALESCE(abs(CASE WHEN truth_id = 'price_all' THEN x1 + 1 ELSE x1 END - CASE WHEN truth_id LIKE 'price%' THEN m / w ELSE w END) <= 1e-6, FALSE) AS factor_equal
FROM truths JOIN ({_now}) USING (truth_id)
""")
def _(spark, d):
    """Stored truth (one factor value spoilt on purpose) against values recomputed from the shocked fact."""
    before = cut_lineage(cells(spark, d), "cells")
    truth = K.truth_rows(before, SHOCKS, "revenue_cents", "units")
    stored = cut_lineage(truth.withColumn("factor_injected", F.when(
        F.col("truth_id") == "price_all", F.col("factor_injected") + 1).otherwise(F.col("factor_injected"))), "truth")
    after = K.inject_shocks(before, SHOCKS)
    current = K.tag_shocks(after, SHOCKS).where(F.col("period") == "current").groupBy("truth_id").agg(
        F.sum("revenue_cents").alias("observed_now"), F.sum("units").alias("units"))
    factor = F.when(F.col("truth_id").startswith("price"), F.col("observed_now") / F.col("units")).otherwise(F.col("units").cast("double"))
    return K.stored_truth_check(stored, current.withColumn("factor_now", factor))


@query("dq6_staleness", """
SELECT month, sha256(string_agg(h1, '' ORDER BY day)) <> sha256(string_agg(h2, '' ORDER BY day)) AS stale FROM (
 SELECT strftime(day, '%Y-%m') AS month, day, sha256(concat_ws('|', CAST(day AS VARCHAR), CAST(SUM(c.units) AS BIGINT), CAST(SUM(c.revenue_cents) AS BIGINT))) AS h1,
        sha256(concat_ws('|', CAST(day AS VARCHAR), CAST(SUM(k.units) AS BIGINT), CAST(SUM(k.revenue_cents) AS BIGINT))) AS h2
 FROM cells c JOIN shocked k USING (day, channel, region, segment) GROUP BY 1, 2) GROUP BY 1
""")
def _(spark, d):
    before = cells(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    columns = ["units", "revenue_cents"]
    stored = Q.part_digests(before, "month", "day", columns)
    now = Q.part_digests(K.inject_shocks(before, SHOCKS), "month", "day", columns)
    return Q.stale_parts(stored, now, "month")


@query("dq7_invariants", """
SELECT status, COUNT(*) AS n_rows, unnest(['units_positive', 'discount_below_revenue', 'tax_below_discount', 'price_floor']) AS rule,
       unnest([COUNT(*) FILTER (WHERE NOT units > 0), COUNT(*) FILTER (WHERE NOT discount_cents <= revenue_cents),
               COUNT(*) FILTER (WHERE NOT tax_cents <= discount_cents), COUNT(*) FILTER (WHERE NOT revenue_cents >= units * 1000)]) AS violations
FROM v GROUP BY 1
""")
def _(spark, d):
    rows = X.line_rows(spark, d, ("status",), ("units", "revenue_cents", "discount_cents", "tax_cents"))
    rules = {
        "units_positive": F.col("units") > 0,
        "discount_below_revenue": F.col("discount_cents") <= F.col("revenue_cents"),
        "tax_below_discount": F.col("tax_cents") <= F.col("discount_cents"),
        "price_floor": F.col("revenue_cents") >= F.col("units") * 1000,
    }
    return Q.rule_violations(rows, rules, ["status"])


@query("dq8_provenance", """
SELECT param_key, 'source_type' AS rule FROM params WHERE source_type NOT IN ('official', 'derived', 'self_defined')
UNION ALL SELECT param_key, 'source' FROM params WHERE source_type IN ('official', 'derived') AND source_url IS NULL
UNION ALL SELECT param_key, 'captured_on' FROM params WHERE source_type IN ('official', 'derived') AND NOT regexp_full_match(captured_on, '\\d{4}-\\d{2}-\\d{2}')
""")
def _(spark, d):
    return Q.parameter_violations(derived_parameters(spark, d))


def season(spark, d):
    """Month factors of revenue per selling day."""
    return month_factors(orders_cube(spark, d, measures=("revenue_cents",)), "revenue_cents")


@query("dq9_date_table", f"""
SELECT day, year(day)::INT AS year, month(day)::INT AS month, quarter(day)::INT AS quarter, (isodow(day) - 1)::INT AS weekday, isodow(day) >= 6 AS is_weekend,
       promo_name IS NOT NULL AS is_promo, promo_name, {r_sql('COALESCE(season_factor, 1.0::DOUBLE)')} AS season_factor, COALESCE(promo_lift, 1.0) AS promo_lift
FROM (SELECT CAST(unnest(range((SELECT MIN(day) FROM cal_days)::TIMESTAMP, (SELECT MAX(day) FROM cal_days)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN all_promo USING (day) LEFT JOIN season ON season.month = month(day)
""")
def _(spark, d):
    bounds = X.order_heads(spark, d).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return date_table(bounds, PROMOTIONS, season(spark, d)).withColumn("season_factor", r("season_factor"))


_promo = ", ".join(f"({i}, '{n}', {a * 100 + b}, {c * 100 + e}, {lift}::DOUBLE)" for i, (n, a, b, c, e, lift) in enumerate(PROMOTIONS))
cte("all_promo", f"""
SELECT day, arg_min(name, i) AS promo_name, arg_min(lift, i) AS promo_lift FROM
 (SELECT CAST(unnest(range((SELECT MIN(day) FROM cal_days)::TIMESTAMP, (SELECT MAX(day) FROM cal_days)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day)
JOIN (VALUES {_promo}) p(i, name, s, e, lift) ON {in_promotion_sql("day")} GROUP BY day
""")

@query("dq10_sku_costs", """
SELECT part_id, category, price AS standard_price_cents, CAST(round_even(price * (1.0::DOUBLE - margin), 0) AS BIGINT) AS unit_cost_cents FROM (
 SELECT p_partkey AS part_id, p_type AS category, CAST(round_even(CAST(round(p_retailprice * 100) AS BIGINT) * factor, 0) AS BIGINT) AS price, margin
 FROM part JOIN (SELECT p_type AS t, round(AVG(round(p_retailprice * 100)) / (SELECT AVG(round(p_retailprice * 100)) FROM part), 4) AS factor FROM part GROUP BY 1) ON t = p_type
 JOIN (SELECT sku, round(SUM(discount_cents) / SUM(revenue_cents)::DOUBLE, 4) AS margin FROM v GROUP BY 1) ON sku = p_brand)
""")
def _(spark, d):
    """Standard price per part by the category's price level, cost by the brand's observed discount as margin."""
    parts = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("sku"),
        X.cents(F.col("p_retailprice")).alias("price_cents"))
    level = parts.agg(F.avg("price_cents")).scalar()
    factors = parts.groupBy("category").agg(F.round(F.avg("price_cents") / level, 4).alias("factor"))
    sums = lines_cube(spark, d, ("sku",), measures=("revenue_cents", "discount_cents")).groupBy("sku").agg(
        F.round(F.sum("discount_cents") / F.sum("revenue_cents"), 4).alias("margin"))
    return Q.derive_skus(parts, factors, sums).select("part_id", "category", "standard_price_cents", "unit_cost_cents")


# --- evaluation -------------------------------------------------------------

_evals = []
for _s in SHOCKS:
    _evals.append(f"""SELECT '{_s.id}' AS truth_id, '{_s.factor}' AS expected_factor,
 SUM(orders) FILTER (WHERE {BEFORE[_s.id]})::DOUBLE AS o0, SUM(orders) FILTER (WHERE {MASKS[_s.id]})::DOUBLE AS o1, SUM(units) FILTER (WHERE {BEFORE[_s.id]})::DOUBLE AS u0,
 SUM(units) FILTER (WHERE {MASKS[_s.id]})::DOUBLE AS u1, SUM(revenue_cents) FILTER (WHERE {BEFORE[_s.id]})::DOUBLE AS r0, SUM(revenue_cents) FILTER (WHERE {MASKS[_s.id]})::DOUBLE AS r1 FROM shocked""")
cte("eval_sums", " UNION ALL ".join(_evals))
cte("eval_ranked", """
SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY abs(c) DESC, child_order) AS rank FROM (
 SELECT truth_id, expected_factor, unnest(['orders', 'basket', 'price_per_unit']) AS factor, unnest([0, 1, 2]) AS child_order,
  unnest([lm * (ln(o1) - ln(o0)), lm * (ln(u1 / o1) - ln(u0 / o0)), lm * (ln(r1 / u1) - ln(r0 / u0))]) AS c
 FROM (SELECT *, CASE WHEN r1 = r0 THEN r1 ELSE (r1 - r0) / (ln(r1) - ln(r0)) END AS lm FROM eval_sums))
""")
cte("eval_cases", """
SELECT truth_id, expected_factor, first_factor, rank = 1 AS top1_hit, rank <= 3 AS top3_hit, true_contribution, CAST(round(found) AS BIGINT) AS found_contribution,
       CASE WHEN true_contribution <> 0 THEN abs(round(found) - true_contribution) / greatest(abs(true_contribution), 1) END AS relative_error, conserved
FROM (SELECT truth_id, expected_factor, arg_min(factor, rank) AS first_factor, MIN(rank) FILTER (WHERE factor = expected_factor) AS rank, MAX(c) FILTER (WHERE factor = expected_factor) AS found, bool_and(c IS NOT NULL) AS conserved FROM eval_ranked GROUP BY 1, 2)
JOIN (SELECT truth_id, CAST(observed AS BIGINT) - counterfactual AS true_contribution FROM truths) USING (truth_id)
""")


#: Nodes below the root that an evaluation splits too.
TARGETS = ("basket",)


def evaluated(spark, d):
    before = cut_lineage(cells(spark, d), "cells")
    truth = K.truth_rows(before, SHOCKS, "revenue_cents", "units")
    return K.evaluate_attribution(K.inject_shocks(before, SHOCKS), retail(), SHOCKS, truth, TARGETS)


@query("el1_cases", f"""
SELECT truth_id, expected_factor, first_factor, top1_hit, top3_hit, true_contribution, found_contribution, {r_sql('relative_error')} AS relative_error, conserved,
       'basket,revenue' AS nodes, conserved AS residual_small FROM eval_cases
""")
def _(spark, d):
    rows = evaluated(spark, d).withColumn("relative_error", r("relative_error"))
    return rows.withColumn("residual_small", F.coalesce(F.col("max_residual") < S.TOLERANCE, F.lit(False))).drop("max_residual")


cte("eval_lines", " UNION ALL ".join(
    f"SELECT '{_s.id}' AS truth_id, SUM(lines) FILTER (WHERE {BEFORE[_s.id]})::DOUBLE AS l0, SUM(lines) FILTER (WHERE {MASKS[_s.id]})::DOUBLE AS l1 FROM shocked" for _s in SHOCKS))
cte("eval_basket", """
SELECT truth_id, expected_factor, unnest(['lines_per_order', 'units_per_line']) AS factor, unnest([0, 1]) AS child_order,
  unnest([lm * (ln(l1 / o1) - ln(l0 / o0)), lm * (ln(u1 / l1) - ln(u0 / l0))]) AS c
FROM (SELECT *, CASE WHEN u1 / o1 = u0 / o0 THEN u1 / o1 ELSE (u1 / o1 - u0 / o0) / (ln(u1 / o1) - ln(u0 / o0)) END AS lm FROM eval_sums JOIN eval_lines USING (truth_id))
""")


@query("el1_targets", """
SELECT truth_id, expected_factor, 'revenue' AS node, arg_min(factor, rank) AS first_factor, CAST(MIN(rank) FILTER (WHERE factor = expected_factor) AS INT) AS rank, bool_and(c IS NOT NULL) AS conserved FROM eval_ranked GROUP BY 1, 2
UNION ALL SELECT truth_id, expected_factor, 'basket', first(factor ORDER BY abs(c) DESC, child_order), NULL, bool_and(c IS NOT NULL) FROM eval_basket GROUP BY 1, 2
""")
def _(spark, d):
    before = cut_lineage(cells(spark, d), "cells")
    layers = K.shock_layers(K.inject_shocks(before, SHOCKS), retail(), SHOCKS, TARGETS)
    return K.evaluate_targets(layers).select("truth_id", "expected_factor", "node", "first_factor", "rank", "conserved")


@query("ag14_rates", f"""
SELECT COUNT(*) AS total, {r_sql('AVG(top1_hit::INT)')} AS top1_rate, {r_sql('AVG(top3_hit::INT)')} AS top3_rate,
       {r_sql('list_sort(list(relative_error) FILTER (WHERE relative_error IS NOT NULL))[COUNT(relative_error) // 2 + 1]')} AS median_relative_error, {r_sql('MAX(relative_error)')} AS max_relative_error, bool_and(conserved) AS all_conserved
FROM eval_cases
""")
def _(spark, d):
    rows = K.evaluation_summary(evaluated(spark, d))
    return rows.select("total", *[r(c).alias(c) for c in ("top1_rate", "top3_rate", "median_relative_error", "max_relative_error")], "all_conserved")


#: Wrong causes by construction: a factor of a slice that sells least over the whole history.
NEGATIVES = (("least_channel", "orders", ("channel",)), ("least_region", "basket", ("region",)), ("least_segment", "price_per_unit", ("segment",)),
             ("least_pair", "lines_per_order", ("channel", "region")))

cte("least", "SELECT " + ", ".join(
    f"(SELECT arg_min({dim}, s) FROM (SELECT {dim}, SUM(revenue_cents) AS s FROM v GROUP BY 1)) AS {dim}" for dim in DIMS))
cte("neg_list", " UNION ALL ".join(
    f"SELECT '{i}' AS hypothesis_id, '{f}' AS factor, 'down' AS direction, "
    + ", ".join(f"{dim if dim in dims else 'CAST(NULL AS VARCHAR)'} AS h_{dim}" for dim in DIMS) + " FROM least"
    for i, f, dims in NEGATIVES))
chain("neg", "neg_list", "day BETWEEN (SELECT e - 41 FROM last28) AND (SELECT e FROM last28)",
      "day BETWEEN (SELECT CAST(s - CAST(e - s + 1 AS INT) AS DATE) FROM last28) AND (SELECT s - 1 FROM last28)",
      "day BETWEEN (SELECT s FROM last28) AND (SELECT e FROM last28)")


def negatives(spark, d):
    """The run of labelled wrong causes, tested on the last 28 days of the data against the 28 before."""
    # One row: the bounds of the newest window set the literals of the plan.
    bounds = last_days(stored_cube(spark, d), (28,)).first()
    current = Period(bounds["start_day"].isoformat(), bounds["end_day"].isoformat())

    def cases(cube):
        least = {dim: cube.groupBy(dim).agg(F.sum("revenue_cents").alias("s")).agg(F.min(F.struct("s", dim))[dim]).scalar() for dim in DIMS}
        rows = F.array(*[F.struct(
            F.lit(i).alias("hypothesis_id"), F.lit(f).alias("factor"), F.lit("down").alias("direction"),
            F.create_map(*[x for dim in dims for x in (F.lit(dim), F.array(least[dim]))]).alias("dims")) for i, f, dims in NEGATIVES])
        return spark.range(1).select(F.inline(rows)).withColumn("slice_id", V.canonical_slice(F.col("dims")))

    return stored_run(
        spark, d, "negatives", lambda cube: cases(cube).select("slice_id", "dims").dropDuplicates(["slice_id"]), base=current.previous(), current=current,
        observed=current.trailing(H.OBSERVATION_DAYS), build_hypotheses=cases)


def negative_cases(spark, d):
    return negatives(spark, d).verdicts


@query("el2_negative_cases", f"SELECT hypothesis_id, slice_id, factor, verify_status, verdict, accepted, reason, {r_sql('final', 4)} AS confidence FROM neg_final")
def _(spark, d):
    rows = negative_cases(spark, d)
    verified = F.when(F.col("verify_status") == "insufficient", 0.0).otherwise(F.col("confidence"))
    counter = F.when(F.col("direction_ok") == F.lit(False), F.greatest(F.lit(0.0), verified - H.COUNTER_PENALTY)).otherwise(verified)
    return rows.select("hypothesis_id", "slice_id", "factor", "verify_status", "verdict", "accepted", "reason", r(counter, 4).alias("confidence"))


@query("el2_acceptance", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE accepted) AS accepted, {r_sql('AVG(accepted::INT)')} AS accept_rate, COUNT(*) FILTER (WHERE reason <> '') AS cases_with_reason,
       AVG(accepted::INT) <= 0.10 AS passed FROM neg_final
""")
def _(spark, d):
    return K.acceptance_summary(negative_cases(spark, d)).withColumn("accept_rate", r("accept_rate"))


@query("el3_history", """
SELECT year(month) * 100 + month(month) AS id, 'run ' || strftime(month, '%Y-%m') AS label, CASE WHEN month(month) % 2 = 0 THEN 'attribution' ELSE 'negatives' END AS dataset,
       CAST(orders AS BIGINT) AS total, CASE WHEN month(month) % 2 = 0 THEN round(lines / units, 4) END AS top1_rate, CASE WHEN month(month) % 2 = 1 THEN round(orders / lines, 4) END AS accept_rate
FROM month_sums WHERE slice_id = 'all'
""")
def _(spark, d):
    """Stored runs as JSON, one per month of the data."""
    cube = orders_cube(spark, d, measures=("orders", "lines", "units"))
    month = cube.groupBy(F.trunc("day", "month").alias("month")).agg(*[F.sum(c).cast("double").alias(c) for c in ("orders", "lines", "units")])
    even = F.month("month") % 2 == 0
    runs = month.select(
        (F.year("month") * 100 + F.month("month")).cast("long").alias("id"), F.concat(F.lit("run "), F.date_format("month", "yyyy-MM")).alias("label"),
        F.when(even, "attribution").otherwise("negatives").alias("dataset"),
        F.to_json(F.struct(F.col("orders").cast("long").alias("total"), F.when(even, F.round(F.col("lines") / F.col("units"), 4)).alias("top1_rate"),
                           F.when(~even, F.round(F.col("orders") / F.col("lines"), 4)).alias("accept_rate"))).alias("metrics_json"))
    return K.evaluation_history(runs)
