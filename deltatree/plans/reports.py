"""Conclusions, action lists and report rows for the total and every channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.operators import anomaly as A
from deltatree.operators import calendar as C
from deltatree.operators import decompose as D
from deltatree.operators import hypotheses as H
from deltatree.operators import drilldown as L
from deltatree.operators import report as R
from deltatree.operators import values as V
from deltatree.operators import whatif as W
from deltatree.plans.anomaly import band_chain
from deltatree.plans.calendar import derived_calendar
from deltatree.plans.common import CURRENT, BASE, amount, amount_sql, cte, orders_cube, query, r, r_sql, retail
from deltatree.plans import drilldown  # noqa: F401  its subqueries come before those of the report
from deltatree.plans.events import SCENARIO_DIMS
from deltatree.plans.statistics import DIMS, channels, in_period
from deltatree.plans.whatif import price_pairs, with_base
from deltatree.session import cut_lineage
from deltatree.sources.tables import load_events

SETS = ((), ("channel",))
TOP_CODES = 5
#: Report rows whose value is in cents.
MONEY_ROWS = ("label IN ('base', 'current', 'change', 'main cause', 'further cause') OR segment = 'contributions' AND label NOT LIKE '%/%' AND label <> 'largest residual' "
              "OR segment = 'drilldown' AND label NOT LIKE 'coverage%'")

# factor, knob, action, owner, cycle, adjustment to look up
PLAYBOOK = (
    ("orders", "lines_mix", "call the customers whose orders stopped", "account managers", "every month", 0.20),
    ("price_per_unit", "avg_price", "review the list prices of the parts that sell most", "price desk", "every quarter", -0.10),
)

band_chain("rpb", CURRENT)

cte("rp_events", f"""
SELECT slice_id, event_id, name, CASE WHEN round(relevance, 12) >= 0.5 THEN 'chain' WHEN round(relevance, 12) >= 0.3 THEN 'watch' END AS tier FROM (
 SELECT slice_id, event_id, name, 0.6 * overlap + 0.4 * CASE WHEN gap = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - gap / 3.0) END::DOUBLE AS relevance FROM (
  SELECT s.slice_id, e.event_id, e.name,
   CASE WHEN s.channel IS NULL THEN (1 + CASE WHEN ev_region IS NOT NULL THEN 1 ELSE 0 END) / 3.0::DOUBLE
        ELSE (CASE WHEN ev_channel = s.channel THEN 1 ELSE 0 END) / (CASE WHEN ev_region IS NOT NULL THEN 2.0 ELSE 1.0 END)::DOUBLE END AS overlap,
   CASE WHEN end_day < DATE '{CURRENT.start}' THEN DATE '{CURRENT.start}' - end_day WHEN start_day > DATE '{CURRENT.end}' THEN start_day - DATE '{CURRENT.end}' ELSE 0 END AS gap
  FROM ev e, (SELECT NULL AS channel, 'all' AS slice_id UNION ALL SELECT DISTINCT channel, 'channel=' || channel FROM v) s)
 WHERE gap <= 3 AND overlap > 0) WHERE round(relevance, 12) >= 0.3
""")
cte("rp_causes", """
SELECT COALESCE('channel=' || channel, 'all') AS slice_id, factor, child_order, contribution, delta, r0, r1, contribution / NULLIF(delta, 0) AS rate,
       row_number() OVER (PARTITION BY channel ORDER BY abs(contribution) DESC, child_order) AS rank FROM hy_contrib
""")


def near_events(spark, d, slices):
    windows = slices.select(
        F.col("slice_id").alias("window_id"), F.col("dims").alias("slice_dims"),
        F.lit(CURRENT.start).cast("date").alias("window_start"), F.lit(CURRENT.end).cast("date").alias("window_end"))
    found = C.match_events(windows, load_events(spark, derived_calendar(spark, d)), SCENARIO_DIMS)
    return found.select(F.col("window_id").alias("slice_id"), "event_id", "name", "tier")


def price_curve(cube):
    est = with_base(W.estimate(price_pairs(cube, SETS), ["slice_id"]), cube)
    points = W.curve(est, ["slice_id", "base_value"]).where(F.col("reason") == "")
    ratio = {c: F.col(c) / F.col("base_value") for c in ("expected", "expected_low", "expected_high")}
    return est, points.select("slice_id", F.lit("avg_price").alias("knob"), "adjustment", *[v.alias(k) for k, v in ratio.items()])


def playbook(spark):
    return spark.createDataFrame(list(PLAYBOOK), "factor string, knob string, action string, owner string, cycle string, wanted double")


def actions(spark, contributions, points):
    top = D.top_factors(contributions.where(F.col("contribution").isNotNull()), ["slice_id"], 3)
    return R.action_list(top.select("slice_id", "factor", "rank", "contribution"), playbook(spark), points)


@query("hy6_conclusion", f"""
SELECT c.slice_id, MAX(factor) FILTER (WHERE rank = 1) AS primary_cause, {amount_sql('MAX(contribution) FILTER (WHERE rank = 1)')} AS primary_contribution,
  string_agg(factor, ',' ORDER BY rank) FILTER (WHERE rank > 1) AS secondary_causes,
  COALESCE((SELECT string_agg(f.factor, ',' ORDER BY f.factor) FROM hy_final f WHERE f.slice_id = c.slice_id AND f.status = 'verified'), '') AS verified_factors,
  COALESCE((SELECT string_agg(f.factor, ',' ORDER BY f.factor) FROM hy_final f WHERE f.slice_id = c.slice_id AND f.status <> 'verified'), '') AS excluded_factors,
  COALESCE((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT concat_ws(': ', f.factor, f.status, NULLIF(f.reason, '')) AS t FROM hy_final f WHERE f.slice_id = c.slice_id AND f.status <> 'verified')), '') AS excluded_reasons,
  COALESCE((SELECT string_agg(DISTINCT e.name, ',' ORDER BY e.name) FROM rp_events e WHERE e.slice_id = c.slice_id AND e.tier = 'chain'), '') AS exogenous_events
FROM rp_causes c GROUP BY 1
""")
def _(spark, d):
    run = channels(spark, d)
    rows = H.conclude(run.contributions, run.verdicts, near_events(spark, d, run.slices), "revenue")
    lists = ("secondary_causes", "verified_factors", "excluded_factors", "excluded_reasons", "exogenous_events")
    return rows.select("slice_id", "primary_cause", amount("primary_contribution"), *[F.array_join(c, ",").alias(c) for c in lists])


cte("rp_points", """
SELECT slice_id, 'avg_price' AS knob, adjustment, expected / base_value AS expected, expected_low / base_value AS expected_low, expected_high / base_value AS expected_high
FROM wi_curve WHERE reason = '' AND slice_id NOT LIKE '%&%'
""")
_book = ", ".join(f"('{f}', '{k}', '{a}', '{o}', '{c}', {w}::DOUBLE)" for f, k, a, o, c, w in PLAYBOOK)
cte("rp_actions", f"""
SELECT c.slice_id, c.factor, c.rank, c.contribution, b.knob, b.action, b.owner, b.cycle, p.adjustment, p.expected, p.expected_low, p.expected_high,
       CASE WHEN b.action IS NULL THEN 'no_template' WHEN p.expected IS NULL THEN 'no_curve' ELSE 'range' END AS range_status
FROM rp_causes c LEFT JOIN (VALUES {_book}) b(factor, knob, action, owner, cycle, wanted) ON b.factor = c.factor
LEFT JOIN rp_points p ON p.slice_id = c.slice_id AND p.knob = b.knob
QUALIFY row_number() OVER (PARTITION BY c.slice_id, c.factor ORDER BY abs(p.adjustment - b.wanted), p.adjustment) = 1
""")


@query("jn13_playbook_curve", f"SELECT slice_id, factor, knob, adjustment, {r_sql('expected')} AS expected FROM rp_actions")
def _(spark, d):
    cube = cut_lineage(orders_cube(spark, d, ("channel", "region")), "cube")
    contributions = D.decompose(V.period_values(cube, retail(), BASE, CURRENT, SETS), retail(), ["slice_id"])
    _, points = price_curve(cube)
    return actions(spark, contributions, points).select("slice_id", "factor", "knob", "adjustment", r("expected").alias("expected"))


@query("rp5_actions", f"""
SELECT slice_id, CAST(rank AS INT) AS rank, factor, action, owner, cycle, range_status, {r_sql('expected_low')} AS expected_low, {r_sql('expected_high')} AS expected_high FROM rp_actions
""")
def _(spark, d):
    cube = cut_lineage(orders_cube(spark, d, ("channel", "region")), "cube")
    contributions = D.decompose(V.period_values(cube, retail(), BASE, CURRENT, SETS), retail(), ["slice_id"])
    _, points = price_curve(cube)
    return actions(spark, contributions, points).select(
        "slice_id", "rank", "factor", "action", "owner", "cycle", "range_status",
        r("expected_low").alias("expected_low"), r("expected_high").alias("expected_high"))


@query("rp2_cross_check", """
SELECT COALESCE('channel=' || channel, 'all') AS slice_id, r1 - r0 AS tree_delta, delta AS anomaly_delta, r1 - r0 = delta AS passed
FROM hy_sums s JOIN rpb_change c ON c.slice_id = COALESCE('channel=' || s.channel, 'all') AND c.code = 'revenue'
""")
def _(spark, d):
    """Change of the root from the factor tree and from the anomaly path."""
    cube = orders_cube(spark, d, ("channel",))
    rows = D.decompose(V.period_values(cube, retail(), BASE, CURRENT, SETS), retail(), ["slice_id"])
    tree = rows.groupBy("slice_id").agg(F.sum("contribution").alias("delta"))
    changes, _ = A.node_changes(cube, retail(), CURRENT, sets=SETS)
    checked = R.cross_check(tree, changes.where(F.col("code") == "revenue"), ["slice_id"])
    return checked.select("slice_id", F.round("tree_delta").alias("tree_delta"), "anomaly_delta", "passed")


def amount_text_sql(e):
    return f"COALESCE(format('{{:,}} cents', CAST(round({e}) AS BIGINT)), '-')"


def rate_text_sql(e):
    return f"COALESCE(printf('%+.1f%%', ({e}) * 100), '-')"


def number_text_sql(e, digits=3):
    return f"COALESCE(printf('%.{digits}f', {e}), '-')"


cte("rp_deep", f"""
SELECT COALESCE('channel=' || channel, 'all') AS slice_id, unnest(['lines_per_order', 'units_per_line']) AS factor, unnest([0, 1]) AS child_order, u1 / o1 - u0 / o0 AS delta,
  unnest([lm * (ln(l1 / o1) - ln(l0 / o0)), lm * (ln(u1 / l1) - ln(u0 / l0))]) AS contribution FROM (
 SELECT *, CASE WHEN u1 / o1 = u0 / o0 THEN u1 / o1 ELSE (u1 / o1 - u0 / o0) / (ln(u1 / o1) - ln(u0 / o0)) END AS lm FROM hy_sums JOIN (
  SELECT channel, CAST(COUNT(*) FILTER (WHERE {in_period(BASE)}) AS DOUBLE) AS l0, CAST(COUNT(*) FILTER (WHERE {in_period(CURRENT)}) AS DOUBLE) AS l1
  FROM v GROUP BY GROUPING SETS ((), (channel))) n ON n.channel IS NOT DISTINCT FROM hy_sums.channel)
""")
cte("rp_drill", "SELECT *, (list_position(['channel', 'region', 'segment'], by_dims) * 100) AS first FROM dr_table WHERE slice_id NOT IN ('pair', 'locked')")
_adjust = "CASE WHEN adjustment = 0 THEN 'unchanged' ELSE printf('%+.0f%%', adjustment * 100) END"
_covered = f"SUM(abs(contribution)) FILTER (WHERE rank <= {TOP_CODES}) / NULLIF(MAX(everything), 0)"
cte("rp_tests", "SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY factor) * 10 AS first FROM hy_final")
cte("rp_rows", f"""
SELECT slice_id, 1 AS segment_index, 'background' AS segment, 1 AS position, 'base' AS label, base AS value, {amount_text_sql('base')} AS display FROM rpb_verdicts WHERE code = 'revenue' AND basis = 'daily_mean'
UNION ALL SELECT slice_id, 1, 'background', 2, 'current', current, {amount_text_sql('current')} FROM rpb_verdicts WHERE code = 'revenue' AND basis = 'daily_mean'
UNION ALL SELECT slice_id, 1, 'background', 3, 'change', delta, {amount_text_sql('delta')} FROM rpb_verdicts WHERE code = 'revenue' AND basis = 'daily_mean'
UNION ALL SELECT slice_id, 1, 'background', 4, 'change rate', change_rate, {rate_text_sql('change_rate')} FROM rpb_verdicts WHERE code = 'revenue' AND basis = 'daily_mean'
UNION ALL SELECT slice_id, 1, 'background', 5, 'z-score', z, CASE WHEN inside THEN 'inside the band' ELSE 'outside the band' END FROM rpb_verdicts WHERE code = 'revenue' AND basis = 'daily_mean'
UNION ALL SELECT slice_id, 2, 'contributions', child_order + 1, factor, contribution, {rate_text_sql('rate')} FROM rp_causes
UNION ALL SELECT slice_id, 2, 'contributions', 90, 'largest residual', 0.0, 'passed in all 2 layers' FROM rp_deep WHERE child_order = 0
UNION ALL SELECT slice_id, 2, 'contributions', 100 + child_order, 'basket/' || factor, contribution, {rate_text_sql('contribution / NULLIF(delta, 0)')} FROM rp_deep
UNION ALL SELECT slice_id, 3, 'drilldown', first + rank, combination, contribution, {rate_text_sql('contribution / NULLIF(total, 0)')} FROM rp_drill WHERE rank <= {TOP_CODES}
UNION ALL SELECT slice_id, 3, 'drilldown', first + 90, 'coverage of ' || by_dims, {_covered}, {rate_text_sql(_covered)} FROM rp_drill GROUP BY slice_id, by_dims, first
UNION ALL SELECT slice_id, 3, 'drilldown', first + 91, 'change of all ' || by_dims, MAX(total), {amount_text_sql('MAX(total)')} FROM rp_drill GROUP BY slice_id, by_dims, first
UNION ALL SELECT slice_id, 4, 'conclusions', rank, CASE WHEN rank = 1 THEN 'main cause' ELSE 'further cause' END, contribution, factor FROM rp_causes WHERE rank <= 3
UNION ALL SELECT slice_id, 4, 'conclusions', 10, 'verified hypotheses', COUNT(*) FILTER (WHERE status = 'verified'), CAST(COUNT(*) FILTER (WHERE status = 'verified') AS VARCHAR) || ' of ' || COUNT(*) FROM hy_final GROUP BY 1
UNION ALL SELECT slice_id, 4, 'conclusions', 11, 'outside events', COUNT(*) FILTER (WHERE tier = 'chain'), string_agg(name, ', ' ORDER BY name) FILTER (WHERE tier = 'chain') FROM rp_events GROUP BY 1 HAVING COUNT(*) FILTER (WHERE tier = 'chain') > 0
UNION ALL SELECT slice_id, 5, 'evidence', first, factor, p_value, status || ': ' || verdict FROM rp_tests
UNION ALL SELECT slice_id, 5, 'evidence', first + 1, factor || ' sample', n_in + n_out, CAST(n_in AS VARCHAR) || ' days against ' || CAST(n_out AS VARCHAR) FROM rp_tests
UNION ALL SELECT slice_id, 5, 'evidence', first + 2, factor || ' effect', effect, {number_text_sql('effect', 2)} FROM rp_tests
UNION ALL SELECT slice_id, 5, 'evidence', first + 3, factor || ' confidence', lowered, reason FROM rp_tests
UNION ALL SELECT slice_id, 6, 'whatif', 1, 'elasticity', value, method FROM wi_est WHERE slice_id NOT LIKE '%&%'
UNION ALL SELECT slice_id, 6, 'whatif', 2, 'confidence', CASE WHEN value IS NOT NULL THEN trust END, CAST(n AS VARCHAR) || ' days' FROM wi_est WHERE slice_id NOT LIKE '%&%'
UNION ALL SELECT slice_id, 6, 'whatif', 10 + CAST(round(adjustment * 100) AS INT) + 30, {_adjust}, expected, {number_text_sql('expected_low')} || ' to ' || {number_text_sql('expected_high')} FROM rp_points
UNION ALL SELECT slice_id, 7, 'actions', rank, factor, expected, COALESCE(action || ' / ' || owner || ' / ' || cycle, 'no template') || ' / ' || range_status FROM rp_actions
""")


def segments(spark, d):
    """All rows of the report, a stage of the run like the others."""
    run = channels(spark, d)
    return run.store.stage("report", lambda: report_segments(spark, d, run), ("slice_id",))


def report_segments(spark, d, run):
    cube, slices, contributions, final = run.cube, run.slices, run.contributions, run.verdicts
    anomaly = A.anomalies(cube, retail(), CURRENT, sets=SETS).where(F.col("code") == "revenue")
    background = R.segment_rows(anomaly, "background", [
        R.field(1, F.lit("base"), F.col("base"), R.amount_text(F.col("base"))),
        R.field(2, F.lit("current"), F.col("current"), R.amount_text(F.col("current"))),
        R.field(3, F.lit("change"), F.col("delta"), R.amount_text(F.col("delta"))),
        R.field(4, F.lit("change rate"), F.col("change_rate"), R.rate_text(F.col("change_rate"))),
        R.field(5, F.lit("z-score"), F.col("z_score"), F.when(F.col("in_normal_band"), "inside the band").otherwise("outside the band")),
    ])
    at_root = F.col("node") == retail().root.code
    split = R.segment_rows(contributions.where(at_root), "contributions", [
        R.field(F.col("child_order") + 1, F.col("factor"), F.col("contribution"), R.rate_text(F.col("rate")))])
    # values of deeper nodes are in the node's own unit, not in cents
    deep = R.segment_rows(contributions.where(~at_root), "contributions", [
        R.field(F.col("child_order") + 100, F.concat_ws("/", "node", "factor"), F.col("contribution"), R.rate_text(F.col("rate")))])
    layers = contributions.groupBy("slice_id").agg(
        F.count_distinct("node").alias("n"), F.max("relative").alias("relative"), F.min("conserved").alias("conserved"))
    residual = R.segment_rows(layers, "contributions", [R.field(90, F.lit("largest residual"), F.round("relative", 9), F.when(
        F.col("conserved"), F.concat(F.lit("passed in all "), F.col("n").cast("string"), F.lit(" layers"))).otherwise("not passed"))])
    usable = slices.where("asked AND status = 'ok'")
    table = run.store.stage("drilldown", lambda: L.drilldown(
        cube, usable, L.pivot_plans(usable, retail(), DIMS), retail(), BASE, CURRENT, DIMS, TOP_CODES), ("slice_id", "pivot"))
    first = F.array_position(F.array(*[F.lit(n) for n in retail().dimensions]), F.col("pivot")).cast("int") * 100
    drill = R.segment_rows(table.where("in_top"), "drilldown", [
        R.field(first + F.col("rank"), F.col("combination"), F.col("contribution"), R.rate_text(F.col("rate")))])
    whole = table.groupBy("slice_id", "pivot").agg(F.max("coverage").alias("covered"), F.max("layer_delta").alias("moved"))
    cover = R.segment_rows(whole, "drilldown", [
        R.field(first + 90, F.concat(F.lit("coverage of "), "pivot"), F.col("covered"), R.rate_text(F.col("covered"))),
        R.field(first + 91, F.concat(F.lit("change of all "), "pivot"), F.col("moved"), R.amount_text(F.col("moved")))])
    contributions = contributions.where(at_root)
    top = D.top_factors(contributions.where(F.col("contribution").isNotNull()), ["slice_id"], 3)
    causes = R.segment_rows(top, "conclusions", [R.field(
        F.col("rank"), F.when(F.col("rank") == 1, "main cause").otherwise("further cause"), F.col("contribution"), F.col("factor"))])
    counted = final.groupBy("slice_id").agg(F.count_if(F.col("status") == "verified").alias("n"), F.count(F.lit(1)).alias("m"))
    tested = R.segment_rows(counted, "conclusions", [R.field(
        10, F.lit("verified hypotheses"), F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("m").cast("string")))])
    chain = near_events(spark, d, slices).where(F.col("tier") == "chain").groupBy("slice_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    outside = R.segment_rows(chain, "conclusions", [R.field(11, F.lit("outside events"), F.col("n"), F.col("names"))])
    # A slice has at most five hypotheses.
    from pyspark.sql import Window

    numbered = final.withColumn("i", F.row_number().over(Window.partitionBy("slice_id").orderBy("factor")))
    place = F.col("i") * 10
    days = F.concat(F.col("n_in").cast("string"), F.lit(" days against "), F.col("n_out").cast("string"))
    evidence = R.segment_rows(numbered, "evidence", [
        R.field(place, F.col("factor"), F.col("p_value"), F.concat_ws(": ", "status", "verdict")),
        R.field(place + 1, F.concat(F.col("factor"), F.lit(" sample")), F.col("n_in") + F.col("n_out"), days),
        R.field(place + 2, F.concat(F.col("factor"), F.lit(" effect")), F.col("effect"), R.number_text(F.col("effect"), 2)),
        R.field(place + 3, F.concat(F.col("factor"), F.lit(" confidence")), F.col("final_confidence"), F.col("reason"))])
    est, points = price_curve(cube)
    points = cut_lineage(points, "points")
    elastic = R.segment_rows(est, "whatif", [
        R.field(1, F.lit("elasticity"), F.col("value"), F.col("method")),
        R.field(2, F.lit("confidence"), F.col("confidence"), F.concat(F.col("n").cast("string"), F.lit(" days")))])
    name = F.when(F.col("adjustment") == 0, "unchanged").otherwise(F.format_string("%+.0f%%", F.col("adjustment") * 100))
    steps = R.segment_rows(points, "whatif", [R.field(
        F.round(F.col("adjustment") * 100).cast("int") + 40, name, F.col("expected"),
        F.concat(R.number_text(F.col("expected_low")), F.lit(" to "), R.number_text(F.col("expected_high"))))])
    todo = actions(spark, contributions, points)
    acts = R.segment_rows(todo, "actions", [R.field(
        F.col("rank"), F.col("factor"), F.col("expected"),
        F.concat(F.coalesce(F.concat_ws(" / ", "action", "owner", "cycle"), F.lit("")), F.lit(" / "), F.col("range_status")))])
    acts = acts.withColumn("display", F.when(F.col("display").startswith(" / "), F.concat(F.lit("no template"), "display")).otherwise(F.col("display")))
    return R.report_rows([background, split, residual, deep, drill, cover, causes, tested, outside, evidence, elastic, steps, acts])


@query("rp1_report", f"""
SELECT slice_id, segment_index, segment, CAST(position AS INT) AS position, label, {amount_sql('value', MONEY_ROWS)} AS value, display FROM rp_rows
""")
def _(spark, d):
    return segments(spark, d).withColumn("value", amount("value", money=F.expr(MONEY_ROWS)))


@query("rp3_flatten", "SELECT slice_id, segment_index, segment, label, display FROM rp_rows")
def _(spark, d):
    return R.flatten_report(R.nested_report(segments(spark, d)))


@query("rp4_checksum", """
SELECT slice_id, sha256(string_agg(t, '' ORDER BY segment_index, position, label, t)) AS checksum, COUNT(*) AS n_fields FROM (
 SELECT slice_id, segment_index, CAST(position AS INT) AS position, label,
  array_to_string(list_transform([CAST(segment_index AS VARCHAR), CAST(CAST(position AS INT) AS VARCHAR), label, printf('%.4f', CAST(value AS DOUBLE)), display],
   lambda x: CASE WHEN x IS NULL THEN '-' ELSE length(x) || ':' || x END), '') AS t FROM rp_rows)
GROUP BY 1
""")
def _(spark, d):
    return R.content_checksum(segments(spark, d))
