"""Tests on daily series, hypotheses and the checks against spurious ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions import scalar as S
from deltatree.functions.replicates import PERMUTATIONS
from deltatree.operators import hypotheses as H
from deltatree.operators import inference as I
from deltatree.operators import values as V
from deltatree.operators.attribution import Attribution
from deltatree.operators.whatif import align
from deltatree.session import runs_path, scratch_path
from deltatree.sources.store import RunStore, read_results, source_mark, write_results
from deltatree.plans.anomaly import SUMS, in_period, long_nodes
from deltatree.plans.common import (
    in_money, in_money_sql, BASE, CURRENT, OBSERVED, WHATIF, amount, amount_sql, cte, lines_cube, orders_cube, query, r, r_sql,
    retail, span,
)

DIMS = ("channel", "region", "segment")
ALL_SETS = [s for n in range(4) for s in combinations(DIMS, n)]

# --- rank statistics on price and revenue per channel -----------------------

cte("xy", f"""
SELECT channel, day, CAST(revenue_cents AS DOUBLE) / units AS x, CAST(revenue_cents AS DOUBLE) AS y FROM daily_channel WHERE {in_period(WHATIF)}
""")
cte("xy_ranks", """
SELECT *, rank() OVER (PARTITION BY channel ORDER BY x) + (COUNT(*) OVER (PARTITION BY channel, x) - 1) / 2.0::DOUBLE AS rx,
       rank() OVER (PARTITION BY channel ORDER BY lines) + (COUNT(*) OVER (PARTITION BY channel, lines) - 1) / 2.0::DOUBLE AS ry
FROM xy JOIN (SELECT channel, day, lines FROM daily_channel) USING (channel, day)
""")


def xy(spark, d):
    cube = orders_cube(spark, d, ("channel",), WHATIF)
    price = V.daily_series(cube, retail().find("price_per_unit"), ("channel",))
    return align(V.daily_series(cube, retail().root, ("channel",)), price, ("channel",))


def price_and_lines(spark, d):
    """Price against the number of lines: whole numbers, so the ranks have ties."""
    cube = orders_cube(spark, d, ("channel",), WHATIF)
    price = V.daily_series(cube, retail().find("price_per_unit"), ("channel",))
    lines = V.daily_series(cube, F.sum("lines").cast("double"), ("channel",))
    return align(lines, price, ("channel",))


@query("in1_ranks", "SELECT channel, day, ry AS rank_y, rx AS rank_x FROM xy_ranks")
def _(spark, d):
    ranks = I.average_ranks(I.average_ranks(price_and_lines(spark, d), ["channel"], "x", "rank_x"), ["channel"], "y", "rank_y")
    return ranks.select("channel", "day", "rank_x", "rank_y")


@query("in2_spearman", f"SELECT channel, COUNT(*) AS n, {r_sql('corr(rx, ry)')} AS rho FROM xy_ranks GROUP BY 1")
def _(spark, d):
    return I.spearman(price_and_lines(spark, d), ["channel"]).select("channel", "n", r("rho").alias("rho"))


cte("in3_rows", """
SELECT channel, CAST(rx * 2 AS BIGINT) AS a, CAST(ry * 2 AS BIGINT) AS b, row_number() OVER (PARTITION BY channel ORDER BY day) - 1 AS i FROM xy_ranks
""")
cte("in3_tot", """
SELECT channel, COUNT(*) AS n, SUM(a) AS sa, SUM(b) AS sb, SUM(a * b) AS sab, corr(a, b) AS rho FROM in3_rows GROUP BY 1
""")
cte("in3_lists", "SELECT channel, list(a ORDER BY i) AS la, list(b ORDER BY i) AS lb FROM in3_rows GROUP BY 1")
cte("in3_ext", f"""
SELECT channel, COUNT(*) FILTER (WHERE abs(n * p - sa * sb) >= abs(n * sab - sa * sb)) AS extreme FROM (
 SELECT channel, n, sa, sb, sab, list_sum(list_transform(range(len(la)), lambda j: la[j + 1] * lb[(o[j + 1] & 1048575) + 1])) AS p FROM (
  SELECT *, list_sort(list_transform(range(len(la)), lambda i: ({R.position_sql("row", "i")} << 20) | i)) AS o FROM (
   SELECT *, {R.row_sql("channel", "rep")} AS row FROM in3_lists JOIN in3_tot USING (channel), (SELECT unnest(range({PERMUTATIONS})) AS rep) WHERE n >= 8)))
GROUP BY 1
""")


@query("in3_permutation_correlation", f"""
SELECT channel, n, {r_sql('rho')} AS statistic, (extreme + 1) / {PERMUTATIONS + 1}::DOUBLE AS p_value, 'ok' AS status FROM in3_tot JOIN in3_ext USING (channel)
""")
def _(spark, d):
    rows = I.permutation_correlation(price_and_lines(spark, d), ["channel"], PERMUTATIONS)
    return rows.select("channel", "n", r("statistic").alias("statistic"), "p_value", "status")


# --- slices against the whole -----------------------------------------------

def chain(p: str, hyps: str, observed: str, base: str, current: str) -> None:
    """Subqueries of the hypothesis tests for the hypotheses of subquery ``hyps``.

    ``hyps`` has hypothesis_id, factor, direction and one nullable code per dimension.
    """
    name = "COALESCE(NULLIF(concat_ws('&', 'channel=' || {0}channel, 'region=' || {0}region, 'segment=' || {0}segment), ''), 'all')"
    cte(f"{p}_osum", f"SELECT day, {name.format('')} AS slice_id, {SUMS} FROM v WHERE {observed} GROUP BY GROUPING SETS ((day), (day, channel), (day, region), (day, segment), (day, channel, region), (day, channel, segment), (day, region, segment), (day, channel, region, segment))")
    cte(f"{p}_obs", f"SELECT slice_id, day, code AS factor, value FROM ({long_nodes(f'{p}_osum', 'day, slice_id')}) WHERE value IS NOT NULL")
    cte(f"{p}_move", f"""SELECT {name.format('')} AS slice_id, CAST(SUM(revenue_cents) FILTER (WHERE {current}) AS DOUBLE) - CAST(SUM(revenue_cents) FILTER (WHERE {base}) AS DOUBLE) AS delta
FROM v WHERE ({base}) OR ({current}) GROUP BY GROUPING SETS ((), (channel), (region), (segment), (channel, region), (channel, segment), (region, segment), (channel, region, segment))""")
    cte(f"{p}_hyp", f"""SELECT *, {name.format('h_')} AS slice_id,
 CASE WHEN h_channel IS NULL THEN 'channel' WHEN h_region IS NULL THEN 'region' WHEN h_segment IS NULL THEN 'segment' END AS free FROM {hyps}""")
    cte(f"{p}_codes", " UNION ALL ".join(
        f"SELECT '{dim}' AS dim, {dim} AS code, row_number() OVER (ORDER BY {dim}) AS position FROM (SELECT DISTINCT {dim} FROM v) QUALIFY position <= 3"
        for dim in DIMS))
    sub = "COALESCE(NULLIF(concat_ws('&', 'channel=' || {c}, 'region=' || {r}, 'segment=' || {s}), ''), 'all')"
    with_code = sub.format(c="COALESCE(h_channel, CASE WHEN free = 'channel' THEN code END)",
                           r="COALESCE(h_region, CASE WHEN free = 'region' THEN code END)",
                           s="COALESCE(h_segment, CASE WHEN free = 'segment' THEN code END)")
    cte(f"{p}_tests", f"""
SELECT hypothesis_id || '/verify/' AS test_id, hypothesis_id, 'verify' AS kind, '' AS code, factor, slice_id AS in_slice, 'all' AS out_slice FROM {p}_hyp
UNION ALL SELECT hypothesis_id || '/control/' || code, hypothesis_id, 'control', code, factor, {with_code}, slice_id FROM {p}_hyp JOIN {p}_codes ON dim = free
UNION ALL SELECT hypothesis_id || '/placebo/' || code, hypothesis_id, 'placebo', code, factor, dim || '=' || code, slice_id FROM {p}_hyp JOIN {p}_codes ON dim = free WHERE position = 3
""")
    chain_tests(p)
    cte(f"{p}_dev", f"""
SELECT slice_id, factor, n_days, CASE WHEN n_days >= 5 AND s > 0 THEN first_far END AS deviation_day FROM (
 SELECT slice_id, factor, COUNT(*) AS n_days, MAX(s) AS s, MIN(CASE WHEN abs(value - m) > 1.5 * s THEN i END) AS first_far FROM (
  SELECT *, AVG(value) OVER w AS m, stddev_pop(value) OVER w AS s, row_number() OVER (PARTITION BY slice_id, factor ORDER BY day) AS i
  FROM {p}_obs WHERE slice_id IN (SELECT slice_id FROM {p}_hyp) WINDOW w AS (PARTITION BY slice_id, factor)) GROUP BY 1, 2)
""")
    cte(f"{p}_chk", f"""
SELECT v.hypothesis_id, 1 AS step_order, 'sample' AS step, CASE WHEN gap IS NULL THEN 'passed' ELSE 'insufficient_evidence' END AS verdict, 0.0::DOUBLE AS penalty FROM {p}_ver v
UNION ALL SELECT h.hypothesis_id, 2, 'control', CASE WHEN b.p IS NULL THEN 'skipped' WHEN b.p >= 0.10 THEN 'common_driver' ELSE 'passed' END, 0.0
 FROM {p}_hyp h LEFT JOIN (SELECT hypothesis_id, first(p_value ORDER BY abs(effect) DESC, code) AS p FROM {p}_res WHERE kind = 'control' AND p_value IS NOT NULL AND effect IS NOT NULL GROUP BY 1) b USING (hypothesis_id)
UNION ALL SELECT h.hypothesis_id, 3, 'precedence', CASE WHEN f.deviation_day > t.deviation_day THEN 'cause_after_effect' WHEN f.deviation_day <= t.deviation_day THEN 'passed' ELSE 'skipped' END,
  CASE WHEN f.deviation_day > t.deviation_day THEN 0.3 ELSE 0.0 END
 FROM {p}_hyp h LEFT JOIN {p}_dev f ON f.slice_id = h.slice_id AND f.factor = h.factor LEFT JOIN {p}_dev t ON t.slice_id = h.slice_id AND t.factor = 'revenue'
UNION ALL SELECT h.hypothesis_id, 4, 'placebo', CASE WHEN q.p_value IS NULL OR q.effect IS NULL THEN 'skipped'
  WHEN q.p_value < 0.05 AND (ref IS NULL OR abs(q.effect) >= 0.8 * ref) THEN 'trend_driver' ELSE 'passed' END, 0.0
 FROM {p}_hyp h LEFT JOIN (SELECT * FROM {p}_res WHERE kind = 'placebo') q USING (hypothesis_id)
 LEFT JOIN (SELECT hypothesis_id, CASE WHEN gap IS NULL THEN abs(effect) END AS ref FROM {p}_ver) e USING (hypothesis_id)
""")
    cte(f"{p}_verd", f"""
SELECT hypothesis_id, COALESCE(last_hard, CASE WHEN penalty > 0 THEN 'passed_with_penalty' ELSE 'passed' END) AS verdict, penalty, COALESCE(reasons, '') AS reasons, last_hard IS NOT NULL AS excluded FROM (
 SELECT hypothesis_id, arg_max(verdict, step_order) FILTER (WHERE hard) AS last_hard, SUM(penalty) AS penalty,
        string_agg(step || ':' || verdict, ';' ORDER BY step_order) FILTER (WHERE hard OR penalty > 0) AS reasons
 FROM (SELECT *, verdict IN ('insufficient_evidence', 'common_driver', 'trend_driver') AS hard FROM {p}_chk) GROUP BY 1)
""")
    cte(f"{p}_final", f"""
SELECT *, CASE WHEN excluded OR (penalty > 0 AND round(lowered, 12) < 0.6) THEN 'excluded' ELSE verify_status END AS status,
       concat_ws(';', NULLIF(verify_reason, ''), NULLIF(reasons, '')) AS reason, verify_status = 'verified' AND NOT excluded AS accepted
FROM (SELECT v.* EXCLUDE (status, reason), v.status AS verify_status, v.reason AS verify_reason, verdict, penalty, reasons, excluded,
  CASE WHEN NOT excluded AND penalty > 0 THEN greatest(0.0, final - penalty) ELSE final END AS lowered
 FROM {p}_ver v JOIN {p}_verd USING (hypothesis_id))
""")


def chain_tests(p: str) -> None:
    """Subqueries of the tests in ``{p}_tests`` over the series in ``{p}_obs``, up to the verification of ``{p}_hyp``."""
    cte(f"{p}_pool", f"""
SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY g, day) - 1 AS i FROM (
 SELECT test_id, 0 AS g, day, value FROM {p}_tests t JOIN {p}_obs o ON o.slice_id = in_slice AND o.factor = t.factor
 UNION ALL SELECT test_id, 1, day, value FROM {p}_tests t JOIN {p}_obs o ON o.slice_id = out_slice AND o.factor = t.factor)
""")
    cte(f"{p}_grp", f"""
SELECT *, CASE WHEN n_in >= 3 AND n_out >= 3 THEN (mean_in - mean_out) / NULLIF(sqrt(((n_in - 1) * var_in + (n_out - 1) * var_out) / (n_in + n_out - 2)), 0) END AS effect
FROM (SELECT test_id, COUNT(*) FILTER (WHERE g = 0) AS n_in, COUNT(*) FILTER (WHERE g = 1) AS n_out,
 AVG(value) FILTER (WHERE g = 0) AS mean_in, AVG(value) FILTER (WHERE g = 1) AS mean_out, var_samp(value) FILTER (WHERE g = 0) AS var_in,
 var_samp(value) FILTER (WHERE g = 1) AS var_out, SUM(value) FILTER (WHERE g = 0) AS sum_in, SUM(value) AS sum_all FROM {p}_pool GROUP BY 1)
""")
    cte(f"{p}_lists", f"SELECT test_id, list(value ORDER BY i) AS vals FROM {p}_pool GROUP BY 1")
    cte(f"{p}_ext", f"""
SELECT test_id, COUNT(*) FILTER (WHERE abs(lft * (n_in + n_out) - sum_all * n_in) >= obs - {I.ROUNDING} * greatest(1, obs)) AS extreme FROM (
 SELECT test_id, abs(sum_in * (n_in + n_out) - sum_all * n_in) AS obs, n_in, n_out, sum_all, sum_in, list_sum(list_transform(list_sort(list_transform(range(len(vals)), lambda i: ({R.position_sql("row", "i")} << 20) | i))[1:n_in],
        lambda x: vals[(x & 1048575) + 1])) AS lft FROM (
  SELECT *, {R.row_sql("test_id", "rep")} AS row FROM {p}_lists JOIN {p}_grp USING (test_id), (SELECT unnest(range({PERMUTATIONS})) AS rep) WHERE n_in >= 8 AND n_out >= 8))
GROUP BY 1
""")
    cte(f"{p}_res", f"""
SELECT test_id, hypothesis_id, kind, code, factor, COALESCE(n_in, 0) AS n_in, COALESCE(n_out, 0) AS n_out, mean_in, mean_out, effect, extreme,
       (extreme + 1) / {PERMUTATIONS + 1}::DOUBLE AS p_value
FROM {p}_tests LEFT JOIN {p}_grp USING (test_id) LEFT JOIN {p}_ext USING (test_id)
""")
    cte(f"{p}_conf", f"""
SELECT *, 0.40 * sig + 0.35 * eff + 0.25 * cov AS confidence FROM (
 SELECT *, CASE WHEN p_value < 0.01 THEN 1.0 WHEN p_value < 0.05 THEN 0.7 WHEN p_value < 0.10 THEN 0.4 WHEN p_value IS NOT NULL THEN 0.0 END::DOUBLE AS sig,
  CASE WHEN abs(effect) <= 0.2 THEN 0.2 WHEN abs(effect) >= 0.8 THEN 1.0 WHEN effect IS NOT NULL THEN 0.2 + (abs(effect) - 0.2) / 0.6 * 0.8 END::DOUBLE AS eff,
  least(1.0, greatest(0.0, n_in / 21.0::DOUBLE)) AS cov FROM {p}_res WHERE kind = 'verify')
""")
    cte(f"{p}_ver", f"""
SELECT *, CASE WHEN gap IS NOT NULL THEN 'insufficient' WHEN small OR round(final, 12) < 0.6 THEN 'excluded' ELSE 'verified' END AS status,
       COALESCE(gap, concat_ws(',', CASE WHEN small THEN 'small_share' END, CASE WHEN round(final, 12) < 0.6 THEN 'low_confidence' END, CASE WHEN against THEN 'counter_example' END)) AS reason
FROM (SELECT *, COALESCE(share < 0.05, FALSE) AS small,
  CASE WHEN gap IS NOT NULL THEN 0.0 WHEN against THEN greatest(0.0, confidence - 0.15) ELSE confidence END AS final
 FROM (SELECT h.hypothesis_id, h.slice_id, h.factor, h.direction, n_in, n_out, mean_in, mean_out, effect, p_value, sig, eff, cov, confidence,
   abs(m.delta) / NULLIF(abs((SELECT delta FROM {p}_move WHERE slice_id = 'all')), 0) AS share,
   (CASE WHEN mean_in >= mean_out THEN 'up' ELSE 'down' END) <> h.direction AS against,
   CASE WHEN n_in < 3 OR n_out < 3 THEN 'few_days' WHEN p_value IS NULL OR effect IS NULL THEN 'undefined' WHEN n_in + n_out < 60 OR n_in < 21 THEN 'thin_sample' END AS gap
  FROM {p}_hyp h JOIN {p}_conf c USING (hypothesis_id) LEFT JOIN {p}_move m ON m.slice_id = h.slice_id))
""")


cte("hy_sums", f"""
SELECT channel, CAST(COUNT(DISTINCT order_id) FILTER (WHERE {in_period(BASE)}) AS DOUBLE) AS o0, CAST(COUNT(DISTINCT order_id) FILTER (WHERE {in_period(CURRENT)}) AS DOUBLE) AS o1,
 CAST(SUM(units) FILTER (WHERE {in_period(BASE)}) AS DOUBLE) AS u0, CAST(SUM(units) FILTER (WHERE {in_period(CURRENT)}) AS DOUBLE) AS u1,
 CAST(SUM(revenue_cents) FILTER (WHERE {in_period(BASE)}) AS DOUBLE) AS r0, CAST(SUM(revenue_cents) FILTER (WHERE {in_period(CURRENT)}) AS DOUBLE) AS r1
FROM v WHERE {in_period(span(BASE, CURRENT))} GROUP BY GROUPING SETS ((), (channel))
""")
cte("hy_contrib", """
SELECT channel, unnest(['orders', 'basket', 'price_per_unit']) AS factor, unnest([0, 1, 2]) AS child_order, r1 - r0 AS delta, r0, r1,
  unnest([lm * (ln(o1) - ln(o0)), lm * (ln(u1 / o1) - ln(u0 / o0)), lm * (ln(r1 / u1) - ln(r0 / u0))]) AS contribution
FROM (SELECT *, CASE WHEN r1 = r0 THEN r1 ELSE (r1 - r0) / (ln(r1) - ln(r0)) END AS lm FROM hy_sums WHERE r0 > 0 AND r1 > 0)
""")
cte("hy_list", """
SELECT COALESCE('channel=' || channel, 'all') || '/' || factor AS hypothesis_id, factor, CASE WHEN contribution < 0 THEN 'down' ELSE 'up' END AS direction,
  channel AS h_channel, CAST(NULL AS VARCHAR) AS h_region, CAST(NULL AS VARCHAR) AS h_segment, contribution,
  row_number() OVER (PARTITION BY channel ORDER BY abs(contribution) DESC, child_order) AS rank
FROM hy_contrib
""")
chain("hy", "hy_list", in_period(OBSERVED), in_period(BASE), in_period(CURRENT))


#: What the cube of the runs is read from.
SOURCES = ("lineitem", "orders", "customer", "nation", "region")


def run_store(spark, d, name):
    """The store of a run of this application over the tables as they are: changed files give another run."""
    return RunStore(spark, runs_path(spark), "retail", f"{name}-{source_mark(spark, [f'{d}/{t}.parquet' for t in SOURCES])}")


def stored_cube(spark, d, dims=DIMS):
    """The daily cube of some dimensions, written once for all runs."""
    return run_store(spark, d, "cubes").stage("-".join(dims), lambda: orders_cube(spark, d, dims), ("day",))


def stored_run(spark, d, name, build_slices, dims=DIMS, base=BASE, current=CURRENT, observed=OBSERVED, **more):
    """A run whose stages are committed once, whichever query asks first."""
    return Attribution(run_store(spark, d, name), retail(), base, current, observed, dims, lambda: stored_cube(spark, d, dims), build_slices, **more)


def channel_slices(cube):
    """The total and one slice per channel that occurs."""
    codes = cube.select("channel").distinct()
    each = codes.select(F.create_map(F.lit("channel"), F.array("channel")).alias("dims"))
    total = cube.sparkSession.createDataFrame([({},)], each.schema)
    return each.unionByName(total).withColumn("slice_id", V.canonical_slice(F.col("dims")))


def channels(spark, d):
    """The run of the total and every channel."""
    return stored_run(spark, d, "channels", channel_slices, targets=("basket",))


def fresh_results(run, *kinds):
    """The tests of some kinds, carried out anew."""
    tests = run.tests.where(F.col("kind").isin(*kinds))
    return H.run_tests(tests, H.sides_series(H.test_sides(tests), run.series), PERMUTATIONS)


KIND = "WHERE kind = 'verify'"


@query("in4_permutation_difference", f"""
SELECT hypothesis_id, n_in, n_out, {amount_sql('mean_in - mean_out', in_money_sql('factor'))} AS statistic, p_value FROM hy_res {KIND}
""")
def _(spark, d):
    return fresh_results(channels(spark, d), "verify").select(
        "hypothesis_id", "n_in", "n_out", amount(F.col("mean_in") - F.col("mean_out"), "statistic", in_money("factor")), "p_value")


@query("in5_p_value", f"""
SELECT test_id AS key, extreme, p_value FROM hy_res WHERE kind <> 'verify'
UNION ALL SELECT channel, extreme, (extreme + 1) / {PERMUTATIONS + 1}::DOUBLE FROM in3_ext
""")
def _(spark, d):
    results = fresh_results(channels(spark, d), "control", "placebo")
    pairs = I.permutation_correlation(price_and_lines(spark, d), ["channel"], PERMUTATIONS)
    return results.select(F.col("test_id").alias("key"), "extreme", "p_value").unionByName(
        pairs.select(F.col("channel").alias("key"), "extreme", "p_value"))


def simple_groups(spark, d):
    """Every channel's days against the days of all channels, for each metric: no replicates."""
    run = channels(spark, d)
    cube, slices = run.cube, run.slices.select("slice_id", "dims")
    hyps = slices.withColumn("factor", F.explode(F.array(F.lit("orders"), F.lit("basket"), F.lit("price_per_unit"))))
    series = H.slice_series(cube, retail(), slices, OBSERVED, DIMS)
    inside = hyps.join(series, ["slice_id", "factor"]).select("slice_id", "factor", F.lit("in").alias("side"), "day", "value")
    whole = series.where(F.col("slice_id") == "all").select("factor", "day", "value")
    outside = hyps.select("slice_id", "factor").join(whole, "factor").select("slice_id", "factor", F.lit("out").alias("side"), "day", "value")
    return inside.unionByName(outside)


@query("in6_effect", f"""
SELECT slice_id, factor, n_in, n_out, {r_sql('effect')} AS effect FROM hy_res r JOIN (SELECT hypothesis_id, slice_id FROM hy_hyp) USING (hypothesis_id) {KIND}
""")
def _(spark, d):
    groups = I.standardized_difference(I.two_groups(simple_groups(spark, d), ["slice_id", "factor"]))
    return groups.select("slice_id", "factor", "n_in", "n_out", r("effect").alias("effect"))


@query("in7_risk_difference", f"""
SELECT sku, {r_sql('b')} AS base_rate, {r_sql('c')} AS current_rate, {r_sql('c - b')} AS difference FROM (
 SELECT sku, COUNT(*) FILTER (WHERE status = 'R' AND {in_period(BASE)})::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE {in_period(BASE)}), 0) AS b,
        COUNT(*) FILTER (WHERE status = 'R' AND {in_period(CURRENT)})::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE {in_period(CURRENT)}), 0) AS c
 FROM v WHERE {in_period(span(BASE, CURRENT))} GROUP BY 1)
""")
def _(spark, d):
    cube = lines_cube(spark, d, ("sku", "status"), span(BASE, CURRENT), ("lines",))
    rates = []
    for period, name in ((BASE, "b"), (CURRENT, "c")):
        inside = period.holds(F.col("day"))
        rates.append(S.ratio(F.sum(F.when(inside & (F.col("status") == "R"), F.col("lines")).otherwise(0)),
                             F.sum(F.when(inside, F.col("lines")).otherwise(0))).alias(name))
    rows = cube.groupBy("sku").agg(*rates)
    return rows.select("sku", r("b").alias("base_rate"), r("c").alias("current_rate"),
                       r(S.risk_difference(F.col("c"), F.col("b"))).alias("difference"))


@query("in8_direction", """
SELECT slice_id, round(COALESCE(greatest(up, down)::DOUBLE / NULLIF(up + down, 0), 0), 6) AS consistency FROM (
 SELECT slice_id, COUNT(*) FILTER (WHERE r1 > r0) AS up, COUNT(*) FILTER (WHERE r1 < r0) AS down FROM mp GROUP BY 1)
""")
def _(spark, d):
    from deltatree.plans.decomposition import retail_pairs

    pairs = retail_pairs(spark, d)
    return pairs.groupBy("slice_id").agg(r(S.direction_consistency(F.col("c_revenue") - F.col("b_revenue"))).alias("consistency"))


def scores(spark, d):
    return I.with_confidence(channels(spark, d).results.where(F.col("kind") == "verify"), H.COVERAGE_DAYS)


@query("in9_significance", "SELECT hypothesis_id, p_value, sig AS score FROM hy_conf")
def _(spark, d):
    return scores(spark, d).select("hypothesis_id", "p_value", F.col("significance_score").alias("score"))


@query("in10_effect_score", f"SELECT hypothesis_id, {r_sql('eff')} AS score FROM hy_conf")
def _(spark, d):
    groups = I.standardized_difference(I.two_groups(simple_groups(spark, d), ["slice_id", "factor"]))
    return groups.select(F.concat_ws("/", "slice_id", "factor").alias("hypothesis_id"), r(S.effect_score(F.col("effect"))).alias("score"))


@query("in11_coverage", f"SELECT hypothesis_id, n_in, {r_sql('cov')} AS score FROM hy_conf")
def _(spark, d):
    groups = I.two_groups(simple_groups(spark, d), ["slice_id", "factor"])
    return groups.select(F.concat_ws("/", "slice_id", "factor").alias("hypothesis_id"), "n_in",
                         r(S.coverage_score(F.col("n_in"), F.lit(H.COVERAGE_DAYS))).alias("score"))


@query("in12_confidence", f"""
SELECT hypothesis_id, {r_sql('sig', 4)} AS significance_score, {r_sql('eff', 4)} AS effect_score, {r_sql('cov', 4)} AS coverage_score, {r_sql('confidence', 4)} AS confidence FROM hy_conf
""")
def _(spark, d):
    return scores(spark, d).select("hypothesis_id", *[r(c, 4).alias(c) for c in (
        "significance_score", "effect_score", "coverage_score", "confidence")])


# --- hypotheses -------------------------------------------------------------

@query("hy1_candidates", f"""
SELECT hypothesis_id, slice_id, factor, CAST(rank AS INT) AS rank, {amount_sql('contribution')} AS contribution, direction,
       factor || ' in slice ' || slice_id || ' drives revenue' AS statement,
       'days of ' || factor || ' in slice ' || slice_id || ' against those of all rows: the mean is ' || CASE direction WHEN 'down' THEN 'lower' ELSE 'higher' END AS verification,
       'codes of ' || CASE WHEN slice_id = 'all' THEN 'channel' ELSE 'region' END || ' that move the other way' AS counter_check,
       CASE factor WHEN 'orders' THEN 'SUM(fact.orders)' WHEN 'basket' THEN 'CAST(SUM(fact.units) AS DOUBLE) / NULLIF(SUM(fact.orders), 0)'
        ELSE 'CAST(SUM(fact.revenue_cents) AS DOUBLE) / NULLIF(SUM(fact.units), 0)' END AS measure_sql FROM hy_hyp
""")
def _(spark, d):
    return channels(spark, d).hypotheses.select("hypothesis_id", "slice_id", "factor", "rank", amount("contribution"), "direction", "statement",
                                             "verification", "counter_check", "measure_sql")


@query("hy2_series", f"""
SELECT test_id, CASE WHEN g = 0 THEN 'in' ELSE 'out' END AS side, day, {amount_sql('value', in_money_sql("split_part(test_id, '/', 2)"))} AS value FROM hy_pool WHERE test_id LIKE '%/verify/'
""")
def _(spark, d):
    run = channels(spark, d)
    tests = run.tests.where(F.col("kind") == "verify")
    rows = H.sides_series(H.test_sides(tests), run.series).withColumn("factor", F.split("test_id", "/")[1])
    return rows.select("test_id", "side", "day", amount("value", money=in_money("factor")))


@query("hy3_verify", f"""
SELECT hypothesis_id, n_in, n_out, p_value, {r_sql('effect')} AS effect, {r_sql('final', 4)} AS final_confidence, status, reason FROM hy_ver
""")
def _(spark, d):
    return channels(spark, d).verified.select("hypothesis_id", "n_in", "n_out", "p_value", r("effect").alias("effect"), r("final_confidence", 4).alias("final_confidence"), "status", "reason")


@query("hy4_direction", f"""
SELECT hypothesis_id, direction, CASE WHEN gap IS NULL THEN NOT against END AS direction_ok, {r_sql('confidence', 4)} AS confidence, {r_sql('final', 4)} AS final_confidence FROM hy_ver
""")
def _(spark, d):
    return channels(spark, d).verified.select("hypothesis_id", "direction", "direction_ok", r("confidence", 4).alias("confidence"), r("final_confidence", 4).alias("final_confidence"))


@query("hy5_share_gate", f"SELECT hypothesis_id, {r_sql('share')} AS share, small AS gated, status FROM hy_ver")
def _(spark, d):
    return channels(spark, d).verified.select("hypothesis_id", r("share").alias("share"), F.coalesce(F.col("share") < H.MIN_SHARE, F.lit(False)).alias("gated"), "status")


def step_sql(step: str) -> str:
    return f"SELECT hypothesis_id, verdict, penalty FROM hy_chk WHERE step = '{step}'"


def step_rows(spark, d, step):
    return channels(spark, d).checks.where(F.col("step") == step).select("hypothesis_id", "verdict", "penalty")


@query("pc1_control", step_sql("control"))
def _(spark, d):
    return step_rows(spark, d, "control")


@query("pc2_precedence", step_sql("precedence"))
def _(spark, d):
    return step_rows(spark, d, "precedence")


@query("pc3_placebo", step_sql("placebo"))
def _(spark, d):
    return step_rows(spark, d, "placebo")


@query("pc4_sample", step_sql("sample"))
def _(spark, d):
    return step_rows(spark, d, "sample")


@query("pc5_first_deviation", "SELECT slice_id, factor, n_days, CAST(deviation_day AS INT) AS deviation_day FROM hy_dev")
def _(spark, d):
    return channels(spark, d).deviations.select("slice_id", "factor", "n_days", "deviation_day")


@query("pc6_combine", "SELECT hypothesis_id, verdict, penalty, reasons, excluded FROM hy_verd")
def _(spark, d):
    return H.combine_checks(channels(spark, d).checks)


@query("pc7_apply", f"SELECT hypothesis_id, verify_status, verdict, status, {r_sql('lowered', 4)} AS final_confidence, accepted, reason FROM hy_final")
def _(spark, d):
    return channels(spark, d).verdicts.select("hypothesis_id", "verify_status", "verdict", "status", r("final_confidence", 4).alias("final_confidence"), "accepted", "reason")


# --- slices of several codes in four dimensions ------------------------------

WIDE = ("channel", "nation", "region", "segment")


def coded_slices(cube):
    """Two kinds of slices with several codes, from the codes that occur, and one that names a code which doesn't.

    For every region: its first three nations, the first and last channel, all segments but the first; and the same for one segment.
    """
    first, last = (cube.agg(f("channel")).scalar() for f in (F.min, F.max))
    segments = cube.agg(F.sort_array(F.collect_set("segment"))).scalar()
    nations = F.slice(F.sort_array(F.collect_set("nation")), 1, 3)

    def dims(chosen):
        return F.map_from_arrays(F.array(*[F.lit(x) for x in WIDE]), F.array(
            F.array_distinct(F.array(first, last)), "nations", F.array("region"), chosen)).alias("dims")

    broad = cube.groupBy("region").agg(nations.alias("nations")).select(
        F.concat(F.lit("broad/"), "region").alias("slice_id"), dims(F.slice(segments, 2, 100)))
    narrow = cube.groupBy("region", "segment").agg(nations.alias("nations")).select(
        F.concat(F.lit("narrow/"), "region", F.lit("/"), "segment").alias("slice_id"), dims(F.array("segment")))
    lost = cube.sparkSession.range(1).select(F.lit("lost").alias("slice_id"), F.create_map(F.lit("channel"), F.array(first, F.lit("no such channel"))).alias("dims"))
    return broad.unionByName(narrow).unionByName(lost)


def coded(spark, d):
    return stored_run(spark, d, "coded", coded_slices, WIDE)


cte("ms", """
SELECT 'broad/' || region AS slice_id, region, NULL AS segment, list_sort(list(DISTINCT nation))[1:3] AS nations FROM v GROUP BY region
UNION ALL SELECT 'narrow/' || region || '/' || segment, region, segment, list_sort(list(DISTINCT nation))[1:3] FROM v GROUP BY region, segment
""")
cte("mv", """
SELECT ms.slice_id, v.* FROM v JOIN ms ON v.region = ms.region AND list_contains(ms.nations, v.nation)
 AND (v.segment = ms.segment OR ms.segment IS NULL AND v.segment > (SELECT MIN(segment) FROM v))
WHERE v.channel IN ((SELECT MIN(channel) FROM v), (SELECT MAX(channel) FROM v))
UNION ALL SELECT 'all', v.* FROM v
""")
cte("ms_sums", "SELECT slice_id, " + ", ".join(
    f"CAST({e} FILTER (WHERE {in_period(when)}) AS DOUBLE) AS {n}{i}"
    for i, when in enumerate((BASE, CURRENT)) for n, e in (("o", "COUNT(DISTINCT order_id)"), ("u", "SUM(units)"), ("r", "SUM(revenue_cents)")))
    + f" FROM mv WHERE {in_period(span(BASE, CURRENT))} GROUP BY 1")
cte("ms_contrib", """
SELECT slice_id, unnest(['orders', 'basket', 'price_per_unit']) AS factor, unnest([0, 1, 2]) AS child_order, r1 - r0 AS delta, status,
  unnest([lm * (ln(o1) - ln(o0)), lm * (ln(u1 / o1) - ln(u0 / o0)), lm * (ln(r1 / u1) - ln(r0 / u0))]) AS contribution
FROM (SELECT *, CASE WHEN r0 IS NULL OR r1 IS NULL THEN 'missing_value' ELSE 'ok' END AS status,
  CASE WHEN r1 = r0 THEN r1 ELSE (r1 - r0) / (ln(r1) - ln(r0)) END AS lm
 FROM (SELECT slice_id FROM ms UNION ALL SELECT 'lost') LEFT JOIN (SELECT slice_id, nullif(o0, 0) AS o0, nullif(o1, 0) AS o1, u0, u1, r0, r1 FROM ms_sums) USING (slice_id))
""")
cte("hym_hyp", """
SELECT slice_id || '/' || factor AS hypothesis_id, slice_id, factor, CASE WHEN contribution < 0 THEN 'down' ELSE 'up' END AS direction FROM ms_contrib WHERE status = 'ok'
""")
cte("hym_osum", f"SELECT day, slice_id, {SUMS} FROM mv WHERE {in_period(OBSERVED)} GROUP BY day, slice_id")
cte("hym_obs", f"SELECT slice_id, day, code AS factor, value FROM ({long_nodes('hym_osum', 'day, slice_id')}) WHERE value IS NOT NULL")
cte("hym_move", "SELECT slice_id, r1 - r0 AS delta FROM ms_sums")
cte("hym_tests", """
SELECT hypothesis_id || '/verify/' AS test_id, hypothesis_id, 'verify' AS kind, '' AS code, factor, slice_id AS in_slice, 'all' AS out_slice FROM hym_hyp
""")
chain_tests("hym")


@query("dc11_slice_table", f"SELECT slice_id, 'revenue' AS node, factor, {amount_sql('contribution')} AS contribution, delta, status FROM ms_contrib")
def _(spark, d):
    return coded(spark, d).contributions.select("slice_id", "node", "factor", amount("contribution"), "delta", "status")


@query("dc17_slice_table", f"""
SELECT slice_id, r1 - r0 AS delta, {r_sql("abs(r1 - r0) / NULLIF(abs((SELECT r1 - r0 FROM ms_sums WHERE slice_id = 'all')), 0)")} AS share
FROM (SELECT slice_id FROM ms UNION ALL SELECT 'lost' UNION ALL SELECT 'all') LEFT JOIN ms_sums USING (slice_id)
""")
def _(spark, d):
    return coded(spark, d).shares.select("slice_id", "delta", r("share").alias("share"))


@query("flt2_slice_status", """
SELECT slice_id, 'ok' AS status FROM ms UNION ALL SELECT 'all', 'ok' UNION ALL SELECT 'lost', 'unknown_code'
""")
def _(spark, d):
    return coded(spark, d).slices.select("slice_id", "status")


@query("hy5_multi_code", f"SELECT hypothesis_id, {r_sql('share')} AS share, small AS gated, n_in, n_out, p_value, status, reason FROM hym_ver")
def _(spark, d):
    return coded(spark, d).verified.select(
        "hypothesis_id", r("share").alias("share"), F.coalesce(F.col("share") < H.MIN_SHARE, F.lit(False)).alias("gated"), "n_in", "n_out", "p_value", "status", "reason")


# --- result rows of a run ----------------------------------------------------

def kept_twice(spark, d, kind, rows, payload):
    """Result rows written, written again as after a failure of the writer, and read back."""
    path, run = scratch_path(spark, "results"), channels(spark, d)
    for _ in range(2):
        write_results(rows(run), path, "retail", "run-1", kind, ("slice_id",))
    return read_results(spark, path, "retail", "run-1", kind, payload)


@query("src7_steps", """
SELECT 'retail' AS scenario, 'run-1' AS run_id, 'step' AS kind, slice_id, 1 AS seq, 'query' AS step, 'completed' AS status, 'basket,revenue' AS nodes, NULL::BIGINT AS count, NULL AS factor, NULL AS verdict FROM hy_hyp GROUP BY slice_id
UNION ALL SELECT 'retail', 'run-1', 'step', slice_id, 2, 'hypothesis', 'completed', NULL, COUNT(*), NULL, NULL FROM hy_hyp GROUP BY slice_id
UNION ALL SELECT 'retail', 'run-1', 'step', slice_id, CAST(2 + rank AS INT), 'verify', status, NULL, NULL, factor, verdict FROM hy_final JOIN (SELECT hypothesis_id, rank FROM hy_hyp) USING (hypothesis_id)
""")
def _(spark, d):
    payload = "seq int, step string, status string, nodes string, residual double, count long, factor string, confidence double, verdict string"
    rows = kept_twice(spark, d, "step", lambda run: run.steps().withColumnRenamed("kind", "step"), payload)
    return rows.drop("residual", "confidence")


@query("src7_hypotheses", f"""
SELECT 'retail' AS scenario, 'run-1' AS run_id, 'hypothesis' AS kind, slice_id, hypothesis_id, factor || ' in slice ' || slice_id || ' drives revenue' AS statement,
       CASE factor WHEN 'orders' THEN 'SUM(fact.orders)' WHEN 'basket' THEN 'CAST(SUM(fact.units) AS DOUBLE) / NULLIF(SUM(fact.orders), 0)'
        ELSE 'CAST(SUM(fact.revenue_cents) AS DOUBLE) / NULLIF(SUM(fact.units), 0)' END AS measure_sql, direction AS expected_direction,
       status, {r_sql('lowered', 4)} AS confidence, reason, {r_sql('sig', 4)} AS significance_score, {r_sql('eff', 4)} AS effect_score, CASE WHEN gap IS NULL THEN NOT against END AS direction_ok, penalty, verdict FROM hy_final
""")
def _(spark, d):
    payload = ("hypothesis_id string, statement string, verification string, counter_check string, measure_sql string, expected_direction string, status string, confidence double, reason string, significance_score double, "
               "effect_score double, coverage_score double, direction_ok boolean, penalty double, verdict string")
    rows = kept_twice(spark, d, "hypothesis", lambda run: run.hypothesis_rows(), payload).drop("coverage_score", "verification", "counter_check")
    return rows.select(*[r(c, 4).alias(c) if c in ("confidence", "significance_score", "effect_score") else c for c in rows.columns])


@query("src7_evidence", f"""
SELECT 'retail' AS scenario, 'run-1' AS run_id, 'evidence' AS kind, slice_id, hypothesis_id, test_id, r.kind AS test_kind, code, n_in + n_out AS sample_size, p_value, {r_sql('effect')} AS effect_size
FROM hy_res r JOIN (SELECT hypothesis_id, slice_id FROM hy_hyp) USING (hypothesis_id)
""")
def _(spark, d):
    payload = ("hypothesis_id string, test_id string, test_kind string, code string, sample_size long, n_in long, n_out long, mean_in double, mean_out double, "
               "p_value double, effect_size double")
    rows = kept_twice(spark, d, "evidence", lambda run: run.evidence_rows(), payload)
    return rows.select("scenario", "run_id", "kind", "slice_id", "hypothesis_id", "test_id", "test_kind", "code", "sample_size", "p_value", r("effect_size").alias("effect_size"))
