"""Drill-down of the total, every channel, a pair of regions and a slice without free dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.operators import drilldown as L
from deltatree.plans.common import BASE, CURRENT, amount, amount_sql, cte, query, r, r_sql, retail
from deltatree.plans.statistics import DIMS, channel_slices, in_period, stored_run

TOP = 2


def drilled_slices(cube):
    ends = cube.agg(*[f(d).alias(f"{d}{i}") for d in DIMS for i, f in enumerate((F.min, F.max))])
    pair = ends.select(F.lit("pair").alias("slice_id"), F.create_map(F.lit("region"), F.array_distinct(F.array("region0", "region1"))).alias("dims"))
    locked = ends.select(F.lit("locked").alias("slice_id"), F.create_map(*[x for d in DIMS for x in (F.lit(d), F.array(f"{d}0"))]).alias("dims"))
    return channel_slices(cube).select("slice_id", "dims").unionByName(pair).unionByName(locked)


def drilled(spark, d):
    """The run, and its stored drill-down."""
    run = stored_run(spark, d, "drilled", drilled_slices)

    def build():
        slices = run.slices.where("asked AND status = 'ok'")
        return L.drilldown(run.cube, slices, L.pivot_plans(slices, retail(), DIMS), retail(), BASE, CURRENT, DIMS, TOP)

    return run, run.store.stage("drilldown", build, ("slice_id", "pivot"))


cte("dr_rows", """
SELECT 'all' AS slice_id, ['channel', 'region', 'segment'] AS pivots, v.* FROM v
UNION ALL SELECT 'channel=' || channel, ['region', 'segment'], v.* FROM v
UNION ALL SELECT 'pair', ['channel', 'segment'], v.* FROM v WHERE region IN ((SELECT MIN(region) FROM v), (SELECT MAX(region) FROM v))
UNION ALL SELECT 'locked', ['channel', 'region', 'segment'], v.* FROM v
 WHERE channel = (SELECT MIN(channel) FROM v) AND region = (SELECT MIN(region) FROM v) AND segment = (SELECT MIN(segment) FROM v)
""")
cte("dr_sums", f"""
SELECT slice_id, by_dims, by_dims || '=' || CASE by_dims WHEN 'channel' THEN channel WHEN 'region' THEN region ELSE segment END AS combination,
  COALESCE(CAST(SUM(revenue_cents) FILTER (WHERE {in_period(BASE)}) AS DOUBLE), 0) AS base, COALESCE(CAST(SUM(revenue_cents) FILTER (WHERE {in_period(CURRENT)}) AS DOUBLE), 0) AS current,
  COUNT(*) FILTER (WHERE {in_period(BASE)}) AS n0, COUNT(*) FILTER (WHERE {in_period(CURRENT)}) AS n1
FROM (SELECT *, unnest(pivots) AS by_dims FROM dr_rows WHERE {in_period(BASE)} OR {in_period(CURRENT)}) GROUP BY ALL
""")
cte("dr_table", """
SELECT *, row_number() OVER (PARTITION BY slice_id, by_dims ORDER BY abs(contribution) DESC, combination) AS rank,
  SUM(contribution) OVER (PARTITION BY slice_id, by_dims) AS total, SUM(abs(contribution)) OVER (PARTITION BY slice_id, by_dims) AS everything
FROM (SELECT *, current - base AS contribution FROM dr_sums)
""")


@query("dc15_drilldown", f"""
SELECT slice_id, by_dims, combination, base, current, contribution, CAST(rank AS INT) AS rank, rank <= {TOP} AS in_top, {r_sql('contribution / NULLIF(total, 0)')} AS rate,
  CASE WHEN n0 = 0 THEN 'new' WHEN n1 = 0 THEN 'vanished' ELSE '' END AS note FROM dr_table
""")
def _(spark, d):
    _, table = drilled(spark, d)
    return table.select("slice_id", F.col("pivot").alias("by_dims"), "combination", "base", "current", "contribution", "rank", "in_top", r("rate").alias("rate"), "note")


@query("rp6_drilldown", f"""
SELECT slice_id, by_dims, arg_min(combination, rank) AS largest, {amount_sql('arg_min(contribution, rank)')} AS largest_contribution, first(combination ORDER BY contribution, rank) AS lowest,
  {r_sql(f'COALESCE(SUM(CASE WHEN rank <= {TOP} THEN abs(contribution) END) / NULLIF(MAX(everything), 0), 0)')} AS coverage, COUNT(*) AS combinations FROM dr_table GROUP BY 1, 2
""")
def _(spark, d):
    _, table = drilled(spark, d)
    return L.drilldown_highlights(table).select(
        "slice_id", F.col("pivot").alias("by_dims"), "largest", amount("largest_contribution"), "lowest", r("coverage").alias("coverage"), "combinations")


@query("rp7_drilldown", f"""
SELECT slice_id, 'pivot:' || by_dims AS layer, 'dimension_table' AS source, abs(SUM(contribution) - MAX(delta)) <= 1e-9 * greatest(abs(MAX(delta)), 1) AS passed,
  CASE WHEN MAX(two_sided) THEN abs(SUM(contribution) - MAX(delta)) <= 1e-9 * greatest(abs(MAX(delta)), 1) END AS crossed
 FROM dr_table JOIN (SELECT slice_id, COALESCE(SUM(revenue_cents) FILTER (WHERE {in_period(CURRENT)}), 0) - COALESCE(SUM(revenue_cents) FILTER (WHERE {in_period(BASE)}), 0) AS delta,
   COUNT(*) FILTER (WHERE {in_period(CURRENT)}) > 0 AND COUNT(*) FILTER (WHERE {in_period(BASE)}) > 0 AS two_sided FROM dr_rows GROUP BY 1) USING (slice_id) GROUP BY 1, 2
UNION ALL SELECT slice_id, 'tree:revenue', 'decomposition', TRUE, NULL
 FROM (SELECT slice_id FROM dr_rows GROUP BY 1 HAVING SUM(revenue_cents) FILTER (WHERE {in_period(BASE)}) > 0 AND SUM(revenue_cents) FILTER (WHERE {in_period(CURRENT)}) > 0)
""")
def _(spark, d):
    run, table = drilled(spark, d)
    return L.drilldown_ledger(table, run.contributions, run.pairs, "revenue").drop("relative")
