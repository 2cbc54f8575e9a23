"""Business events near weekly windows, for three slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltatree.operators import calendar as C
from deltatree.plans.calendar import derived_calendar
from deltatree.plans.common import cte, query, r, r_sql
from deltatree.plans.relational import data_weeks
from deltatree.sources.tables import load_events

SCENARIO_DIMS = ("channel", "region", "segment")
WINDOW_SLICES = {
    "all": {}, "urgent": {"channel": ["1-URGENT"]}, "low_asia": {"channel": ["5-LOW"], "region": ["ASIA"]},
}

cte("ev_slices", """
SELECT * FROM (VALUES ('all', NULL, NULL), ('urgent', '1-URGENT', NULL), ('low_asia', '5-LOW', 'ASIA')) t(slice, s_channel, s_region)
""")
cte("ev_overlap", """
SELECT slice, event_id,
  CASE WHEN s_channel IS NULL THEN (1 + CASE WHEN ev_region IS NOT NULL THEN 1 ELSE 0 END) / 3.0::DOUBLE
       ELSE ((CASE WHEN ev_channel = s_channel THEN 1 ELSE 0 END) + (CASE WHEN s_region IS NOT NULL AND ev_region = s_region THEN 1 ELSE 0 END))
            / (CASE WHEN ev_region IS NOT NULL OR s_region IS NOT NULL THEN 2.0 ELSE 1.0 END)::DOUBLE END AS overlap
FROM ev, ev_slices
""")
cte("ev_near", """
SELECT CAST(window_start AS VARCHAR) AS window_start, event_id, start_day,
       CASE WHEN end_day < window_start THEN window_start - end_day WHEN start_day > window_end THEN start_day - window_end ELSE 0 END AS gap
FROM weeks JOIN ev ON start_day <= window_end + 3 AND (end_day IS NULL OR end_day >= window_start - 3)
""")
cte("ev_match", """
SELECT *, CASE WHEN round(relevance, 12) >= 0.5 THEN 'chain' WHEN round(relevance, 12) >= 0.3 THEN 'watch' END AS tier FROM (
 SELECT slice || '@' || window_start AS window_id, event_id, start_day, overlap, proximity, 0.6 * overlap + 0.4 * proximity AS relevance FROM (
  SELECT *, CASE WHEN gap = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - gap / 3.0) END::DOUBLE AS proximity FROM ev_near JOIN ev_overlap USING (event_id))
 WHERE overlap > 0)
WHERE round(relevance, 12) >= 0.3
""")


def dims_map(spec):
    pairs = [x for k, codes in spec.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in codes]))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def window_slices(spark, d):
    """Every week of the data, once per slice."""
    options = F.array(*[
        F.struct(F.lit(name).alias("slice"), dims_map(spec).alias("slice_dims")) for name, spec in WINDOW_SLICES.items()])
    weeks = data_weeks(spark, d).select("window_start", "window_end", F.inline(options))
    return weeks.withColumn("window_id", F.concat_ws("@", "slice", F.col("window_start").cast("string")))


def matches(spark, d):
    events = load_events(spark, derived_calendar(spark, d))
    return C.match_events(window_slices(spark, d), events, SCENARIO_DIMS)


@query("ev1_overlap", f"SELECT slice, event_id, {r_sql('overlap')} AS overlap FROM ev_overlap")
def _(spark, d):
    events = load_events(spark, derived_calendar(spark, d))
    options = F.array(*[
        F.struct(F.lit(name).alias("slice"), dims_map(spec).alias("slice_dims")) for name, spec in WINDOW_SLICES.items()])
    rows = events.select("event_id", "dims", F.inline(options))
    return rows.select("slice", "event_id", r(C.dimension_overlap(F.col("dims"), F.col("slice_dims"), SCENARIO_DIMS)).alias("overlap"))


@query("ev2_proximity", f"""
SELECT window_start AS window_id, event_id, CAST(gap AS INT) AS gap, {r_sql("CASE WHEN gap = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - gap / 3.0) END::DOUBLE")} AS proximity FROM ev_near
""")
def _(spark, d):
    events = load_events(spark, derived_calendar(spark, d))
    near = C.events_near(data_weeks(spark, d), events)
    return near.select("window_id", "event_id", "gap", r(C.time_proximity(F.col("gap"))).alias("proximity"))


@query("ev3_match", f"SELECT window_id, event_id, {r_sql('overlap')} AS overlap, {r_sql('proximity')} AS proximity, {r_sql('relevance')} AS relevance, tier FROM ev_match")
def _(spark, d):
    return matches(spark, d).select("window_id", "event_id", *[r(c).alias(c) for c in ("overlap", "proximity", "relevance")], "tier")


@query("ev4_causal_chain", "SELECT window_id, event_id, TRUE AS is_exogenous FROM ev_match WHERE tier = 'chain'")
def _(spark, d):
    return C.causal_chain(matches(spark, d)).select("window_id", "event_id", "is_exogenous")


@query("so3_relevance_order", """
SELECT window_id, event_id, CAST(row_number() OVER (PARTITION BY window_id ORDER BY round(relevance, 9) DESC, start_day, event_id) AS INT) AS rank FROM ev_match
""")
def _(spark, d):
    """Order inside each window; the events near one week are few."""
    order = Window.partitionBy("window_id").orderBy(F.round("relevance", 9).desc(), "start_day", "event_id")
    return C.ordered_matches(matches(spark, d)).select("window_id", "event_id", F.row_number().over(order).alias("rank"))
