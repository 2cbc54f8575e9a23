"""Streaming twins of the daily fact, the scores and the event match."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltatree.plans.common import cte, query, r, r_sql
from deltatree.sources.facts import SCHEMAS, table
from deltatree.streaming import daily as S

# A day is closed when the watermark (newest row minus one day) has passed its end.
cte("es_daily", """
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY 1, 2
""")
cte("es_closed", "SELECT * FROM es_daily WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)")
cte("es_base", "SELECT event_type, AVG(n) AS mean_n, stddev_pop(n) AS sigma_n FROM es_daily GROUP BY 1")
cte("es_best", "SELECT event_type, day FROM es_daily QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value_cents DESC, day) <= 3")


def stream(spark, d):
    rows = S.read_events(spark, d, "events.parquet", SCHEMAS["events"])
    return S.daily_fact(rows, ["event_type"], "value")


def batch_daily(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))


@query("st1_daily_stream", "SELECT day, event_type, n, value_cents FROM es_closed")
def _(spark, d):
    return S.run_to_end(stream(spark, d), "st1")


@query("st2_scored_stream", f"""
SELECT day, event_type, n, {r_sql('(n - mean_n) / NULLIF(sigma_n, 0)')} AS z_score, COALESCE(abs((n - mean_n) / NULLIF(sigma_n, 0)) > 2, FALSE) AS is_anomaly
FROM es_closed JOIN es_base USING (event_type)
""")
def _(spark, d):
    baseline = batch_daily(spark, d).groupBy("event_type").agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("sigma_n"))
    rows = S.run_to_end(S.score_days(stream(spark, d), baseline, ["event_type"]), "st2")
    return rows.select("day", "event_type", "n", r("z_score").alias("z_score"), "is_anomaly")


@query("st3_matched_stream", f"""
SELECT window_id, event_id, CAST(gap AS INT) AS gap, {r_sql('0.6 + 0.4 * CASE WHEN gap = 0 THEN 1.0 ELSE 1.0 - gap / 3.0 END::DOUBLE')} AS relevance, 'chain' AS tier FROM (
 SELECT c.event_type || '@' || CAST(c.day AS VARCHAR) AS window_id, CAST(year(b.day) * 10000 + month(b.day) * 100 + day(b.day) AS BIGINT) AS event_id,
  CASE WHEN b.day + 1 < c.day THEN c.day - (b.day + 1) WHEN b.day - 1 > c.day THEN (b.day - 1) - c.day ELSE 0 END AS gap
 FROM es_closed c JOIN es_best b USING (event_type)) WHERE gap <= 3
""")
def _(spark, d):
    """Calendar: the three best days of each event type, one day wider on both sides."""
    from pyspark.sql import Window

    order = Window.partitionBy("event_type").orderBy(F.col("value_cents").desc(), "day")
    best = batch_daily(spark, d).withColumn("i", F.row_number().over(order)).where(F.col("i") <= 3)
    calendar = best.select(
        (F.year("day") * 10000 + F.month("day") * 100 + F.dayofmonth("day")).cast("long").alias("event_id"),
        F.date_sub("day", 1).alias("start_day"), F.date_add("day", 1).alias("end_day"),
        F.create_map(F.lit("event_type"), F.array("event_type")).alias("dims"))
    rows = S.match_closed_days(stream(spark, d), calendar, ("event_type",), "event_type", "st3")
    return rows.select("window_id", "event_id", "gap", r("relevance").alias("relevance"), "tier")
