"""A business calendar which Spark derives from the sales history.

Per month and channel, the best day becomes an event around that day. Events of
even months also name the region which sold most. November events have no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltatree.plans.common import cte, orders_cube


def derived_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = orders_cube(spark, sf_dir, ("channel", "region"), measures=("revenue_cents",))
    month = F.trunc("day", "month")
    days = cube.groupBy(month.alias("month"), "channel", "day").agg(F.sum("revenue_cents").alias("s"))
    # At most 31 rows and as many rows as there are regions per group.
    best = days.groupBy("month", "channel").agg(
        F.min(F.struct((-F.col("s")).alias("s"), F.col("day").alias("day")))["day"].alias("day")
    )
    regions = cube.groupBy(month.alias("month"), "channel", "region").agg(F.sum("revenue_cents").alias("s"))
    lead = regions.groupBy("month", "channel").agg(
        F.min(F.struct((-F.col("s")).alias("s"), F.col("region").alias("region")))["region"].alias("region")
    )
    m = F.month("month")
    digit = F.substring("channel", 1, 1).cast("int")
    both = F.create_map(F.lit("channel"), F.array("channel"), F.lit("region"), F.array("region"))
    one = F.create_map(F.lit("channel"), F.array("channel"))
    return best.join(lead, ["month", "channel"]).select(
        ((F.year("month") * 100 + m) * 10 + digit).cast("long").alias("event_id"),
        F.concat_ws("@", "channel", F.date_format("month", "yyyy-MM")).alias("name"),
        F.element_at(F.array(F.lit("promotion"), F.lit("policy"), F.lit("cost_shock")), m % 3 + 1).alias("type"),
        F.date_sub("day", 1).alias("start_day"),
        F.when(m != 11, F.date_add("day", 2)).alias("end_day"),
        F.when(m % 2 == 0, both).otherwise(one).alias("dims"),
        F.concat(F.lit("best day "), F.col("day").cast("string")).alias("note"),
        F.when((m == 5) & (F.col("channel") == "5-LOW"), F.col("day")).alias("deleted_at"),
    )


cte("ev_days", """
SELECT CAST(date_trunc('month', day) AS DATE) AS month, channel, day, SUM(revenue_cents) AS s
FROM v GROUP BY 1, 2, 3
""")
cte("ev_regions", """
SELECT CAST(date_trunc('month', day) AS DATE) AS month, channel, region, SUM(revenue_cents) AS s
FROM v GROUP BY 1, 2, 3
""")
cte("ev_best", """
SELECT month, channel, day FROM ev_days
QUALIFY row_number() OVER (PARTITION BY month, channel ORDER BY s DESC, day) = 1
""")
cte("ev_lead", """
SELECT month, channel, region FROM ev_regions
QUALIFY row_number() OVER (PARTITION BY month, channel ORDER BY s DESC, region) = 1
""")
cte("ev_all", """
SELECT CAST((year(month) * 100 + month(month)) * 10 + CAST(substr(channel, 1, 1) AS INT) AS BIGINT) AS event_id,
       channel || '@' || strftime(month, '%Y-%m') AS name,
       CASE month(month) % 3 WHEN 0 THEN 'promotion' WHEN 1 THEN 'policy' ELSE 'cost_shock' END AS type,
       day - 1 AS start_day,
       CASE WHEN month(month) <> 11 THEN day + 2 END AS end_day,
       channel AS ev_channel,
       CASE WHEN month(month) % 2 = 0 THEN region END AS ev_region,
       CASE WHEN month(month) = 5 AND channel = '5-LOW' THEN day END AS deleted_at
FROM ev_best JOIN ev_lead USING (month, channel)
""")
cte("ev", "SELECT * FROM ev_all WHERE deleted_at IS NULL")
