"""Daily facts, scores and event matches from a stream of timed rows.

Each has a batch twin. A day is final when the watermark has passed its end, so
append mode emits every closed day once; rows later than the watermark are
dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltatree.operators.calendar import match_events
from deltatree.session import scratch_path

LATENESS = "1 day"


def read_events(spark: SparkSession, folder: str, pattern: str, schema: StructType | str) -> DataFrame:
    """Files of a folder as a stream; a cluster would read a message log the same way."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def instant(local: Column) -> Column:
    """A zoneless time read as UTC, whatever the session zone is: watermarks need an instant."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, local))


def daily_fact(events: DataFrame, keys: Sequence[str], measure: str, lateness: str = LATENESS) -> DataFrame:
    """Rows and whole-cent sums per day and key."""
    timed = events.withColumn("at", instant(F.col("ts"))).withWatermark("at", lateness)
    sums = timed.groupBy(F.window("at", "1 day").alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(measure) * 100).cast("long")).alias("value_cents"))
    number = F.floor(F.unix_seconds("w.start") / 86_400).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), number)
    return sums.select(day.alias("day"), *keys, "n", "value_cents")


def score_days(daily: DataFrame, baseline: DataFrame, keys: Sequence[str], z_threshold: float = 2.0) -> DataFrame:
    """Closed days against a static band (mean and sigma per key)."""
    z = (F.col("n") - F.col("mean_n")) / F.nullif(F.col("sigma_n"), F.lit(0.0))
    return daily.join(baseline, list(keys), "left").withColumn("z_score", z).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > z_threshold, F.lit(False)))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there now, append to files, and read them back.

    The checkpoint lies next to the output in the shared folder, so a restarted
    query goes on where it stopped and writes nothing twice.
    """
    out = scratch_path(stream.sparkSession, name)
    running = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def match_closed_days(daily: DataFrame, calendar: DataFrame, scenario_dims: Sequence[str], key: str, name: str) -> DataFrame:
    """Closed days matched with a static calendar, batch by batch.

    Every micro-batch of closed days is an ordinary DataFrame, so it goes through
    the same matching as a batch job; a batch that is retried replaces its output.
    """
    spark = daily.sparkSession
    out = scratch_path(spark, name)

    def handle(batch: DataFrame, number: int) -> None:
        windows = batch.select(
            F.concat_ws("@", F.col(key), F.col("day").cast("string")).alias("window_id"),
            F.col("day").alias("window_start"), F.col("day").alias("window_end"),
            F.create_map(F.lit(key), F.array(key)).alias("slice_dims"))
        found = match_events(windows, calendar, scenario_dims)
        found.select("window_id", "event_id", "gap", "overlap", "relevance", "tier").write.mode("overwrite").parquet(f"{out}/batch={number}")

    running = (
        daily.writeStream.outputMode("append").foreachBatch(handle)
        .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    schema = "window_id string, event_id long, gap int, overlap double, relevance double, tier string"
    return spark.read.schema(schema).parquet(out).select("window_id", "event_id", "gap", "overlap", "relevance", "tier")
