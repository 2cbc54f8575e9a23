"""Small inputs and outputs: parameter lists, event calendars, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAMETER_SCHEMA = T.StructType([
    T.StructField("param_key", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("captured_on", T.StringType()),
    T.StructField("used_for", T.StringType()),
    T.StructField("note", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("start_day", T.DateType()),
    T.StructField("end_day", T.DateType()),
    T.StructField("dims", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("note", T.StringType()),
    T.StructField("deleted_at", T.DateType()),
])


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Typed parameter list; a value which is not a number fails the job."""
    return spark.read.csv(path, schema=PARAMETER_SCHEMA, header=True, mode="FAILFAST",
                          dateFormat="yyyy-MM-dd")


def write_parameters(df: DataFrame, path: str) -> str:
    columns = [f.name for f in PARAMETER_SCHEMA]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
    return path


def load_events(spark: SparkSession, source: str | DataFrame, fmt: str = "json") -> DataFrame:
    """Live rows of an event calendar, from a path or from a table."""
    if isinstance(source, str):
        events = spark.read.schema(EVENT_SCHEMA).format(fmt).load(source)
    else:
        events = source
    return events.where(F.col("deleted_at").isNull()).drop("deleted_at")


def limited(df: DataFrame, rows: int, order: list) -> DataFrame:
    """At most ``rows`` rows, each marked when the input held more.

    One extra row is read to find the overflow, so that a cut result is never
    taken for a complete one.
    """
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(rows + 1)
    everything = Window.partitionBy()
    return (
        top.withColumn("_n", F.count(F.lit(1)).over(everything))
        .withColumn("_i", F.row_number().over(Window.partitionBy().orderBy(*order)))
        .where(F.col("_i") <= rows)
        .withColumn("status", F.when(F.col("_n") > rows, "overflow").otherwise("complete"))
        .drop("_n", "_i")
    )
