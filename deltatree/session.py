"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Call-site capture doubles the time to build wide expressions on the driver.
DRIVER_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "deltatree", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for.

    AQE sizes shuffle partitions and splits skewed ones; runtime filters prune
    the fact side of a join; sums stay in LongType so ANSI overflow is an error.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **DRIVER_SETTINGS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="deltatree-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths that this driver has handed out and not removed.
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``remove_scratch`` removes what was written there."""
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _written.append(path)
    return path


def runs_path(spark: SparkSession) -> str:
    """The folder of the runs that this application stores below the shared one; ``remove_scratch`` removes it too."""
    path = os.path.join(scratch_dir(spark), f"runs-{spark.sparkContext.applicationId}")
    if path not in _written:
        _written.append(path)
    return path


def remove_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove written intermediate tables: ``paths``, or all of this driver once nothing reads them any more."""
    for path in list(_written if paths is None else paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _written:
            _written.remove(path)


def cut_lineage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with any ``options`` of the writer, and read it back.

    The written table survives a lost executor, and later plans start from it
    instead of recomputing the scan and the joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage_by(df: DataFrame, name: str, key: str, buckets: int, **options: str) -> DataFrame:
    """As ``cut_lineage``, written in buckets of ``key``: joins by it move only the other side."""
    spark, path, table = df.sparkSession, scratch_path(df.sparkSession, name), f"deltatree_{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options, path=path).bucketBy(buckets, key).format("parquet").saveAsTable(table)
    try:
        return spark.table(table).select("*")
    finally:
        spark.sql(f"DROP TABLE {table}")  # the files stay until they are removed
