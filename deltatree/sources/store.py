"""Stored runs: tables that a run commits once and later stages read.

A table lies at ``scenario=S/run_id=R/kind=K/attempt=A``. It counts when an empty file ``_committed-A`` stands beside it, which
is made after all its rows and its schema are written. So a writer that fails leaves nothing that is read, a
write that is tried again changes nothing, and a run that failed goes on after its last committed table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "_committed-"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _place(spark: SparkSession, path: str):
    """The path and its file system, of whatever kind."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def source_mark(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files' names, lengths and times: another one means that the input has changed."""
    seen = []
    for path in paths:
        place, files = _place(spark, path)
        found = files.listStatus(place)
        seen += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found)
    return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(seen)).hex[:16]


@dataclass(frozen=True)
class RunStore:
    """The committed tables of one run of a scenario below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str
    scenario: str
    run_id: str

    def __post_init__(self):
        for name in (self.scenario, self.run_id):
            if not _NAME.fullmatch(name):
                raise ValueError(f"not a name for a folder: {name!r}")

    def folder(self, kind: str) -> str:
        if not _NAME.fullmatch(kind):
            raise ValueError(f"not a name for a folder: {kind!r}")
        return f"{self.path}/scenario={self.scenario}/run_id={self.run_id}/kind={kind}"

    def committed(self, kind: str) -> str | None:
        """The attempt that counts: of several that ended at one time, the one whose name comes first."""
        place, files = _place(self.spark, f"{self.folder(kind)}/{MARK}*")
        marks = files.globStatus(place) or []
        return min((m.getPath().getName() for m in marks), default=MARK).removeprefix(MARK) or None

    def kinds(self) -> list[str]:
        place, files = _place(self.spark, f"{self.path}/scenario={self.scenario}/run_id={self.run_id}/kind=*/{MARK}*")
        return sorted({m.getPath().getParent().getName().removeprefix("kind=") for m in files.globStatus(place) or []})

    def write(self, kind: str, rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Commit ``rows``, sorted by ``order`` inside each file, and read them back. A kind that is committed already stays as it is."""
        if self.committed(kind):
            return self.read(kind)
        attempt = uuid.uuid4().hex
        target = f"{self.folder(kind)}/attempt={attempt}"
        (rows.sortWithinPartitions(*order) if order else rows).write.mode("errorifexists").parquet(target)
        place, files = _place(self.spark, f"{target}/_schema.json")
        out = files.create(place, True)
        try:
            out.write(bytearray(rows.schema.json().encode()))
        finally:
            out.close()
        mark, _ = _place(self.spark, f"{self.folder(kind)}/{MARK}{attempt}")
        files.create(mark, False).close()
        return self.read(kind)

    def read(self, kind: str) -> DataFrame:
        attempt = self.committed(kind)
        if attempt is None:
            raise LookupError(f"run {self.run_id} of {self.scenario} has no {kind}")
        target = f"{self.folder(kind)}/attempt={attempt}"
        place, files = _place(self.spark, f"{target}/_schema.json")
        stream = files.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(target)

    def stage(self, kind: str, build: Callable[[], DataFrame], order: Sequence[str] = ()) -> DataFrame:
        """The committed table, or what ``build`` gives, committed."""
        return self.read(kind) if self.committed(kind) else self.write(kind, build(), order)

    def discard(self) -> None:
        """Remove the whole run."""
        place, files = _place(self.spark, f"{self.path}/scenario={self.scenario}/run_id={self.run_id}")
        files.delete(place, True)


def write_results(df: DataFrame, path: str, scenario: str, run_id: str, kind: str, keys: tuple[str, ...]) -> str:
    """Commit result rows of a kind with a JSON payload; a repeated write leaves the rows that are there."""
    payload = [c for c in df.columns if c not in keys]
    store = RunStore(df.sparkSession, path, scenario, run_id)
    store.write(kind, df.select(
        F.lit(scenario).alias("scenario"), F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), *keys,
        F.to_json(F.struct(*payload)).alias("payload")))
    return path


def read_results(spark: SparkSession, path: str, scenario: str, run_id: str, kind: str, payload: str) -> DataFrame:
    """Result rows of a kind with the fields of their payload, whose schema is given."""
    rows = RunStore(spark, path, scenario, run_id).read(kind)
    return rows.withColumn("_p", F.from_json("payload", payload)).select(
        *[c for c in rows.columns if c != "payload"], "_p.*")
