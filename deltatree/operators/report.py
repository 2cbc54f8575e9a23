"""Report tables: long rows of seven ordered segments for every slice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions import scalar as S

SEGMENTS = ("background", "contributions", "drilldown", "conclusions", "evidence", "whatif", "actions")
FIELDS = ("slice_id", "segment_index", "segment", "position", "label", "value", "display")


def amount_text(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string("%,d cents", F.round(value).cast("long")))


def rate_text(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string("%+.1f%%", value * 100))


def number_text(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", value))


def field(position: Column | int, label: Column, value: Column, display: Column) -> Column:
    place = F.lit(position) if isinstance(position, int) else position
    return F.struct(place.cast("int").alias("position"), label.alias("label"), value.cast("double").alias("value"),
                    display.alias("display"))


def segment_rows(df: DataFrame, segment: str, fields: Sequence[Column]) -> DataFrame:
    """Turn the columns of one operator's output into field rows of a segment."""
    index = SEGMENTS.index(segment) + 1
    return df.select("slice_id", F.inline(F.array(*fields))).select(
        "slice_id", F.lit(index).alias("segment_index"), F.lit(segment).alias("segment"),
        "position", "label", "value", "display")


def report_rows(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select(*FIELDS)


def nested_report(rows: DataFrame) -> DataFrame:
    """One row per slice with its segments as nested arrays (a report is small)."""
    fields = F.sort_array(F.collect_list(F.struct("position", "label", "value", "display")))
    segments = rows.groupBy("slice_id", "segment_index", "segment").agg(fields.alias("fields"))
    return segments.groupBy("slice_id").agg(
        F.sort_array(F.collect_list(F.struct("segment_index", "segment", "fields"))).alias("segments"))


def flatten_report(reports: DataFrame) -> DataFrame:
    """Field rows of nested reports."""
    return reports.select("slice_id", F.inline("segments")).select(
        "slice_id", "segment_index", "segment", F.inline("fields")
    ).select("slice_id", "segment_index", "segment", "label", "display")


def content_checksum(rows: DataFrame) -> DataFrame:
    """Digest of a report's rows in canonical order, one per slice.

    Every field, the value to four digits included, is written with its length in front and NULL as a
    dash, so no two different rows have one text.
    """
    number = F.format_string("%.4f", F.col("value"))
    parts = [F.col("segment_index").cast("string"), F.col("position").cast("string"), F.col("label"), F.when(F.col("value").isNotNull(), number), F.col("display")]
    text = F.concat(*[F.when(p.isNull(), "-").otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in parts])
    key = F.struct("segment_index", "position", "label", text.alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(key)), lambda s: s["t"])
    return rows.groupBy("slice_id").agg(
        F.sha2(F.array_join(listed, ""), 256).alias("checksum"), F.count(F.lit(1)).alias("n_fields"))


def cross_check(tree_change: DataFrame, anomaly_change: DataFrame, keys: Sequence[str],
                tolerance: float = S.TOLERANCE) -> DataFrame:
    """Change of the root from two independent paths."""
    joined = tree_change.select(*keys, F.col("delta").alias("tree_delta")).join(
        anomaly_change.select(*keys, F.col("delta").alias("anomaly_delta")), list(keys), "full_outer")
    relative = S.relative_residual(F.col("tree_delta"), F.col("anomaly_delta"))
    return joined.withColumn("passed", F.coalesce(relative < tolerance, F.lit(False)))


def action_list(top: DataFrame, playbook: DataFrame, points: DataFrame) -> DataFrame:
    """Factor, action, owner and cycle; a range only where the knob has a curve."""
    from deltatree.operators.whatif import nearest_point

    actions = top.join(playbook, "factor", "left")
    ranged = nearest_point(actions, points, ("slice_id", "knob"))
    return ranged.withColumn(
        "range_status",
        F.when(F.col("action").isNull(), "no_template").when(F.col("expected").isNull(), "no_curve").otherwise("range"))


def ledger(tree_layers: DataFrame, pivots: DataFrame) -> DataFrame:
    """Conservation of all layers: tree nodes and dimension tables."""
    columns = ("slice_id", "layer", "source", "relative", "passed")
    return tree_layers.select(*columns).unionByName(pivots.select(*columns))
