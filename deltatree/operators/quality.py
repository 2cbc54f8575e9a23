"""Checks of tables, books, parameters and slices; each returns rows, not errors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.operators.tree import MetricTree
from deltatree.sources.tables import limited

WEIGHT_TOLERANCE = 1e-6
SOURCE_TYPES = ("official", "derived", "self_defined")
SOURCED_TYPES = ("official", "derived")
DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def narrow_slices(rows: DataFrame) -> DataFrame:
    """Narrow a locked slice by further codes; widening or replacing is refused.

    ``rows``: slice_id, locked and extra (both map<string, array<string>>).
    """
    merged = F.map_zip_with(
        "locked", "extra",
        lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b)),
    )
    out = rows.withColumn("dims", merged)
    empty = F.exists(F.map_values("dims"), lambda codes: F.size(codes) == 0)
    return out.withColumn("status", F.when(empty, "conflict").otherwise("ok"))


def list_events(events: DataFrame, kind: str | None = None, start: str | None = None,
                end: str | None = None, limit: int | None = None) -> DataFrame:
    """Live events of a type that start on or after ``start`` and end on or before ``end``, newest first.

    An open event has no end, so it isn't listed if ``end`` is given. With a ``limit`` the rows have a
    ``status``, which is ``overflow`` if there are more.
    """
    rows = events
    if kind:
        rows = rows.where(F.col("type") == kind)
    if start:
        rows = rows.where(F.col("start_day") >= F.lit(date.fromisoformat(start)))
    if end:
        rows = rows.where(F.col("end_day") <= F.lit(date.fromisoformat(end)))
    newest = (F.col("start_day").desc(), F.col("event_id").desc())
    return rows.orderBy(*newest) if limit is None else limited(rows, limit, newest)


def booked_daily(cube: DataFrame) -> DataFrame:
    """Units paid and money refunded per day, from rows with a ``status`` (N paid, R refunded, A cancelled)."""
    return cube.groupBy("day").agg(
        F.sum(F.when(F.col("status") == "N", F.col("units")).otherwise(0)).alias("paid_units"),
        F.sum(F.when(F.col("status") == "R", F.col("revenue_cents")).otherwise(0)).alias("refund_cents"),
    )


def reconcile(daily: DataFrame, detail: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Two books compared key by key, keys of one side only included."""
    a = daily.select(*keys, *[F.col(m).alias(f"daily_{m}") for m in measures], F.lit(True).alias("_a"))
    b = detail.select(*keys, *[F.col(m).alias(f"detail_{m}") for m in measures], F.lit(True).alias("_b"))
    same = reduce(lambda x, y: x & y, [F.col(f"daily_{m}").eqNullSafe(F.col(f"detail_{m}")) for m in measures])
    status = (
        F.when(F.col("_a").isNull(), "daily_missing").when(F.col("_b").isNull(), "detail_missing")
        .when(same, "equal").otherwise("mismatch")
    )
    return a.join(b, list(keys), "full_outer").withColumn("status", status).drop("_a", "_b")


def fingerprint(daily: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """One digest of a table with one row per day, in day order.

    The list that is hashed last has one short digest per day, so it is bounded
    by the calendar.
    """
    per_day = daily.groupBy(order).agg(*[F.sum(c).alias(c) for c in columns]).select(
        F.col(order).alias("o"),
        F.sha2(F.concat_ws("|", F.col(order).cast("string"), *[F.col(c).cast("string") for c in columns]), 256).alias("h"),
    )
    listed = F.sort_array(F.collect_list(F.struct("o", "h")))
    return per_day.agg(
        F.sha2(F.array_join(F.transform(listed, lambda s: s["h"]), ""), 256).alias("digest"),
        F.count(F.lit(1)).alias("n_days"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def weight_sums(parameters: DataFrame, tolerance: float = WEIGHT_TOLERANCE) -> DataFrame:
    """Sum per prefix of the key, and whether it closes to 1."""
    prefix = F.regexp_extract("param_key", r"^(.*)\.[^.]*$", 1)
    sums = parameters.groupBy(prefix.alias("prefix")).agg(F.sum("value").alias("total"))
    return sums.withColumn("closed", F.abs(F.col("total") - 1) <= tolerance)


def normalise(rows: DataFrame, group: Sequence[str], weight: str, name: str = "weight") -> DataFrame:
    """Weights divided by the sum of their group; the sums are aggregated, not windowed."""
    sums = rows.groupBy(*group).agg(F.sum(weight).alias("_sum"))
    return rows.join(sums, list(group)).withColumn(
        name, F.col(weight) / F.nullif(F.col("_sum"), F.lit(0.0))).drop("_sum")


def parameter_violations(parameters: DataFrame) -> DataFrame:
    """One row per broken provenance rule."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    sourced = F.col("source_type").isin(*SOURCED_TYPES)
    rules = {
        "source_type": ~F.coalesce(F.col("source_type"), F.lit("")).isin(*SOURCE_TYPES),
        "source": sourced & (blank("source_name") | blank("source_url")),
        "captured_on": sourced & ~F.coalesce(F.col("captured_on").rlike(DAY_PATTERN), F.lit(False)),
        "label": (F.col("source_type") == "self_defined")
        & ~F.coalesce(F.col("source_name").contains("self-defined"), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return parameters.select("param_key", F.explode(broken).alias("rule"))


def rule_violations(df: DataFrame, rules: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Rows checked and rows breaking each rule, in one pass."""
    counted = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()],
    )
    return counted.unpivot([*group, "n_rows"], list(rules), "rule", "violations")


def validate_nodes(cube: DataFrame, tree: MetricTree) -> DataFrame:
    """Value, or the problem, of every node expression over one window.

    Expressions that do not resolve are found while the plan is analysed, before
    any data is read; the others share one aggregate.
    """
    fact = cube.alias("fact")
    good, bad = [], []
    for node in tree.nodes():
        if not node.sql:
            bad.append((node.code, "no expression"))
            continue
        try:
            fact.agg(node.value()).schema  # noqa: B018 - analysis is the check
        except Exception as error:  # noqa: BLE001 - the error text is the result
            bad.append((node.code, str(error).splitlines()[0]))
        else:
            good.append(node)
    rows = fact.agg(*[n.value() for n in good]).unpivot([], [n.code for n in good], "code", "value").select(
        "code", "value", F.col("value").isNotNull().alias("passed"),
        F.when(F.col("value").isNull(), "no data").otherwise("").alias("problem"),
    )
    if not bad:
        return rows
    failed = cube.sparkSession.createDataFrame(bad, "code string, problem string").select(
        "code", F.lit(None).cast("double").alias("value"), F.lit(False).alias("passed"), "problem")
    return rows.unionByName(failed)


def table_status(spark, sf_dir: str, names: Sequence[str]) -> DataFrame:
    """Whether each expected table exists and holds rows."""
    from pyspark.errors import AnalysisException

    from deltatree.sources.facts import table

    found, missing = {}, []
    for name in names:
        try:
            found[name] = table(spark, sf_dir, name)
        except AnalysisException:
            missing.append((name,))
    rows = row_counts(found).withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("empty"))
    if missing:
        lost = spark.createDataFrame(missing, "name string").select(
            "name", F.lit(0).cast("long").alias("n_rows"), F.lit("missing").alias("status"))
        rows = rows.unionByName(lost)
    return rows


def stale_parts(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Parts of a table whose digest differs from the one stored with the results."""
    joined = stored.select(key, F.col("digest").alias("stored")).join(
        now.select(key, F.col("digest").alias("now")), key, "full_outer")
    return joined.select(key, (~F.col("stored").eqNullSafe(F.col("now"))).alias("stale"))


def part_digests(daily: DataFrame, part: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One digest per part (such as a month) of a daily table, days in order."""
    row = F.sha2(F.concat_ws("|", F.col(order).cast("string"), *[F.col(c).cast("string") for c in columns]), 256)
    per_day = daily.groupBy(part, order).agg(*[F.sum(c).alias(c) for c in columns]).select(
        part, F.struct(F.col(order).alias("o"), row.alias("h")).alias("s"))
    return per_day.groupBy(part).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["h"]), ""), 256).alias("digest"))


def derive_skus(parts: DataFrame, factors: DataFrame, margins: DataFrame) -> DataFrame:
    """Standard price and unit cost in cents: price x factor, then price x (1 - margin)."""
    joined = parts.join(factors, "category", "left").join(margins, "sku", "left")
    price = F.rint(F.col("price_cents") * F.coalesce("factor", F.lit(1.0))).cast("long")
    priced = joined.withColumn("standard_price_cents", price)
    cost = F.rint(F.col("standard_price_cents") * (F.lit(1.0) - F.coalesce("margin", F.lit(0.0)))).cast("long")
    return priced.withColumn("unit_cost_cents", cost)
