"""Is a metric's move larger than its usual week-to-week spread?"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions import scalar as S
from deltatree.functions.periods import Period
from deltatree.operators.tree import LEVEL_DEPTH, SUM, MetricTree
from deltatree.operators.values import paired_values, slice_sets, weekly_lags

BASELINE_WEEKS = 4
CHANGE_THRESHOLD = 0.05
Z_THRESHOLD = 2.0
BAND_SIGMAS = 2.0


def history_start(period: Period, weeks: int = BASELINE_WEEKS) -> str:
    return (date.fromisoformat(period.start) - timedelta(days=7 * weeks)).isoformat()


def period_change(pairs: DataFrame) -> DataFrame:
    """Change and rate per metric; here a missing total counts as 0."""
    base = F.coalesce("base", F.lit(0.0))
    current = F.coalesce("current", F.lit(0.0))
    return (
        pairs.withColumn("base", base).withColumn("current", current)
        .withColumn("delta", F.col("current") - F.col("base"))
        .withColumn("change_rate", S.rate(F.col("delta"), F.col("base")))
    )


def baseline_band(series: DataFrame, period: Period, keys: Sequence[str],
                  weeks: int = BASELINE_WEEKS, season: DataFrame | None = None) -> DataFrame:
    """Centre and width from the same weekdays of the weeks before.

    Per period day: median and population sigma of the lagged values that exist
    before the period starts; then the means over the days. A day with one lag
    gives a median but no sigma. ``season`` (day, season_factor) moves the centre
    only.
    """
    first, last = F.lit(date.fromisoformat(period.start)), F.lit(date.fromisoformat(period.end))
    history = series.where(F.col("day") < first)
    days = history.select(*keys).distinct().withColumn("day", F.explode(F.sequence(first, last)))
    per_day = weekly_lags(days, history, keys, weeks).groupBy(*keys, "day").agg(
        F.median("lag_value").alias("median"),
        F.when(F.count("lag_value") > 1, F.stddev_pop("lag_value")).alias("sigma"),
    )
    band = per_day.groupBy(*keys).agg(
        F.avg("median").alias("baseline_value"),
        F.coalesce(F.avg("sigma"), F.lit(0.0)).alias("sigma"),
        F.count(F.lit(1)).alias("covered_days"),
    )
    if season is not None:
        factor = season.where(F.col("day").between(first, last)).agg(F.avg("season_factor")).scalar()
        band = band.withColumn("season_factor", factor).withColumn(
            "baseline_value", F.col("baseline_value") * F.coalesce("season_factor", F.lit(1.0))
        )
    width = F.col("sigma") * BAND_SIGMAS
    return band.withColumn("baseline_low", F.col("baseline_value") - width).withColumn(
        "baseline_high", F.col("baseline_value") + width
    )


def score(changes: DataFrame, band: DataFrame, keys: Sequence[str], compared: Column,
          change_threshold: float = CHANGE_THRESHOLD, z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """z-score, position in the band, verdict, severity and a note.

    ``compared`` is the value held against the daily band. Without a spread the
    z-score is undefined and the size of the change decides alone.
    """
    rows = changes.join(band, list(keys), "left").withColumn("compared_value", compared)
    has_sigma = F.coalesce(F.col("sigma"), F.lit(0.0)) != 0
    z = F.when(has_sigma, (F.col("compared_value") - F.col("baseline_value")) / F.col("sigma"))
    inside = F.coalesce(F.col("compared_value").between(F.col("baseline_low"), F.col("baseline_high")), F.lit(True))
    large = F.coalesce(F.abs("change_rate") > change_threshold, F.lit(False))
    far = F.coalesce(F.abs("z_score") > z_threshold, F.lit(False))
    return (
        rows.withColumn("z_score", z)
        .withColumn("in_normal_band", inside)
        .withColumn("covered_days", F.coalesce("covered_days", F.lit(0)))
        .withColumn("is_anomaly", large & (far | (F.col("z_score").isNull() & ~has_sigma)))
        .withColumn("severity", F.coalesce(F.abs("z_score"), F.abs(F.coalesce("change_rate", F.lit(0.0))) * 10.0))
        .withColumn(
            "note",
            F.when(F.col("baseline_value").isNull(), "no history")
            .when(~has_sigma, "no spread in history").otherwise(""),
        )
    )


def node_changes(cube: DataFrame, tree: MetricTree, period: Period, max_level: int = 3,
                 sets: Sequence[Sequence[str]] = ((),)) -> tuple[DataFrame, DataFrame]:
    """Period totals (long) and daily history (long) of all nodes from one cube."""
    nodes = [n for n in tree.nodes() if n.sql and LEVEL_DEPTH.get(n.level, 3) <= max_level]
    before = period.previous()
    side = F.when(period.holds(F.col("day")), "current").when(before.holds(F.col("day")), "base")
    labelled = cube.withColumn("period", side).where(F.col("period").isNotNull())
    totals = slice_sets(labelled, ["period"], sets, tree.values())
    pairs = paired_values(totals, tree, ["slice_id"])
    items = F.array(*[
        F.struct(
            F.lit(n.code).alias("code"), F.lit(n.level).alias("level"),
            F.lit(n.aggregate == SUM).alias("is_total"),
            F.col(f"b_{n.code}").alias("base"), F.col(f"c_{n.code}").alias("current"),
        ) for n in nodes
    ])
    changes = period_change(pairs.select("slice_id", F.inline(items)))
    first = date.fromisoformat(history_start(period))
    history = cube.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(date.fromisoformat(period.start))))
    daily = slice_sets(history, ["day"], sets, tree.values())
    series = daily.unpivot(["slice_id", "day"], [n.code for n in nodes], "code", "value")
    return changes, series.where(F.col("value").isNotNull())


def anomalies(cube: DataFrame, tree: MetricTree, period: Period, basis: str = "daily_mean",
              max_level: int = 3, sets: Sequence[Sequence[str]] = ((),),
              change_threshold: float = CHANGE_THRESHOLD, z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """Verdict for every node and slice; ``by_severity`` puts the worst first.

    The band describes one day. ``daily_mean`` compares a total divided by the
    days of the period with it; ``period_total`` compares the undivided total.
    """
    if basis not in ("daily_mean", "period_total"):
        raise ValueError(f"basis must be daily_mean or period_total: {basis}")
    changes, series = node_changes(cube, tree, period, max_level, sets)
    keys = ["slice_id", "code"]
    band = baseline_band(series, period, keys)
    compared = F.col("current")
    if basis == "daily_mean":
        compared = F.when(F.col("is_total"), F.col("current") / period.days).otherwise(F.col("current"))
    return score(changes, band, keys, compared, change_threshold, z_threshold)


def by_severity(verdicts: DataFrame) -> DataFrame:
    return verdicts.orderBy(F.col("severity").desc(), "code", "slice_id")


def series_with_band(cube: DataFrame, tree: MetricTree, shown: Period, sets: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Daily values of every node and slice over the days shown, with the band that the weeks before give for these days."""
    keys = ["slice_id", "code"]
    days = cube.where((F.col("day") >= F.lit(date.fromisoformat(history_start(shown)))) & (F.col("day") <= F.lit(date.fromisoformat(shown.end))))
    wide = slice_sets(days, ["day"], sets, tree.values())
    series = wide.unpivot(["slice_id", "day"], [n.code for n in tree.nodes()], "code", "value").where(F.col("value").isNotNull())
    return series.where(shown.holds(F.col("day"))).join(baseline_band(series, shown, keys), keys, "left")


def run_status(rows: DataFrame, log: DataFrame, metric: str, start: str) -> DataFrame:
    """Whether a metric of a scenario was attributed before for a period, by which runs, and how the latest one ended.

    ``rows`` and ``log`` have a ``scenario``: trees may use the same codes. The log stores a period as ``start..end`` or as one day; both match by start.
    """
    runs = log.withColumn("_start", F.to_date(F.split("period", r"\.\.")[0])).groupBy("scenario", "metric", "_start").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max_by("status", "id").alias("latest_status"),
        F.sort_array(F.collect_list("id")).alias("run_ids"),  # the runs of one metric and period are few
    )
    joined = rows.join(runs, (rows["scenario"] == runs["scenario"]) & (rows[metric] == runs["metric"]) & (rows[start] == runs["_start"]), "left")
    return joined.select(
        *[rows[c] for c in rows.columns],
        F.col("n_runs").isNotNull().alias("started"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "latest_status", F.coalesce("run_ids", F.array().cast(runs.schema["run_ids"].dataType)).alias("run_ids"),
    )
