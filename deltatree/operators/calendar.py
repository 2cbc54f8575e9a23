"""Dates: promotion days, the date table, and events near a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 3
DIMENSION_WEIGHT = 0.6
TIME_WEIGHT = 0.4
CHAIN_FROM = 0.5
WATCH_FROM = 0.3
BUCKET_DAYS = 7
EPOCH = "1970-01-01"


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit(EPOCH).cast("date")) / BUCKET_DAYS).cast("int")


def in_promotion(days: DataFrame, promotions: Sequence[tuple]) -> DataFrame:
    """Adds promotion name and lift; yearly windows, the first listed one wins.

    ``promotions``: (name, first month, first day, last month, last day, lift). A window
    whose last day is before its first one ends in the next year; 29 February is the
    28th in other years. Windows are unrolled to days for the years in the data and joined by day.
    """
    listing = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(m0).alias("m0"), F.lit(d0).alias("d0"),
                 F.lit(m1).alias("m1"), F.lit(d1).alias("d1"), F.lit(float(lift)).alias("lift"))
        for i, (name, m0, d0, m1, d1, lift) in enumerate(promotions)
    ])
    # the year before as well: its last window may reach into the first year
    years = days.select(F.explode(F.array(F.year("day"), F.year("day") - 1)).alias("y")).distinct()

    def date_of(year: Column, month: Column, day: Column) -> Column:
        first = F.make_date(year, month, F.lit(1))
        return F.least(F.date_add(first, day - 1), F.last_day(first))

    over = F.when(F.col("p.m1") * 100 + F.col("p.d1") < F.col("p.m0") * 100 + F.col("p.d0"), 1).otherwise(0)
    unrolled = years.select("y", F.explode(listing).alias("p")).select(
        "p.i", "p.name", "p.lift",
        F.explode(F.sequence(date_of(F.col("y"), F.col("p.m0"), F.col("p.d0")), date_of(F.col("y") + over, F.col("p.m1"), F.col("p.d1")))).alias("day"),
    )
    first = unrolled.groupBy("day").agg(
        F.min_by("name", "i").alias("promo_name"), F.min_by("lift", "i").alias("promo_lift"))
    return days.join(first, "day", "left").withColumn(
        "is_promo", F.col("promo_name").isNotNull()
    ).withColumn("promo_lift", F.coalesce("promo_lift", F.lit(1.0)))


def month_factors(daily: DataFrame, value: str) -> DataFrame:
    """Rows ``(month, season_factor)``: mean daily value of a month of the year over that of all days."""
    month = daily.groupBy(F.month("day").alias("month")).agg(F.avg(value).alias("_m"))
    return month.select("month", (F.col("_m") / F.nullif(daily.agg(F.avg(value)).scalar(), F.lit(0.0))).alias("season_factor"))


def date_table(bounds: DataFrame, promotions: Sequence[tuple], season: DataFrame) -> DataFrame:
    """Every calendar day between ``first_day`` and ``last_day`` of the one-row input.

    ``season``: (month, season_factor); a month without a factor has 1.
    """
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return in_promotion(days, promotions).join(season.withColumnRenamed("month", "_month"), F.month("day") == F.col("_month"), "left").select(
        "day", F.year("day").alias("year"), F.month("day").alias("month"), F.quarter("day").alias("quarter"),
        F.weekday("day").alias("weekday"), (F.weekday("day") >= 5).alias("is_weekend"),
        "is_promo", "promo_name", F.coalesce("season_factor", F.lit(1.0)).alias("season_factor"), "promo_lift",
    )


def gap_days(event_start: Column, event_end: Column, start: Column, end: Column) -> Column:
    """Days between an event and a window, 0 when they overlap; no end means open."""
    return (
        F.when(event_end < start, F.datediff(start, event_end))
        .when(event_start > end, F.datediff(event_start, end))
        .otherwise(F.lit(0))
    )


def _window_weeks(windows: DataFrame, within: int) -> DataFrame:
    """Windows once for each week that they reach: ``_w0`` the first of them, ``_bucket`` this one."""
    return (
        windows.withColumn("_w0", _bucket(F.date_sub("window_start", within)))
        .withColumn("_bucket", F.explode(F.sequence("_w0", _bucket(F.date_add("window_end", within)))))
    )


def _event_weeks(windows: DataFrame, events: DataFrame, within: int) -> DataFrame:
    """Events once for each week: ``_e0``, ``_bucket``. Long and open events are cut to the range that the windows cover."""
    spread = windows.agg(
        F.struct(F.date_sub(F.min("window_start"), within).alias("lo"),
                 F.date_add(F.max("window_end"), within).alias("hi")).alias("r")
    ).scalar()
    e = events.withColumn("_r", spread)
    start = F.greatest(F.col("start_day"), F.col("_r.lo"))
    end = F.least(F.coalesce(F.col("end_day"), F.col("_r.hi")), F.col("_r.hi"))
    return (
        e.withColumn("_e0", _bucket(start)).withColumn("_e1", _bucket(end)).where(F.col("_e0") <= F.col("_e1"))
        .withColumn("_bucket", F.explode(F.sequence("_e0", "_e1"))).drop("_r", "_e1")
    )


def _near(pairs: DataFrame, within: int) -> DataFrame:
    """Pairs in the first week that they share, with their gap, if it is small enough."""
    gap = gap_days(F.col("start_day"), F.col("end_day"), F.col("window_start"), F.col("window_end"))
    kept = pairs.where(F.col("_bucket") == F.greatest("_w0", "_e0")).withColumn("gap", gap)
    return kept.where(F.col("gap") <= within).drop("_bucket", "_w0", "_e0")


def events_near(windows: DataFrame, events: DataFrame, within: int = WINDOW_DAYS) -> DataFrame:
    """Pairs of windows and events at most ``within`` days apart.

    Both sides are unrolled to week buckets and joined on the bucket; a pair is
    kept in the first bucket it shares.
    """
    return _near(_window_weeks(windows, within).join(_event_weeks(windows, events, within), "_bucket"), within)


#: How a dimension is posted: a listed code, an event that lists none, or any event that names the dimension.
_CODE, _FREE, _ANY = 0, 1, 2


def _listed(dims: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(dims, name), F.array().cast("array<string>"))


def _post(name: Column, kind: int, code: Column | None = None) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("kind"), (F.lit("") if code is None else code).alias("code"))


def event_postings(dims: Column) -> Column:
    """The keys under which an event is found: for each dimension it names, every code (or that it lists none), and the name alone."""
    return F.array_distinct(F.flatten(F.transform(F.map_keys(dims), lambda n: F.concat(
        F.array(_post(n, _ANY)),
        F.when(F.size(_listed(dims, n)) > 0, F.transform(_listed(dims, n), lambda c: _post(n, _CODE, c))).otherwise(F.array(_post(n, _FREE)))))))


def window_lookups(dims: Column, scenario_dims: Sequence[str]) -> Column:
    """The keys that a window asks for: its codes and events without codes, or all events of a dimension that it leaves free."""
    declared = F.array(*[F.lit(d) for d in scenario_dims]).cast("array<string>")
    names = F.when(F.size(F.map_keys(dims)) > 0, F.map_keys(dims)).otherwise(declared)
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.when(
        F.size(_listed(dims, n)) > 0, F.concat(F.array(_post(n, _FREE)), F.transform(_listed(dims, n), lambda c: _post(n, _CODE, c))),
    ).otherwise(F.array(_post(n, _ANY))))))


def events_sharing(windows: DataFrame, events: DataFrame, scenario_dims: Sequence[str], within: int = WINDOW_DAYS) -> DataFrame:
    """As ``events_near`` for pairs that share a dimension (``dimension_overlap`` above 0), and only those are made.

    Events are posted under (week, dimension, code) and windows look their own keys up, so a window never meets the events of its week
    whose codes are others'. A pair that shares several keys is kept at the least of them.
    """
    w = _window_weeks(windows, within).withColumn("_asked", window_lookups(F.col("slice_dims"), scenario_dims))
    e = _event_weeks(windows, events, within).withColumn("_posted", event_postings(F.col("dims")))
    pairs = w.withColumn("_key", F.explode("_asked")).join(e.withColumn("_key", F.explode("_posted")), ["_bucket", "_key"])
    least = F.array_min(F.array_intersect("_asked", "_posted"))
    return _near(pairs.where(F.col("_key") == least).drop("_key", "_asked", "_posted"), within)


def dimension_overlap(event: Column, slice_dims: Column, scenario_dims: Sequence[str]) -> Column:
    """Shared over all dimension names of event and slice.

    A shared name counts only when the codes meet, if both sides list codes.
    Without slice dimensions the dimensions of the scenario are compared.
    """
    declared = F.array(*[F.lit(d) for d in scenario_dims]).cast("array<string>")
    fixed = F.map_keys(slice_dims)
    reference = F.when(F.size(fixed) > 0, fixed).otherwise(declared)
    keys = F.map_keys(event)

    def meets(name: Column) -> Column:
        a, b = F.try_element_at(event, name), F.try_element_at(slice_dims, name)
        free = F.coalesce(F.size(a), F.lit(0)) * F.coalesce(F.size(b), F.lit(0)) <= 0
        return free | F.coalesce(F.arrays_overlap(a, b), F.lit(False))

    shared = F.filter(F.array_intersect(keys, reference), meets)
    union = F.array_union(keys, reference)
    return F.coalesce(F.size(shared) / F.nullif(F.size(union).cast("double"), F.lit(0.0)), F.lit(0.0))


def time_proximity(gap: Column, within: int = WINDOW_DAYS) -> Column:
    return F.when(gap == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(max(1, within)))))


def match_events(windows: DataFrame, events: DataFrame, scenario_dims: Sequence[str],
                 within: int = WINDOW_DAYS) -> DataFrame:
    """Relevance and tier of each event near a window.

    ``windows``: window_id, window_start, window_end, slice_dims. Events out of
    reach in time or without a common dimension are dropped, whatever their score.
    """
    near = events_sharing(windows, events, scenario_dims, within)
    scored = (
        near.withColumn("overlap", dimension_overlap(F.col("dims"), F.col("slice_dims"), scenario_dims))
        .withColumn("proximity", time_proximity(F.col("gap"), within))
        .withColumn("relevance", F.col("overlap") * DIMENSION_WEIGHT + F.col("proximity") * TIME_WEIGHT)
    )
    tier = F.when(F.round("relevance", 12) >= CHAIN_FROM, "chain").when(F.round("relevance", 12) >= WATCH_FROM, "watch")
    return (
        scored.where(F.col("overlap") > 0).withColumn("tier", tier).where(F.col("tier").isNotNull())
        .withColumn("is_exogenous", F.col("tier") == "chain")
    )


def ordered_matches(matches: DataFrame) -> DataFrame:
    return matches.orderBy("window_id", F.col("relevance").desc(), "start_day", "event_id")


def causal_chain(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("is_exogenous"))
