"""Elasticity of a metric to a factor, and the curve it implies.

One row per key. A series is bounded by the estimation window, so it fits in an
array; fallback and refusal are columns, never lost keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions import scalar as S
from deltatree.functions.periods import Period
from deltatree.operators.inference import finite
from deltatree.operators.tree import MetricTree, check_dimensions, spark_sql
from deltatree.operators.values import join_slices

# Fixed values which decide results.
MIN_OBSERVATIONS = 60
MIN_PAIRS = 4
LEVEL = 0.90
WEIGHTS = {"sample": 0.40, "fit": 0.30, "width": 0.30}
WIDE_RATIO = 1.0
FALLBACK_CEILING = 0.5
WEAK_FIT = 0.30
WEAK_FIT_CEILING = 0.40
WINDOW_DAYS = 120
MAX_ADJUSTMENT = 0.30
ADJUSTMENTS = (-0.30, -0.20, -0.10, 0.0, 0.10, 0.20, 0.30)


@dataclass(frozen=True)
class Knob:
    """A factor that can be turned, and what stands for it in the data.

    ``expression`` aggregates columns of the cube, as a dictionary's do (``fact.``), and those of the table named ``proxy``.
    """

    scenario: str
    code: str
    name: str
    expression: str = ""
    reject_reason: str = ""
    proxy: str = ""

    @property
    def estimable(self) -> bool:
        return bool(self.expression)


def resolve_knobs(requests: DataFrame, declared: dict[str, Sequence[str]], knobs: Sequence[Knob]) -> DataFrame:
    """Requests (scenario, factor, ...) with the proxy to use or the reason of refusal."""
    spark = requests.sparkSession
    allowed = spark.createDataFrame(
        [(s, f, True) for s, fs in declared.items() for f in fs], "scenario string, factor string, declared boolean")
    known = spark.createDataFrame(
        [(k.scenario, k.code, k.name, k.expression, k.estimable, k.reject_reason) for k in knobs],
        "scenario string, factor string, knob_name string, expression string, estimable boolean, reject_reason string")
    joined = requests.join(allowed, ["scenario", "factor"], "left").join(known, ["scenario", "factor"], "left")
    status = (
        F.when(F.col("declared").isNull(), "not_intervenable")
        .when(F.col("estimable").isNull(), "no_proxy")
        .when(~F.col("estimable"), "not_estimable").otherwise("ok")
    )
    return joined.withColumn("status", status).drop("declared")


@dataclass(frozen=True)
class Proxy:
    """Attributes of the codes of a dimension that the cube doesn't hold: a table ``code`` and attributes, one row per code."""

    dimension: str
    table: DataFrame


def with_proxies(cube: DataFrame, knobs: Sequence[Knob], proxies: dict[str, Proxy]) -> DataFrame:
    """The cube with the attributes that the knobs' expressions ask for; a code without attributes has nulls."""
    out = cube
    for name in sorted({k.proxy for k in knobs if k.proxy}):
        if name not in proxies:
            raise ValueError(f"no table of attributes is given for {name}")
        attributes = [c for c in proxies[name].table.columns if c != "code"]
        if clash := set(attributes) & set(out.columns):
            raise ValueError(f"attributes of {name} that the cube has already: {sorted(clash)}")
        right = proxies[name].table.withColumnRenamed("code", "_code")
        out = out.join(right, F.col(proxies[name].dimension) == F.col("_code"), "left").drop("_code")
    return out


def knob_values(rows: DataFrame, keys: Sequence[str], target: Column, knobs: Sequence[Knob], names: tuple[str, str]) -> DataFrame:
    """The target and each knob's proxy from one aggregate, as rows ``(keys, factor, target, proxy)``; ``names`` of the last two."""
    wide = rows.alias("fact").groupBy(*keys).agg(target.alias("_target"), *[F.expr(spark_sql(k.expression)).alias(f"_x{i}") for i, k in enumerate(knobs)])
    each = F.array(*[F.struct(F.lit(k.code).alias("factor"), F.col("_target").cast("double").alias(names[0]), F.col(f"_x{i}").cast("double").alias(names[1]))
                     for i, k in enumerate(knobs)])
    return wide.select(*keys, F.inline(each))


def _knob_run(cube: DataFrame, tree: MetricTree, knobs: Sequence[Knob], proxies: dict[str, Proxy], slices: DataFrame, dims: Sequence[str],
              window: Period, current: Period, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Elasticities with their bases for every slice, knob and combination of ``by``."""
    keys = ["slice_id", *by]
    target = tree.root.value("_target")
    days = window.holds(F.col("day")) | current.holds(F.col("day"))
    rows = join_slices(with_proxies(cube.where(days), knobs, proxies), slices.select("slice_id", "dims"), dims)
    pairs = knob_values(rows.where(window.holds(F.col("day"))), [*keys, "day"], target, knobs, ("y", "x"))
    pairs = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    bases = knob_values(rows.where(current.holds(F.col("day"))), keys, target, knobs, ("base_value", "factor_base"))
    keys = ["slice_id", "factor", *by]
    return estimate(pairs, keys, replicates, seed).join(bases, keys, "left")


def estimable_knobs(knobs: Sequence[Knob], tree: MetricTree) -> list[Knob]:
    """Those that the tree declares and that have a proxy."""
    return [k for k in knobs if k.scenario == tree.scenario and k.estimable and k.code in tree.intervenable_factors]


def run_whatif(requests: DataFrame, cube: DataFrame, slices: DataFrame, dims: Sequence[str], tree: MetricTree, knobs: Sequence[Knob],
               proxies: dict[str, Proxy], window: Period, current: Period, adjustments: Sequence[float] = ADJUSTMENTS,
               max_adjustment: float = MAX_ADJUSTMENT, replicates: int = R.BOOTSTRAPS, seed: int = R.SEED) -> DataFrame:
    """Curves of many requests ``(request_id, slice_id, factor)``: what the root would be if the knob were turned in the slice.

    Series and bases of all knobs are compiled from their expressions into one aggregate of the cube; a slice and knob that several
    requests name is estimated once. A request that is refused keeps one row with its ``status`` and ``reason``:
    not intervenable, no proxy, not estimable; a slice without observations; no elasticity; no positive base.
    """
    resolved = resolve_knobs(requests.withColumn("scenario", F.lit(tree.scenario)), {tree.scenario: tree.intervenable_factors}, knobs)
    usable = estimable_knobs(knobs, tree)
    head = ("request_id", "slice_id", "factor", "status")
    told = F.coalesce(F.nullif("reject_reason", F.lit("")), "status")
    refused = resolved.where(F.col("status") != "ok").select(*head, told.alias("reason"))
    if not usable:
        return refused
    asked = resolved.where(F.col("status") == "ok").select(*head)
    needed = slices.join(asked.select("slice_id").distinct(), "slice_id", "left_semi")
    found = _knob_run(cube, tree, usable, proxies, needed, dims, window, current, (), replicates, seed)
    points = curve(found, ["slice_id", "factor", "base_value"], adjustments, max_adjustment).withColumnRenamed("reason", "_reason")
    answered = asked.join(points, ["slice_id", "factor"], "left").withColumn("reason", F.coalesce("_reason", F.lit("no observations")))
    rest = [c for c in points.columns if c not in ("slice_id", "factor", "_reason")]
    return answered.select(*head, "reason", *rest).unionByName(refused, allowMissingColumns=True)


def whatif_by(cube: DataFrame, slices: DataFrame, dims: Sequence[str], by: Sequence[str], tree: MetricTree, knobs: Sequence[Knob],
              proxies: dict[str, Proxy], window: Period, current: Period, adjustments: Sequence[float] = ADJUSTMENTS,
              max_adjustment: float = MAX_ADJUSTMENT, replicates: int = R.BOOTSTRAPS, seed: int = R.SEED) -> DataFrame:
    """Curves per combination of the dimensions ``by`` inside each slice, for all knobs; the combination stands in columns of its own.

    The knob's base is its value last observed in the window.
    """
    names = check_dimensions(by, dims)
    found = _knob_run(cube, tree, estimable_knobs(knobs, tree), proxies, slices, dims, window, current, names, replicates, seed)
    return curve(found.withColumn("factor_base", F.col("last_x")), ["slice_id", "factor", *names, "base_value", "n"], adjustments, max_adjustment)


def align(target: DataFrame, factor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days on which both series have a value: x is the factor, y the target."""
    x = factor.select(*keys, "day", F.col("value").alias("x"))
    y = target.select(*keys, "day", F.col("value").alias("y"))
    return y.join(x, [*keys, "day"])


def log_log_fit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least squares of ln y on ln x; NULL unless all values are finite and positive and x moves.

    r2 is 0 for a constant y.
    """
    numbers = finite("x") & finite("y")
    positive = numbers & (F.col("x") > 0) & (F.col("y") > 0)
    lx, ly = F.when(positive, F.ln("x")), F.when(positive, F.ln("y"))
    stats = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(positive).alias("positive"), F.min(numbers).alias("finite"),
        F.var_pop(lx).alias("_vx"), F.var_pop(ly).alias("_vy"),
        F.regr_slope(ly, lx).alias("_slope"), F.regr_intercept(ly, lx).alias("_icept"),
        F.regr_r2(ly, lx).alias("_r2"),
    )
    usable = F.col("positive") & (F.col("_vx") > 0)
    return stats.select(
        *keys, "n", "positive", "finite", usable.alias("x_moves"),
        F.when(usable, F.col("_slope")).alias("slope"), F.when(usable, F.col("_icept")).alias("intercept"),
        F.when(usable, F.when(F.col("_vy") > 0, F.col("_r2")).otherwise(0.0)).alias("r_squared"),
    )


def pack(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series of a key as an array of (day, x, y) in day order."""
    return pairs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("day").alias("o"), "x", "y"))).alias("_rows"))


def _mean(values: Column, size: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return total / F.nullif(size.cast("double"), F.lit(0.0))


def _field(name: str):
    return lambda row: row[name].cast("double")


def finite_difference(packed: DataFrame) -> DataFrame:
    """Relative change of y over that of x, between the means of both halves."""
    n = F.size("_rows")
    half = F.floor(n / 2).cast("int")
    out = packed.withColumn("_n", n).withColumn("_h", half)
    for side in ("x", "y"):
        values = F.transform("_rows", _field(side))
        out = out.withColumn(f"_{side}0", _mean(F.slice(values, F.lit(1), F.col("_h")), F.col("_h")))
        tail = F.slice(values, F.col("_h") + 1, F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
        out = out.withColumn(f"_{side}1", _mean(tail, F.col("_n") - F.col("_h")))
    rx = (F.col("_x1") - F.col("_x0")) / F.nullif(F.col("_x0"), F.lit(0.0))
    ry = (F.col("_y1") - F.col("_y0")) / F.nullif(F.col("_y0"), F.lit(0.0))
    numbers = F.forall("_rows", lambda s: (S.finite_status(s["x"].cast("double")) == "ok") & (S.finite_status(s["y"].cast("double")) == "ok"))
    value = F.when(numbers & (F.col("_n") >= MIN_PAIRS), ry / F.nullif(rx, F.lit(0.0)))
    return out.withColumn("finite_difference", value).drop("_n", "_h", "_x0", "_x1", "_y0", "_y1")


def bootstrap_slopes(packed: DataFrame, keys: Sequence[str], replicates: int = R.BOOTSTRAPS,
                     seed: int = R.SEED, level: float = LEVEL) -> DataFrame:
    """Percentile interval of the slope over redrawn days, per key.

    ``packed`` must hold positive x and y. The logs are centred first, which
    keeps the sums of a redraw small and accurate.
    """
    key = F.concat_ws("/", *[F.col(k) for k in keys])
    n = F.size("_rows")
    logs = packed.select(
        *keys, key.alias("_key"), n.alias("_n"),
        F.transform("_rows", lambda s: F.ln(s["x"])).alias("_lx"), F.transform("_rows", lambda s: F.ln(s["y"])).alias("_ly"))
    logs = logs.withColumn("_mx", _mean(F.col("_lx"), F.col("_n"))).withColumn("_my", _mean(F.col("_ly"), F.col("_n")))
    logs = logs.select(*keys, "_key", F.col("_n").alias("_size"), F.transform("_lx", lambda v: v - F.col("_mx")).alias("_a"),
                       F.transform("_ly", lambda v: v - F.col("_my")).alias("_b"))

    def slopes(row: dict, chosen: np.ndarray) -> np.ndarray:
        a, b, size = np.array(row["_a"]), np.array(row["_b"]), row["_size"]
        at = R.draws(row["_number"], chosen, size)
        x, y = a[at], b[at]
        spread = size * (x * x).sum(axis=1) - x.sum(axis=1) ** 2
        return (size * (x * y).sum(axis=1) - x.sum(axis=1) * y.sum(axis=1)) / np.where(spread == 0, np.nan, spread)

    reps = R.count_extremes(logs, keys, replicates, slopes, "_slope double", seed)
    alpha = (1.0 - level) / 2.0
    # a redraw whose x doesn't move has no slope
    per_key = reps.withColumn("_slope", F.nanvl("_slope", F.lit(None).cast("double"))).groupBy(*keys).agg(
        F.count("_slope").alias("valid_draws"),
        F.percentile("_slope", F.array(F.lit(alpha), F.lit(1.0 - alpha))).alias("_q"))
    return per_key.select(*keys, "valid_draws", F.col("_q")[0].alias("draw_low"), F.col("_q")[1].alias("draw_high"))


def estimate(pairs: DataFrame, keys: Sequence[str], replicates: int = R.BOOTSTRAPS, seed: int = R.SEED,
             level: float = LEVEL, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Elasticity per key with interval, method, confidence and notes.

    Log-log regression from ``min_observations`` positive pairs on, otherwise
    the finite difference with half the trust; a key that allows neither is
    refused with a reason, and so is one with a value that isn't finite.
    """
    fit = log_log_fit(pairs, keys)
    packed = finite_difference(pack(pairs, keys))
    rows = packed.join(fit, list(keys))
    regress = (F.col("n") >= min_observations) & F.col("positive") & F.col("x_moves")
    rows = rows.withColumn("_regress", F.coalesce(regress, F.lit(False)))
    draws = bootstrap_slopes(rows.where("_regress").select(*keys, "_rows"), keys, replicates, seed, level)
    last = F.element_at(F.col("_rows"), -1)["x"]
    rows = rows.withColumn("last_x", last).drop("_rows").join(draws, list(keys), "left")
    few = F.col("valid_draws") < replicates // 2
    value = F.when(F.col("_regress"), F.col("slope")).otherwise(F.col("finite_difference"))
    rows = rows.withColumn("value", value).withColumn("_few", F.coalesce(few, F.lit(True)))
    half, more = F.col("value") * 0.5, F.col("value") * 1.5
    use_draws = F.col("_regress") & ~F.col("_few")
    low = F.when(use_draws, F.col("draw_low")).otherwise(half)
    high = F.when(use_draws, F.col("draw_high")).otherwise(more)
    # The regression interval always holds its point estimate.
    low = F.when(F.col("_regress"), F.least(low, F.col("value"))).otherwise(low)
    high = F.when(F.col("_regress"), F.greatest(high, F.col("value"))).otherwise(high)
    rows = rows.withColumn("low", low).withColumn("high", high)
    rows = rows.withColumn("r_squared", F.when(F.col("_regress"), F.col("r_squared")))
    return with_trust(rows, min_observations).withColumn(
        "method", F.when(F.col("value").isNull(), "refused").when(F.col("_regress"), "log_log").otherwise("finite_difference")
    ).withColumn(
        "notes",
        F.filter(F.array(
            F.when(~F.col("finite"), "not finite"),
            F.when(F.col("_regress") & F.col("_few"), "few valid draws"),
            F.when(F.col("_regress") & (F.col("r_squared") < WEAK_FIT), "weak fit"),
            F.when(~F.col("_regress") & (F.col("n") < min_observations), "small sample"),
            F.when(~F.col("_regress") & (F.col("n") >= min_observations) & F.col("finite") & ~F.col("positive"), "non-positive values"),
            F.when(~F.col("_regress") & (F.col("n") >= min_observations) & F.col("positive"), "constant factor"),
        ), lambda x: x.isNotNull()),
    ).drop("_regress", "_few", "draw_low", "draw_high", "slope", "intercept", "finite_difference", "positive", "finite", "x_moves")


def with_trust(rows: DataFrame, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Confidence from sample, fit and width, capped for weak fits and fallbacks."""
    sample = F.least(F.lit(1.0), F.col("n") / F.lit(float(min_observations)))
    fit = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r_squared"))), F.lit(0.0))
    relative = (F.col("high") - F.col("low")) / F.greatest(F.abs("value"), F.lit(1e-6))
    width = F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), relative - WIDE_RATIO))
    total = F.round(
        F.col("sample_part") * WEIGHTS["sample"] + F.col("fit_part") * WEIGHTS["fit"] + F.col("width_part") * WEIGHTS["width"], 4)
    ceiling = (
        F.when(F.col("r_squared").isNull(), F.lit(FALLBACK_CEILING))
        .when(F.col("r_squared") < WEAK_FIT, F.lit(WEAK_FIT_CEILING)).otherwise(F.lit(1.0))
    )
    return (
        rows.withColumn("sample_part", sample).withColumn("fit_part", fit).withColumn("width_part", width)
        .withColumn("confidence", F.when(F.col("value").isNotNull(), F.least(total, ceiling)))
    )


def curve(estimates: DataFrame, keys: Sequence[str], adjustments: Sequence[float] = ADJUSTMENTS,
          max_adjustment: float = MAX_ADJUSTMENT) -> DataFrame:
    """Expected metric and its range for each adjustment of the factor.

    Needs ``base_value`` and ``factor_base``. The range is the envelope over point,
    low and high elasticity, because below 100 % a larger elasticity gives less.
    """
    if not adjustments or any(a <= -1.0 for a in adjustments) or max_adjustment <= 0:
        raise ValueError("adjustments must be listed and lie above -100 %")
    bad = (
        F.when(F.col("value").isNull(), "no elasticity")
        .when(~F.coalesce(F.col("base_value") > 0, F.lit(False)), "base value not positive")
        .when(~F.coalesce(F.col("factor_base") > 0, F.lit(False)), "factor base not positive")
    )
    rows = estimates.withColumn("reason", F.coalesce(bad, F.lit("")))
    steps = F.array(*[F.lit(float(a)) for a in adjustments])
    rows = rows.withColumn("adjustment", F.explode(F.when(bad.isNull(), steps).otherwise(
        F.array(F.lit(None).cast("double")))))
    grow = F.col("adjustment") + 1.0
    points = {c: F.col("base_value") * F.pow(grow, F.col(c)) for c in ("value", "low", "high")}
    beyond = F.abs("adjustment") > max_adjustment + 1e-12
    return rows.select(
        *keys, "method", "reason", "adjustment",
        (F.col("factor_base") * grow).alias("factor_value"),
        points["value"].alias("expected"),
        F.least(*points.values()).alias("expected_low"),
        F.greatest(*points.values()).alias("expected_high"),
        F.coalesce(beyond, F.lit(False)).alias("out_of_range"),
        # the curve's own warnings come first, then the notes of the estimate
        F.array_distinct(F.concat(F.filter(F.array(
            F.when(F.lit(any(abs(a) > max_adjustment + 1e-12 for a in adjustments)), "extrapolated"),
            F.when(F.col("method") == "finite_difference", "fallback"),
            F.when(F.col("r_squared") < WEAK_FIT, "weak fit"),
        ), lambda x: x.isNotNull()), "notes")).alias("warnings"),
    )


def nearest_point(actions: DataFrame, points: DataFrame, on: Sequence[str], wanted: str = "wanted") -> DataFrame:
    """Each action with the curve point nearest to the adjustment it asks for."""
    joined = actions.join(points, list(on), "left").withColumn("_gap", F.abs(F.col("adjustment") - F.col(wanted)))
    pick = F.struct("_gap", "adjustment", "expected", "expected_low", "expected_high")
    best = joined.groupBy(*actions.columns).agg(F.min(F.when(F.col("adjustment").isNotNull(), pick)).alias("_p"))
    return best.select(*actions.columns, "_p.adjustment", "_p.expected", "_p.expected_low", "_p.expected_high")
