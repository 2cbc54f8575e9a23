"""Candidate causes, their tests and the checks against spurious ones.

A hypothesis is a row: slice, factor and expected direction. All tests of all
hypotheses (slice against everything, sub-slice against slice, placebo against
slice) are rows of one test table, and one replicate job answers all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions.periods import Period
from deltatree.operators import inference as I
from deltatree.operators.tree import MetricTree
from deltatree.operators.values import ALL, join_slices, slice_name, unpivot_nodes, wide_values

# Fixed values which decide results.
MAX_HYPOTHESES = 5
OBSERVATION_DAYS = 42
COVERAGE_DAYS = 21
MIN_DAYS = 3
MIN_TOTAL = 60
MIN_CONFIDENCE = 0.6
MIN_SHARE = 0.05
COUNTER_PENALTY = 0.15
PRECEDENCE_PENALTY = 0.3
DEVIATION_SIGMAS = 1.5
SUB_CODES = 3
CONTROL_ALPHA = 0.10
PLACEBO_ALPHA = 0.05
PLACEBO_RATIO = 0.8
HARD_VERDICTS = ("insufficient_evidence", "common_driver", "trend_driver")


def candidates(contributions: DataFrame, slices: DataFrame, tree: MetricTree, limit: int = MAX_HYPOTHESES) -> DataFrame:
    """The largest factors of the root per slice; a contribution of 0 points up.

    ``slices``: slice_id, dims. Each says how it is verified, what would speak against it, and the expression that measures it. A node
    has a handful of children, so the ranking window is small.
    """
    root = tree.root.code
    order = Window.partitionBy("slice_id").orderBy(F.abs("contribution").desc(), "child_order")
    rows = contributions.where((F.col("node") == root) & F.col("contribution").isNotNull())
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    measures = F.create_map(*[x for n in tree.factors(root) for x in (F.lit(n.code), F.lit(n.sql))])
    direction = F.when(F.col("contribution") < 0, "down").otherwise("up")
    free = F.coalesce(_first_free(F.col("dims"), tree.dimensions), F.lit("no dimension"))
    return rows.join(slices, "slice_id").select(
        F.concat_ws("/", "slice_id", "factor").alias("hypothesis_id"), "slice_id", "dims", "factor", "rank",
        "contribution", direction.alias("direction"),
        F.format_string("%s in slice %s drives %s", F.col("factor"), F.col("slice_id"), F.lit(root)).alias("statement"),
        F.format_string("days of %s in slice %s against those of all rows: the mean is %s", F.col("factor"), F.col("slice_id"),
                        F.when(direction == "down", "lower").otherwise("higher")).alias("verification"),
        F.format_string("codes of %s that move the other way", free).alias("counter_check"), measures[F.col("factor")].alias("measure_sql"),
    )


def first_codes(cube: DataFrame, dims: Sequence[str], count: int = SUB_CODES) -> DataFrame:
    """The alphabetically first codes of each dimension, as rows (dimension, code, position)."""
    parts = []
    for dim in dims:
        top = cube.select(F.col(dim).alias("code")).distinct().orderBy("code").limit(count)
        parts.append(top.select(
            F.lit(dim).alias("dimension"), "code",
            F.row_number().over(Window.partitionBy(F.lit(dim)).orderBy("code")).alias("position")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _first_free(dims: Column, names: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(n) for n in names])
    return F.try_element_at(F.array_except(listed, F.map_keys(dims)), F.lit(1))


def tests_for(hypotheses: DataFrame, cube: DataFrame, tree: MetricTree) -> DataFrame:
    """Rows ``(test_id, hypothesis_id, kind, code, factor, in_dims, out_dims)``.

    verify: the slice against the whole population (not its complement).
    control: slice and sub-code against the slice; first free dimension in tree
    order, its first codes. placebo: one code of the alphabetically first free
    dimension alone, against the slice.
    """
    empty = F.map_filter("dims", lambda k, v: F.lit(False))
    verify = hypotheses.select(
        "hypothesis_id", F.lit("verify").alias("kind"), F.lit("").alias("code"), "factor",
        F.col("dims").alias("in_dims"), empty.alias("out_dims"))
    codes = first_codes(cube, tree.dimensions)
    sub = hypotheses.withColumn("dimension", _first_free(F.col("dims"), tree.dimensions)).join(codes, "dimension")
    control = sub.select(
        "hypothesis_id", F.lit("control").alias("kind"), "code", "factor",
        F.map_concat("dims", F.create_map("dimension", F.array("code"))).alias("in_dims"), F.col("dims").alias("out_dims"))
    last = codes.groupBy("dimension").agg(F.max_by("code", "position").alias("code"))
    free = hypotheses.withColumn("dimension", _first_free(F.col("dims"), sorted(tree.dimensions))).join(last, "dimension")
    placebo = free.select(
        "hypothesis_id", F.lit("placebo").alias("kind"), "code", "factor",
        F.create_map("dimension", F.array("code")).alias("in_dims"), F.col("dims").alias("out_dims"))
    return verify.unionByName(control).unionByName(placebo).withColumn(
        "test_id", F.concat_ws("/", "hypothesis_id", "kind", "code"))


def slice_series(cube: DataFrame, tree: MetricTree, slices: DataFrame, window: Period,
                 dims: Sequence[str]) -> DataFrame:
    """Daily value of every node for every slice of a table, inside the window."""
    inside = cube.where(window.holds(F.col("day")))
    rows = join_slices(inside, slices, dims)
    wide = wide_values(rows, tree, ["slice_id", "day"])
    long = unpivot_nodes(wide, tree, ["slice_id", "day"]).withColumnRenamed("code", "factor")
    return long.where(F.col("value").isNotNull())


def test_sides(tests: DataFrame) -> DataFrame:
    """``test_id, factor, side, dims, slice_id``: the slices of both sides of every test, by ``slice_name``."""
    sides = tests.select("test_id", "factor", F.explode(F.array(
        F.struct(F.lit("in").alias("side"), F.col("in_dims").alias("dims")),
        F.struct(F.lit("out").alias("side"), F.col("out_dims").alias("dims")),
    )).alias("s")).select("test_id", "factor", "s.side", "s.dims")
    return sides.withColumn("slice_id", slice_name(F.col("dims")))


def sides_series(sides: DataFrame, series: DataFrame) -> DataFrame:
    """Daily values of both sides of every test: ``test_id, side, day, value``."""
    return sides.drop("dims").join(series, ["slice_id", "factor"]).select("test_id", "side", "day", "value")


def test_series(tests: DataFrame, cube: DataFrame, tree: MetricTree, window: Period, dims: Sequence[str] | None = None) -> DataFrame:
    """``sides_series`` from the cube; ``dims`` are those that slices may fix, the tree's by default."""
    sides = test_sides(tests)
    slices = sides.groupBy("slice_id").agg(F.first("dims").alias("dims"))
    return sides_series(sides, slice_series(cube, tree, slices, window, dims or tree.dimensions))


def run_tests(tests: DataFrame, series: DataFrame, replicates: int = R.PERMUTATIONS, seed: int = R.SEED) -> DataFrame:
    """Sizes, means, effect and p-value per test; tests without data keep a row."""
    groups = I.standardized_difference(I.two_groups(series, ["test_id"]))
    tested = I.permutation_mean_difference(groups, ["test_id"], replicates, seed)
    keep = tested.select("test_id", "n_in", "n_out", "mean_in", "mean_out", "effect", "extreme", "p_value")
    out = tests.select("test_id", "hypothesis_id", "kind", "code", "factor").join(keep, "test_id", "left")
    return out.withColumn("n_in", F.coalesce("n_in", F.lit(0))).withColumn("n_out", F.coalesce("n_out", F.lit(0)))


def verify(hypotheses: DataFrame, results: DataFrame, shares: DataFrame | None = None,
           required: int = COVERAGE_DAYS, window: Period | None = None) -> DataFrame:
    """Status, confidence and reason per hypothesis; ``required`` days, or those of the observation window if it is shorter.

    ``shares`` (slice_id, share): part of the total change; a slice below the
    minimum share cannot be a main cause.
    """
    required = min(required, window.days) if window else required
    tested = results.where(F.col("kind") == "verify").drop("test_id", "kind", "code", "factor")
    rows = I.with_confidence(hypotheses.join(tested, "hypothesis_id", "left"), required)
    if shares is None:
        rows = rows.withColumn("share", F.lit(None).cast("double"))
    else:
        rows = rows.join(shares.select("slice_id", "share"), "slice_id", "left")
    observed = F.when(F.col("mean_in") >= F.col("mean_out"), "up").otherwise("down")
    against = observed != F.col("direction")
    few = (F.col("n_in") < MIN_DAYS) | (F.col("n_out") < MIN_DAYS)
    undefined = F.col("p_value").isNull() | F.col("effect").isNull()
    thin = (F.col("n_in") + F.col("n_out") < MIN_TOTAL) | (F.col("n_in") < required)
    rows = rows.withColumn("_gap", F.when(few, "few_days").when(undefined, "undefined").when(thin, "thin_sample"))
    final = F.when(against, F.greatest(F.lit(0.0), F.col("confidence") - COUNTER_PENALTY)).otherwise(F.col("confidence"))
    small = F.coalesce(F.col("share") < MIN_SHARE, F.lit(False))
    rows = (
        rows.withColumn("direction_ok", F.when(F.col("_gap").isNull(), ~against))
        .withColumn("final_confidence", F.when(F.col("_gap").isNull(), final).otherwise(0.0))
    )
    low = F.round("final_confidence", 12) < MIN_CONFIDENCE
    return (
        rows.withColumn("status", F.when(F.col("_gap").isNotNull(), "insufficient")
                        .when(small | low, "excluded").otherwise("verified"))
        .withColumn("reason", F.coalesce(F.col("_gap"), F.concat_ws(
            ",", F.when(small, "small_share"), F.when(low, "low_confidence"), F.when(against, "counter_example"))))
        .drop("_gap")
    )


def slice_shares(pairs: DataFrame, root: str) -> DataFrame:
    """|change of the slice| over |change of everything|; NULL when the total did not move."""
    change = F.col(f"c_{root}") - F.col(f"b_{root}")
    rows = pairs.select("slice_id", change.alias("delta"))
    total = rows.where(F.col("slice_id") == ALL).agg(F.max("delta")).scalar()
    return rows.select("slice_id", "delta", (F.abs("delta") / F.nullif(F.abs(total), F.lit(0.0))).alias("share"))


def first_deviation(series: DataFrame, keys: Sequence[str], sigmas: float = DEVIATION_SIGMAS) -> DataFrame:
    """Position of the first day far from the mean (5 days and a spread needed)."""
    points = series.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("day", "value"))).alias("_p"), F.count(F.lit(1)).alias("n_days"),
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    far = F.filter(
        F.transform("_p", lambda s, i: F.when(F.abs(s["value"] - F.col("_m")) > F.col("_s") * sigmas, i + 1)),
        lambda x: x.isNotNull())
    usable = (F.col("n_days") >= 5) & (F.col("_s") > 0)
    return points.select(*keys, "n_days", F.when(usable, F.try_element_at(far, F.lit(1))).alias("deviation_day"))


def spurious_checks(hypotheses: DataFrame, results: DataFrame, deviations: DataFrame, root: str,
                    required: int = COVERAGE_DAYS, window: Period | None = None) -> DataFrame:
    """Four check rows per hypothesis, in the order in which they are judged; ``required`` as in ``verify``.

    ``deviations``: slice_id, factor, deviation_day for the factors and the root.
    """
    required = min(required, window.days) if window else required
    ids = hypotheses.select("hypothesis_id", "slice_id", "factor")
    enough = (
        F.col("p_value").isNotNull() & F.col("effect").isNotNull()
        & (F.col("n_in") + F.col("n_out") >= MIN_TOTAL) & (F.col("n_in") >= required)
    )
    tested = results.where(F.col("kind") == "verify").select(
        "hypothesis_id", enough.alias("enough"), F.when(enough, F.abs("effect")).alias("reference_effect"))
    sample = ids.join(tested, "hypothesis_id", "left").select(
        "hypothesis_id", F.lit(1).alias("step_order"), F.lit("sample").alias("step"),
        F.when(F.coalesce("enough", F.lit(False)), "passed").otherwise("insufficient_evidence").alias("verdict"),
        F.lit(0.0).alias("penalty"))
    usable = results.where((F.col("kind") == "control") & F.col("p_value").isNotNull() & F.col("effect").isNotNull())
    strongest = usable.groupBy("hypothesis_id").agg(
        F.min(F.struct((-F.abs("effect")).alias("e"), "code", "p_value")).alias("_b"))
    control = ids.join(strongest, "hypothesis_id", "left").select(
        "hypothesis_id", F.lit(2).alias("step_order"), F.lit("control").alias("step"),
        F.when(F.col("_b").isNull(), "skipped").when(F.col("_b.p_value") >= CONTROL_ALPHA, "common_driver")
        .otherwise("passed").alias("verdict"), F.lit(0.0).alias("penalty"))
    target = deviations.where(F.col("factor") == root).select("slice_id", F.col("deviation_day").alias("target_day"))
    order = ids.join(deviations, ["slice_id", "factor"], "left").join(target, "slice_id", "left")
    late = F.col("deviation_day") > F.col("target_day")
    precedence = order.select(
        "hypothesis_id", F.lit(3).alias("step_order"), F.lit("precedence").alias("step"),
        F.when(late.isNull(), "skipped").when(late, "cause_after_effect").otherwise("passed").alias("verdict"),
        F.when(F.coalesce(late, F.lit(False)), PRECEDENCE_PENALTY).otherwise(0.0).alias("penalty"))
    placebo_test = results.where(F.col("kind") == "placebo").select(
        "hypothesis_id", F.col("p_value").alias("placebo_p"), F.abs("effect").alias("placebo_effect"))
    joined = ids.join(placebo_test, "hypothesis_id", "left").join(tested, "hypothesis_id", "left")
    as_strong = F.col("reference_effect").isNull() | (F.col("placebo_effect") >= F.col("reference_effect") * PLACEBO_RATIO)
    undefined = F.col("placebo_p").isNull() | F.col("placebo_effect").isNull()
    placebo = joined.select(
        "hypothesis_id", F.lit(4).alias("step_order"), F.lit("placebo").alias("step"),
        F.when(undefined, "skipped").when((F.col("placebo_p") < PLACEBO_ALPHA) & as_strong, "trend_driver")
        .otherwise("passed").alias("verdict"), F.lit(0.0).alias("penalty"))
    return sample.unionByName(control).unionByName(precedence).unionByName(placebo)


def combine_checks(checks: DataFrame) -> DataFrame:
    """The last hard verdict decides; penalties add up; every reason is kept."""
    hard = F.col("verdict").isin(*HARD_VERDICTS)
    rows = checks.groupBy("hypothesis_id").agg(
        F.max(F.when(hard, F.struct("step_order", "verdict"))).alias("_v"),
        F.sum("penalty").alias("penalty"),
        F.sort_array(F.collect_list(F.when(hard | (F.col("penalty") > 0), F.struct(
            "step_order", F.concat_ws(":", "step", "verdict").alias("t"))))).alias("_r"),
    )
    return rows.select(
        "hypothesis_id",
        F.coalesce("_v.verdict", F.when(F.col("penalty") > 0, "passed_with_penalty").otherwise("passed")).alias("verdict"),
        "penalty", F.array_join(F.transform("_r", lambda s: s["t"]), ";").alias("reasons"),
        F.col("_v").isNotNull().alias("excluded"),
    )


def apply_checks(verified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final status and confidence after the checks; an excluded one stays as a row.

    A hard verdict excludes. Otherwise the penalties lower the confidence, and one
    that falls below the minimum is excluded too.
    """
    rows = verified.join(verdicts, "hypothesis_id", "left")
    excluded = F.coalesce(F.col("excluded"), F.lit(False))
    penalty = F.coalesce(F.col("penalty"), F.lit(0.0))
    lowered = F.when(~excluded & (penalty > 0), F.greatest(F.lit(0.0), F.col("final_confidence") - penalty)).otherwise(
        F.col("final_confidence"))
    low = (penalty > 0) & (F.round(lowered, 12) < MIN_CONFIDENCE)
    return rows.select(
        *[c for c in verified.columns if c not in ("status", "final_confidence", "reason")],
        "verdict", "penalty", "excluded", F.col("status").alias("verify_status"),
        F.when(excluded | low, "excluded").otherwise(F.col("status")).alias("status"),
        lowered.alias("final_confidence"),
        F.concat_ws(";", F.nullif("reason", F.lit("")), F.nullif("reasons", F.lit(""))).alias("reason"),
        ((F.col("status") == "verified") & ~excluded).alias("accepted"),
    )


def conclude(contributions: DataFrame, verified: DataFrame, matches: DataFrame, root: str) -> DataFrame:
    """One row per slice: main causes, tested hypotheses and outside events.

    ``matches``: slice_id, name, tier. The lists hold a few factors, hypotheses
    and near events of one slice; ``excluded_reasons`` say why each hypothesis that isn't verified is not.
    """
    order = Window.partitionBy("slice_id").orderBy(F.abs("contribution").desc_nulls_last(), "child_order")
    top = contributions.where(F.col("node") == root).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 3)
    causes = top.groupBy("slice_id").agg(
        F.min_by("factor", "_r").alias("primary_cause"),
        F.min_by("contribution", "_r").alias("primary_contribution"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") > 1, F.struct("_r", "factor")))),
                    lambda s: s["factor"]).alias("secondary_causes"),
    )
    kept = F.col("status") == "verified"
    tested = verified.groupBy("slice_id").agg(
        F.sort_array(F.collect_list(F.when(kept, F.col("factor")))).alias("verified_factors"),
        F.sort_array(F.collect_list(F.when(~kept, F.col("factor")))).alias("excluded_factors"),
        F.sort_array(F.collect_list(F.when(~kept, F.concat_ws(": ", "factor", "status", F.nullif("reason", F.lit("")))))).alias("excluded_reasons"))
    outside = matches.where(F.col("tier") == "chain").groupBy("slice_id").agg(
        F.sort_array(F.collect_set("name")).alias("exogenous_events"))
    empty = F.array().cast("array<string>")
    return (
        causes.join(tested, "slice_id", "left").join(outside, "slice_id", "left")
        .withColumn("exogenous_events", F.coalesce("exogenous_events", empty))
    )
