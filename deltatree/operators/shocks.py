"""Known shocks put into a fact, the truth they imply, and the evaluation against it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltatree.functions.periods import Period
from deltatree.operators import decompose as D
from deltatree.operators.tree import MetricTree
from deltatree.operators.values import SliceSpec, paired_values, slice_condition, wide_values

ACCEPT_LIMIT = 0.10


@dataclass(frozen=True)
class Shock:
    """One change of known size: ``columns`` are multiplied inside window and slice.

    ``stages`` lists columns in the order of a funnel: a scaled one is never larger than the
    stage before it, whether that one is scaled or not.
    """

    id: str
    factor: str
    columns: tuple[str, ...]
    multiplier: float
    window: Period
    slice: SliceSpec = field(default_factory=dict)
    stages: tuple[str, ...] = ()

    def mask(self) -> Column:
        return self.window.holds(F.col("day")) & slice_condition(self.slice)


def inject_shock(df: DataFrame, shock: Shock) -> DataFrame:
    """Scale the shock's columns; all other rows and columns stay as they are."""
    mask = shock.mask()
    scaled = {name: F.rint(F.col(name) * F.lit(shock.multiplier)).cast("long") for name in shock.columns}
    for before, stage in zip(shock.stages, shock.stages[1:]):
        if stage in scaled:
            scaled[stage] = F.least(scaled[stage], scaled.get(before, F.col(before)))
    return df.select(*[
        F.when(mask, scaled[c]).otherwise(F.col(c)).alias(c) if c in scaled else F.col(c) for c in df.columns
    ])


def check_apart(shocks: Sequence[Shock]) -> None:
    """Shocks that scale a column of the same rows would compound, and their truths would not hold."""
    for i, a in enumerate(shocks):
        for b in shocks[:i]:
            days = a.window.start <= b.window.end and b.window.start <= a.window.end
            rows = all(set(a.slice[k]) & set(b.slice[k]) for k in a.slice.keys() & b.slice.keys())
            if days and rows and set(a.columns) & set(b.columns):
                raise ValueError(f"shocks {b.id} and {a.id} overlap")


def inject_shocks(df: DataFrame, shocks: Sequence[Shock]) -> DataFrame:
    """All shocks, which must not overlap; a column that stages name has to be there."""
    check_apart(shocks)
    for shock in shocks:
        df = inject_shock(df, shock)
    return df


def tag_shocks(df: DataFrame, shocks: Sequence[Shock]) -> DataFrame:
    """Rows of each shock's slice, labelled base (window before) or current."""
    labels = []
    for s in shocks:
        within = slice_condition(s.slice)
        for label, period in (("current", s.window), ("base", s.window.previous())):
            labels.append(F.when(within & period.holds(F.col("day")), F.struct(
                F.lit(s.id).alias("truth_id"), F.lit(s.factor).alias("expected_factor"), F.lit(label).alias("period"))))
    hits = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return df.select("*", F.inline(hits))


def truth_rows(before: DataFrame, shocks: Sequence[Shock], metric: str, weight: str) -> DataFrame:
    """What each shock did, from the fact with and without it.

    The factor is metric per weight when only the metric is scaled, and the
    weight itself when both are; the metric it implies without the shock is
    observed x factor before / factor after.
    """
    hits = []
    for s in shocks:
        scaled = {c: F.rint(F.col(c) * F.lit(s.multiplier)).cast("long") for c in s.columns}
        hits.append(F.when(s.mask(), F.struct(
            F.lit(s.id).alias("truth_id"), F.lit(s.factor).alias("factor"), F.lit(s.multiplier).alias("multiplier"),
            F.lit(weight in s.columns).alias("by_weight"),
            F.col(metric).alias("m0"), F.col(weight).alias("w0"),
            scaled.get(metric, F.col(metric)).alias("m1"), scaled.get(weight, F.col(weight)).alias("w1"))))
    # One pass: every row is tagged with the shocks that hit it, before and after values side by side.
    tagged = before.select(F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    sums = tagged.groupBy("truth_id", "factor", "multiplier", "by_weight").agg(
        *[F.sum(c).alias(c) for c in ("m0", "w0", "m1", "w1")])

    def factor_value(m: str, w: str) -> Column:
        heavy = F.col(w).cast("double")
        return F.when(F.col("by_weight"), heavy).otherwise(F.col(m) / F.nullif(heavy, F.lit(0.0)))

    rows = sums.withColumnRenamed("m1", "observed").withColumn("factor_base", factor_value("m0", "w0")).withColumn(
        "factor_injected", factor_value("observed", "w1"))
    rows = rows.withColumn("counterfactual", D.counterfactual(F.col("observed"), F.col("factor_base"), F.col("factor_injected")))
    rows = rows.withColumn("contribution", F.col("observed") - F.col("counterfactual"))
    again = D.analytic_lmdi(F.col("counterfactual").cast("double"), F.col("observed").cast("double"),
                            F.col("factor_base"), F.col("factor_injected"))
    off = F.abs(again - F.col("contribution"))
    return rows.withColumn("recheck_ok", F.coalesce(off <= 1.0, F.lit(False))).drop("m0", "w0", "w1", "by_weight")


def shock_layers(shocked: DataFrame, tree: MetricTree, shocks: Sequence[Shock], targets: Sequence[str] | None = None) -> DataFrame:
    """Contributions of the root and of the targets below it for every shock's slice and window, with the factor's ``rank`` in its node."""
    keys = ["truth_id", "expected_factor"]
    pairs = paired_values(wide_values(tag_shocks(shocked, shocks), tree, [*keys, "period"]), tree, keys)
    rows = D.decompose(pairs, tree, keys, auto_targets=targets)
    return rows.withColumn("rank", F.row_number().over(D.factor_order(keys)))


def evaluate_targets(layers: DataFrame) -> DataFrame:
    """One row per shock and visited node: its first factor, the rank of the true one (null if it isn't below), and whether it adds up."""
    hit = F.col("factor") == F.col("expected_factor")
    return layers.groupBy("truth_id", "expected_factor", "node").agg(
        F.min_by("factor", "rank").alias("first_factor"), F.min(F.when(hit, F.col("rank"))).alias("rank"),
        F.max("relative").alias("relative"), F.min("conserved").alias("conserved"), F.max("status").alias("status"))


def evaluate_attribution(shocked: DataFrame, tree: MetricTree, shocks: Sequence[Shock], truth: DataFrame,
                         targets: Sequence[str] | None = None) -> DataFrame:
    """Rank of the true factor per shock, its error, and conservation of all visited nodes with the largest residual among them."""
    keys = ["truth_id", "expected_factor"]
    layers = shock_layers(shocked, tree, shocks, targets)
    hit = (F.col("factor") == F.col("expected_factor")) & (F.col("node") == tree.root.code)
    top = F.col("node") == tree.root.code
    found = layers.groupBy(*keys).agg(
        F.min(F.when(hit, F.col("rank"))).alias("rank"),
        F.max(F.when(hit, F.col("contribution"))).alias("found_contribution"),
        F.min_by(F.when(top, F.col("factor")), F.when(top, F.col("rank"))).alias("first_factor"), F.min("conserved").alias("conserved"),
        F.max("relative").alias("max_residual"), F.array_join(F.sort_array(F.collect_set("node")), ",").alias("nodes"),
    )
    known = truth.select("truth_id", F.col("contribution").alias("true_contribution"))
    error = F.abs(F.round("found_contribution") - F.col("true_contribution")) / F.greatest(
        F.abs("true_contribution").cast("double"), F.lit(1.0))
    return found.join(known, "truth_id").select(
        *keys, "first_factor", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("top1_hit"),
        F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("top3_hit"), "true_contribution",
        F.round("found_contribution").cast("long").alias("found_contribution"),
        F.when(F.col("true_contribution") != 0, error).alias("relative_error"), "conserved", "nodes", "max_residual",
    )


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Hit rates, upper median and maximum of the errors."""
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("top1_hit").cast("int")).alias("top1_rate"),
        F.avg(F.col("top3_hit").cast("int")).alias("top3_rate"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY relative_error DESC)").alias("median_relative_error"),
        F.max("relative_error").alias("max_relative_error"),
        F.min("conserved").alias("all_conserved"),
    )


def acceptance_summary(cases: DataFrame, limit: float = ACCEPT_LIMIT) -> DataFrame:
    """Share of negative cases that were wrongly accepted."""
    rate = F.coalesce(F.avg(F.col("accepted").cast("int")), F.lit(0.0))
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), rate.alias("accept_rate"),
        F.count_if(F.col("reason") != "").alias("cases_with_reason"), (rate <= limit).alias("passed"))


def evaluation_history(runs: DataFrame) -> DataFrame:
    """Headline numbers of all stored runs (id, label, dataset, metrics_json), newest first."""
    metrics = F.from_json("metrics_json", "struct<total:long,top1_rate:double,accept_rate:double>")
    return runs.withColumn("m", metrics).select("id", "label", "dataset", "m.total", "m.top1_rate", "m.accept_rate").orderBy(F.col("id").desc())


def stored_truth_check(truth: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored metric and factor values against recomputed ones, keyed by truth_id."""
    joined = truth.join(recomputed, "truth_id", "left")
    return joined.select(
        "truth_id", F.col("observed").eqNullSafe(F.col("observed_now")).alias("metric_equal"),
        F.coalesce(F.abs(F.col("factor_injected") - F.col("factor_now")) <= tolerance, F.lit(False)).alias("factor_equal"))
