"""Drill-down of many slices at once: every slice is pivoted by its own free dimensions, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions.periods import Period
from deltatree.operators import pivot as P
from deltatree.operators.report import cross_check
from deltatree.operators.tree import MAX_DIMENSIONS, MetricTree
from deltatree.operators.values import join_slices, period_cells

DRILLED = "drilled"


def default_pivots(dims: Column, tree: MetricTree) -> Column:
    """One pivot for each dimension of the tree that the slice leaves free, three at most; for each of the tree's if it leaves none."""
    names = F.array(*[F.lit(n) for n in tree.dimensions])
    free = F.array_except(names, F.map_keys(dims))
    chosen = F.when(F.size(free) > 0, free).otherwise(names)
    return F.transform(F.slice(chosen, 1, MAX_DIMENSIONS), lambda n: F.array(n))


def pivot_plans(slices: DataFrame, tree: MetricTree, dims: Sequence[str]) -> DataFrame:
    """Rows ``(slice_id, pivot, mask, status)``: what each slice is pivoted by.

    ``slices`` may have ``pivots`` (lists of dimensions); where it is null, or there is none, those of ``default_pivots`` hold. A pivot
    without, with repeated, with unknown or with more than three dimensions is refused by its status.
    """
    names = sorted(dims)
    own = F.col("pivots") if "pivots" in slices.columns else F.lit(None).cast("array<array<string>>")
    rows = slices.select("slice_id", F.explode(F.coalesce(own, default_pivots(F.col("dims"), tree))).alias("p"))
    known = F.array(*[F.lit(n) for n in names])
    mask = F.aggregate(F.col("p"), F.lit(0), lambda a, n: a + F.coalesce(F.element_at(F.create_map(
        *[x for i, n_ in enumerate(names) for x in (F.lit(n_), F.lit(1 << i))]), n), F.lit(0)))
    status = (
        F.when(F.size("p") == 0, "no_dimension").when(F.size(F.array_distinct("p")) < F.size("p"), "repeated_dimension")
        .when(F.size(F.array_except("p", known)) > 0, "unknown_dimension").when(F.size("p") > MAX_DIMENSIONS, "too_many_dimensions").otherwise("ok"))
    return rows.select("slice_id", F.array_join("p", ",").alias("pivot"), F.when(status == "ok", mask).alias("mask"), status.alias("status")).distinct()


def drilldown(cube: DataFrame, slices: DataFrame, plans: DataFrame, tree: MetricTree, base: Period, current: Period, dims: Sequence[str],
              top_n: int = P.TOP_N) -> DataFrame:
    """Ranked contribution tables as ``dimension_tables`` gives them, for each slice and each of its plans.

    Periods are summed per combination of codes first; a row then stands once for every plan of every slice that holds it, with the
    codes of the plan's dimensions only, so all tables come from one aggregate. ``layer_delta`` comes from a plan without dimensions.
    """
    names = sorted(dims)
    rows = join_slices(period_cells(cube, base, current, dims), slices.select("slice_id", "dims"), dims).withColumnRenamed("slice_id", DRILLED)
    good = plans.where(F.col("status") == "ok").groupBy("slice_id").agg(F.collect_set("mask").alias("masks")).select(
        F.col("slice_id").alias("_of"), F.array_union(F.array(F.lit(0)), "masks").alias("masks"))
    rows = rows.join(good, F.col(DRILLED) == F.col("_of")).withColumn("mask", F.explode("masks")).drop("_of", "masks")

    def used(i: int) -> Column:
        return F.col("mask").bitwiseAND(1 << i) > 0

    rows = rows.select(DRILLED, "mask", "period", *[F.when(used(i), F.col(n)).alias(n) for i, n in enumerate(names)],
                       *[c for c in rows.columns if c not in (DRILLED, "mask", "period", *names)])
    values = rows.alias("fact").groupBy(DRILLED, "mask", *names, "period").agg(tree.root.value("value"))
    label = F.concat_ws("&", *[F.when(used(i), F.concat(F.lit(f"{n}="), F.col(n))) for i, n in enumerate(names)])
    pairs = P.sided(values.withColumn("slice_id", label).withColumnRenamed("mask", "grouping_id"), [DRILLED, "grouping_id", *names, "slice_id"])
    table = P.contribution_tables(pairs, 0, [DRILLED], top_n)
    titles = plans.where(F.col("status") == "ok").select(F.col("slice_id").alias("_of"), "mask", "pivot")
    return table.join(titles, (F.col(DRILLED) == F.col("_of")) & (F.col("grouping_id") == F.col("mask"))).select(
        F.col(DRILLED).alias("slice_id"), "pivot", F.col("slice_id").alias("combination"), "base", "current", "contribution", "rank", "in_top", "rate", "coverage",
        "layer_delta", "relative", "passed", "status", "note", "table_note")


def drilldown_ledger(table: DataFrame, contributions: DataFrame, pairs: DataFrame, root: str) -> DataFrame:
    """Conservation layer by layer: ``(slice_id, layer, source, relative, passed, crossed)``.

    A node of the tree against its contributions; a pivot against its rows, and ``crossed``: whether the change of its layer is the change
    of the root that the tree path found for the slice (null where a period has no rows: the tree then has no change).
    """
    nodes = contributions.where(F.col("status").isin("ok", "zero_substituted")).groupBy("slice_id", "node").agg(
        F.max("relative").alias("relative"), F.min("conserved").alias("passed")).select(
        "slice_id", F.concat(F.lit("tree:"), "node").alias("layer"), F.lit("decomposition").alias("source"), "relative", "passed",
        F.lit(None).cast("boolean").alias("crossed"))
    layers = table.groupBy("slice_id", "pivot").agg(
        F.max("relative").alias("relative"), F.min("passed").alias("passed"), F.max("layer_delta").alias("delta"))
    own = pairs.select("slice_id", (F.col(f"c_{root}") - F.col(f"b_{root}")).alias("delta"))
    tree = layers.select("slice_id", "pivot").join(own, "slice_id")
    found = F.when(F.col("tree_delta").isNotNull(), F.col("passed"))
    checked = cross_check(tree, layers, ["slice_id", "pivot"]).select("slice_id", "pivot", found.alias("crossed"))
    return nodes.unionByName(layers.join(checked, ["slice_id", "pivot"]).select(
        "slice_id", F.concat(F.lit("pivot:"), "pivot").alias("layer"), F.lit("dimension_table").alias("source"), "relative", "passed", "crossed"))


def drilldown_highlights(table: DataFrame) -> DataFrame:
    """Largest contribution, deepest drag and coverage of every pivot of every slice."""
    named = table.withColumnRenamed("slice_id", DRILLED).withColumnRenamed("combination", "slice_id")
    return P.highlights(named, [DRILLED, "pivot"]).withColumnRenamed(DRILLED, "slice_id")
