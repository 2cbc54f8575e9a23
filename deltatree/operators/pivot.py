"""Contribution tables by combination of dimension codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions import scalar as S
from deltatree.functions.periods import Period, period_label
from deltatree.operators.ranks import range_ranks
from deltatree.operators.tree import Node, check_dimensions
from deltatree.operators.values import slice_sets

TOP_N = 5


def ranked(df: DataFrame, group: Sequence[str], size: Column, ties: Sequence[str],
           name: str = "rank") -> DataFrame:
    """Rank by size descending, then ``ties``, without one task per group or per size: see ``range_ranks``."""
    return range_ranks(df.withColumn("_size", size), group, [F.col("_size").desc(), *[F.col(t) for t in ties]], name).drop("_size")


def combination_pairs(cube: DataFrame, node: Node, sets: Sequence[Sequence[str]],
                      base: Period, current: Period, keys: Sequence[str] = ()) -> DataFrame:
    """Value of each combination in both periods, for all requested sets at once.

    ``in_base``/``in_current`` say whether the combination occurs; a value may be
    NULL although it does.
    """
    labelled = cube.withColumn(
        "period", period_label(F.col("day"), {"base": base, "current": current})
    ).where(F.col("period").isNotNull())
    dims = sorted({d for s in sets for d in s})
    values = slice_sets(labelled, [*keys, "period"], sets, [node.value("value")])
    return sided(values, [*keys, "grouping_id", *dims, "slice_id"])


def sided(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both periods' ``value`` of a key in one row, and whether it occurs in them."""
    base, current = (F.col("period") == side for side in ("base", "current"))
    return values.groupBy(*keys).agg(
        F.max(F.when(base, F.col("value"))).alias("base"), F.max(F.when(current, F.col("value"))).alias("current"),
        F.max(base).alias("in_base"), F.max(current).alias("in_current"))


def _noted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "note",
        F.when(~F.col("in_base"), "new").when(~F.col("in_current"), "vanished").otherwise(""),
    )


def exact_contributions(pairs: DataFrame) -> DataFrame:
    """Change per combination; the side where it does not occur counts as 0."""
    zero = F.lit(0.0)
    return (
        _noted(pairs)
        .withColumn("base", F.when(F.col("in_base"), F.col("base")).otherwise(zero))
        .withColumn("current", F.when(F.col("in_current"), F.col("current")).otherwise(zero))
        .withColumn("contribution", F.col("current") - F.col("base"))
    )


def allocate_by_share(rows: DataFrame, group: Sequence[str], delta: Column, weight: Column) -> DataFrame:
    """Split one change per group by weights; refused for a negative or zero sum."""
    weighted = rows.withColumn("_w", weight).withColumn("_d", delta)
    sums = weighted.groupBy(*group).agg(
        F.sum("_w").alias("_total"), F.min("_w").alias("_least"),
    )
    status = (
        F.when(F.col("_least") < 0, "negative_share")
        .when(F.coalesce(F.col("_total"), F.lit(0.0)) <= 0, "zero_share")
        .otherwise("heuristic")
    )
    joined = weighted.join(sums, list(group)).withColumn("status", status)
    share = F.col("_d") * F.col("_w") / F.nullif(F.col("_total"), F.lit(0.0))
    return joined.withColumn(
        "contribution", F.when(F.col("status") == "heuristic", share)
    ).drop("_w", "_d", "_total", "_least")


def dimension_tables(cube: DataFrame, node: Node, sets: Sequence[Sequence[str]], base: Period,
                     current: Period, top_n: int = TOP_N, keys: Sequence[str] = ()) -> DataFrame:
    """Ranked contribution tables for every set of dimensions in one job.

    A set whose combinations all have values is exact. If one value is NULL, the
    change of the layer is split by the current shares and marked heuristic. The
    change of the layer comes from its own grouping set ``()``. Sets with unknown, repeated or
    too many dimensions are refused before any job runs.
    """
    wanted = [check_dimensions(s, cube.columns) for s in sets if s]
    dims = sorted({d for s in wanted for d in s})
    return contribution_tables(combination_pairs(cube, node, [(), *wanted], base, current, keys), 2 ** len(dims) - 1, keys, top_n)


def contribution_tables(pairs: DataFrame, total_id: int, keys: Sequence[str] = (), top_n: int = TOP_N) -> DataFrame:
    """The tables of ``dimension_tables`` from the pairs of their combinations; rows of ``total_id`` are the layers.

    A layer without rows in a period counts as 0 there, as a combination does.
    """
    group = [*keys, "grouping_id"]
    layer = pairs.where(F.col("grouping_id") == total_id).select(
        *keys, *[F.when(F.col(f"in_{side}"), F.col(side)).otherwise(0.0).alias(f"layer_{side}") for side in ("base", "current")])
    rows = exact_contributions(pairs.where(F.col("grouping_id") != total_id))
    null_here = (F.col("in_base") & F.col("base").isNull()) | (F.col("in_current") & F.col("current").isNull())
    rows = rows.withColumn("_null", null_here)
    # The weight of a share split: current values that exist.
    rows = rows.withColumn("_w", F.when(F.col("in_current"), F.col("current")))
    facts = rows.groupBy(*group).agg(
        F.max("_null").alias("heuristic"), F.sum("_w").alias("_total"), F.min("_w").alias("_least"),
    )
    joined = rows.join(facts, group)
    if keys:
        joined = joined.join(layer, list(keys))
    else:  # one layer row: read it as a scalar subquery, not as a join side
        joined = joined.select(
            "*", layer.select("layer_base").scalar().alias("layer_base"),
            layer.select("layer_current").scalar().alias("layer_current"),
        )
    layer_delta = F.col("layer_current") - F.col("layer_base")
    refused = F.col("heuristic") & ((F.col("_least") < 0) | (F.coalesce(F.col("_total"), F.lit(0.0)) <= 0))
    value = (
        F.when(refused, F.lit(None).cast("double"))
        .when(F.col("heuristic"), layer_delta * F.col("_w") / F.nullif(F.col("_total"), F.lit(0.0)))
        .otherwise(F.col("contribution"))
    )
    table = (
        joined.withColumn("contribution", value)
        .withColumn("layer_delta", layer_delta)
        .withColumn("status", F.when(refused, "share_refused").when(F.col("heuristic"), "heuristic").otherwise("exact"))
        # A share split lists only the combinations which carry a weight.
        .where(~F.col("heuristic") | F.col("_w").isNotNull())
        .drop("_null", "_w", "_total", "_least", "in_base", "in_current")
    )
    return add_ranks(table, group, ["slice_id"], top_n)


def add_ranks(table: DataFrame, group: Sequence[str], ties: Sequence[str], top_n: int = TOP_N,
              tolerance: float = S.TOLERANCE) -> DataFrame:
    """Rank, TOP flag, rate, coverage and the check against the layer's change."""
    size = F.coalesce(F.abs("contribution"), F.lit(0.0))
    out = ranked(table, group, size, ties)
    out = out.withColumn("in_top", F.col("rank") <= top_n)
    sums = out.groupBy(*group).agg(
        F.sum("contribution").alias("sum_contribution"),
        F.sum(F.abs("contribution")).alias("_all"),
        F.sum(F.when(F.col("in_top"), F.abs("contribution"))).alias("_top"),
    )
    sums = sums.withColumn("coverage", F.coalesce(F.col("_top") / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0)))
    out = out.join(sums.drop("_all", "_top"), list(group))
    relative = S.relative_residual(F.col("sum_contribution"), F.col("layer_delta"))
    return (
        out.withColumn("rate", S.rate(F.col("contribution"), F.col("sum_contribution")))
        .withColumn("relative", relative)
        .withColumn("passed", F.coalesce(F.col("relative") < tolerance, F.lit(False)))
        .withColumn("table_note", F.when(F.col("sum_contribution") == 0, "no_change").otherwise(""))
    )


def highlights(table: DataFrame, group: Sequence[str]) -> DataFrame:
    """Largest absolute contribution, deepest drag and coverage per table."""
    return table.groupBy(*group).agg(
        F.min_by("slice_id", "rank").alias("largest"),
        F.min_by("contribution", "rank").alias("largest_contribution"),
        F.min(F.struct("contribution", "rank", "slice_id")).alias("_low"),
        F.max("coverage").alias("coverage"),
        F.max("layer_delta").alias("layer_delta"),
        F.count(F.lit(1)).alias("combinations"),
        F.min("passed").alias("passed"),
        F.max("relative").alias("relative"),
    ).select(
        *group, "largest", "largest_contribution",
        F.col("_low.slice_id").alias("lowest"), F.col("_low.contribution").alias("lowest_contribution"),
        "coverage", "layer_delta", "combinations", "passed", "relative",
    )
