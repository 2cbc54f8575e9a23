"""Metric values: slices, periods, grouping sets and series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.functions.periods import Period, period_label
from deltatree.operators.tree import MetricTree, Node

SliceSpec = dict[str, Sequence[str]]
ALL = "all"


def slice_condition(spec: SliceSpec) -> Column:
    """AND over dimensions, OR inside one. An empty code list is refused."""
    parts = []
    for dim, codes in spec.items():
        if not codes:
            raise ValueError(f"the slice lists no code for {dim}")
        parts.append(F.col(dim).isin(list(codes)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tag_slices(df: DataFrame, slices: dict[str, SliceSpec]) -> DataFrame:
    """One row per slice that holds the row; no join, for a list of named slices."""
    hits = F.array(*[F.when(slice_condition(s), F.lit(k)) for k, s in slices.items()])
    return df.select("*", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("slice_id"))


def canonical_slice(dims: Column) -> Column:
    """Name of a slice map: ``channel=a|b&region=c``, ``all`` for the empty map."""
    entries = F.sort_array(F.map_entries(dims))
    name = F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.sort_array(e["value"]), "|"))), "&")
    return F.when(F.size(entries) == 0, ALL).otherwise(name)


def slice_name(dims: Column) -> Column:
    """A name that no other slice has, whatever signs its codes hold: dimensions and codes in order, as JSON."""
    return F.to_json(F.sort_array(F.transform(F.map_entries(dims), lambda e: F.struct(
        e["key"].alias("d"), F.sort_array(F.array_distinct(e["value"])).alias("c")))))


def slice_problem(dims: Column, names: Sequence[str]) -> Column:
    """Why a slice map can't be used: a dimension that doesn't exist, or a list without codes; NULL if it can."""
    return (
        F.when(F.exists(F.map_keys(dims), lambda k: ~k.isin(list(names))), "unknown_dimension")
        .when(F.exists(F.map_values(dims), lambda codes: F.coalesce(F.size(codes), F.lit(0)) <= 0), "empty_codes")
    )


def check_slices(slices: DataFrame, cube: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows ``(slice_id, status)``: ok, unknown_dimension, empty_codes, or unknown_code if the cube lacks one of the codes."""
    listed = slices.select("slice_id", F.explode_outer("dims").alias("dimension", "codes")).select(
        "slice_id", "dimension", F.explode_outer("codes").alias("code"))
    known = cube.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("code")) for d in dims])).alias("k")).select("k.*").distinct()
    missing = listed.where("code is not null").join(known, ["dimension", "code"], "left_anti").select("slice_id").distinct().withColumn("_lost", F.lit(True))
    return slices.join(missing, "slice_id", "left").select(
        "slice_id", F.coalesce(slice_problem(F.col("dims"), dims), F.when(F.col("_lost"), "unknown_code"), F.lit("ok")).alias("status"))


def _key(names: Sequence[str], code, used) -> Column:
    """Which dimensions are fixed, and their codes, each in a field of its own."""
    mask = reduce(lambda a, b: a + b, [F.when(used(d), F.lit(1 << i)).otherwise(0) for i, d in enumerate(names)], F.lit(0))
    return F.struct(mask.alias("_mask"), *[F.when(used(d), code(d)).otherwise("").alias(d) for d in names])


def slice_keys(slices: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``(slice_id, slice_key)``: one key per combination of the codes of a slice.

    A slice with a ``slice_problem`` has no key; ``check_slices`` reports it.
    """
    names = sorted(dims)
    out = slices.select("slice_id", "dims").where(slice_problem(F.col("dims"), names).isNull())
    for dim in names:
        listed = F.array_distinct(F.try_element_at("dims", F.lit(dim)))
        out = out.withColumn(f"_{dim}", F.explode(F.coalesce(listed, F.array(F.lit(None).cast("string")))))
    return out.select("slice_id", _key(names, lambda d: F.col(f"_{d}"), lambda d: F.col(f"_{d}").isNotNull()).alias("slice_key")).distinct()


def join_slices(cube: DataFrame, slices: DataFrame, dims: Sequence[str]) -> DataFrame:
    """As ``tag_slices`` for a table ``(slice_id, dims map<string, array<string>>)``.

    A cube row offers one key for each set of dimensions that a slice fixes, and a
    slice has one per combination of its codes, so matching is one equi-join whose
    work does not grow with rows x slices. Use it on the cube, not on line rows. Slices that can't be
    used match nothing and are reported by ``check_slices``; none becomes wider.
    """
    names = sorted(dims)
    keys = slice_keys(slices, names)
    # at most one entry for each subset of the dimensions
    masks = keys.agg(F.sort_array(F.collect_set("slice_key._mask"))).scalar()
    offered = cube.withColumn("_use", F.explode(masks))
    offered = offered.withColumn("slice_key", _key(names, F.col, lambda d: F.col("_use").bitwiseAND(1 << names.index(d)) > 0)).drop("_use")
    return offered.join(keys, "slice_key").drop("slice_key")


def slice_sets(cube: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]],
               aggregates: Sequence[Column]) -> DataFrame:
    """Grouping sets over a daily cube, with a readable ``slice_id``.

    Expand multiplies its input by the number of sets, so it is applied to the
    cube and never to line rows. A dimension outside the set shows as NULL.
    """
    dims = sorted({d for s in sets for d in s})
    groups = [[*[F.col(k) for k in keys], *[F.col(d) for d in s]] for s in sets]
    columns = [F.col(c) for c in (*keys, *dims)]
    labels = [F.when(F.grouping(d) == 0, F.concat(F.lit(f"{d}="), F.col(d))).alias(f"_l_{d}") for d in dims]
    grouped = cube.alias("fact").groupingSets(groups, *columns).agg(
        *aggregates, F.grouping_id().alias("grouping_id"), *labels
    )
    name = F.concat_ws("&", *[F.col(f"_l_{d}") for d in dims])
    return grouped.withColumn("slice_id", F.when(name == "", ALL).otherwise(name)).drop(
        *[f"_l_{d}" for d in dims]
    )


def wide_values(fact: DataFrame, tree: MetricTree, keys: Sequence[str]) -> DataFrame:
    """All nodes of the tree in one aggregate per key."""
    return fact.alias("fact").groupBy(*keys).agg(*tree.values())


def unpivot_nodes(wide: DataFrame, tree: MetricTree, keys: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), [n.code for n in tree.nodes()], "code", "value")


def paired_values(wide: DataFrame, tree: MetricTree, keys: Sequence[str],
                  period: str = "period") -> DataFrame:
    """One row per key with ``b_<code>`` and ``c_<code>`` for every node.

    A missing side stays NULL: a NULL aggregate is not a zero. With both periods
    of a key in one row, all decompositions below are plain projections.
    """
    side = F.col(period)
    columns = []
    for node in tree.nodes():
        columns.append(F.max(F.when(side == "base", F.col(node.code))).alias(f"b_{node.code}"))
        columns.append(F.max(F.when(side == "current", F.col(node.code))).alias(f"c_{node.code}"))
    return wide.groupBy(*keys).agg(*columns)


def period_values(cube: DataFrame, tree: MetricTree, base: Period, current: Period,
                  sets: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Values of every node for two periods and all slices of the grouping sets."""
    labelled = cube.withColumn(
        "period", period_label(F.col("day"), {"base": base, "current": current})
    ).where(F.col("period").isNotNull())
    wide = slice_sets(labelled, ["period"], sets, tree.values())
    return paired_values(wide, tree, ["slice_id"])


def period_cells(cube: DataFrame, base: Period, current: Period, dims: Sequence[str]) -> DataFrame:
    """Sums of both periods per combination of codes, which bounds what slices are joined with by the code lists."""
    sums = [c for c in cube.columns if c not in ("day", *dims)]
    period = period_label(F.col("day"), {"base": base, "current": current})
    return cube.withColumn("period", period).where(F.col("period").isNotNull()).groupBy("period", *dims).agg(*[F.sum(c).alias(c) for c in sums])


def slice_pairs(cube: DataFrame, slices: DataFrame, tree: MetricTree, base: Period, current: Period, dims: Sequence[str]) -> DataFrame:
    """As ``period_values`` for a table ``(slice_id, dims)`` of slices, which may have several codes in each of any dimensions.

    A slice without rows, or with a ``status`` other than ok, keeps a row without values.
    """
    cells = period_cells(cube, base, current, dims)
    usable = slices.where(F.col("status") == "ok") if "status" in slices.columns else slices
    wide = wide_values(join_slices(cells, usable.select("slice_id", "dims"), dims), tree, ["period", "slice_id"])
    return slices.select("slice_id").join(paired_values(wide, tree, ["slice_id"]), "slice_id", "left")


def month_pairs(cube: DataFrame, tree: MetricTree, sets: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Every calendar month against the month before, for all slices and nodes.

    Each monthly value is used twice, as current value of its month and as base
    of the next one, so the pairs come from one grouping and need no self-join.
    """
    monthly = slice_sets(
        cube.withColumn("month", F.trunc("day", "month")), ["month"], sets, tree.values()
    )
    sides = monthly.withColumn("side", F.explode(F.array(
        F.struct(F.col("month").alias("month"), F.lit("current").alias("period")),
        F.struct(F.add_months("month", 1).alias("month"), F.lit("base").alias("period")),
    ))).select("side.month", "side.period", "slice_id", *[n.code for n in tree.nodes()])
    return paired_values(sides, tree, ["month", "slice_id"])


def long_pairs(pairs: DataFrame, tree: MetricTree, keys: Sequence[str]) -> DataFrame:
    """``keys, code, base, current`` from the wide pairs."""
    items = F.array(*[
        F.struct(F.lit(n.code).alias("code"), F.col(f"b_{n.code}").alias("base"),
                 F.col(f"c_{n.code}").alias("current"))
        for n in tree.nodes()
    ])
    return pairs.select(*keys, F.inline(items))


def metric_totals(fact: DataFrame, node: Node | Column, dims: Sequence[str]) -> DataFrame:
    """One metric by combination; NULL stays NULL."""
    value = node.value("value") if isinstance(node, Node) else node.alias("value")
    return fact.alias("fact").groupBy(*dims).agg(value)


def daily_series(fact: DataFrame, node: Node | Column, dims: Sequence[str] = ()) -> DataFrame:
    """One metric by day and combination; days without a value are left out."""
    value = node.value("value") if isinstance(node, Node) else node.alias("value")
    series = fact.alias("fact").groupBy(*dims, "day").agg(value)
    return series.where(F.col("value").isNotNull())


def weekly_lags(days: DataFrame, series: DataFrame, keys: Sequence[str], weeks: int = 4) -> DataFrame:
    """Each day with the values of the same weekday 1..weeks weeks before.

    A calendar join, not ``lag``: a day that is missing stays missing.
    """
    wanted = days.select(*keys, "day", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("k"))
    wanted = wanted.withColumn("_lag_day", F.date_sub("day", F.col("k") * 7))
    past = series.select(*keys, F.col("day").alias("_lag_day"), F.col("value").alias("lag_value"))
    return wanted.join(past, [*keys, "_lag_day"], "inner").withColumnRenamed("_lag_day", "lag_day")
