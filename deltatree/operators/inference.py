"""Tests on daily series, one row per key.

Series are bounded by the observation window (weeks of days), so one key's
values fit in an array. The arrays are built by a normal aggregate; replicates
are added afterwards, and the shuffle stays at keys x days.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions import scalar as S

MIN_SAMPLE = 8
#: Sums of the same values in another order count as equal.
ROUNDING = 1e-9


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks from 1; tied values share their mean rank."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return rows.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def spearman(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation; NULL below 3 pairs or when one side is constant."""
    ranks = average_ranks(average_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    stats = ranks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"),
        F.covar_pop("_rx", "_ry").alias("_c"),
    )
    defined = (F.col("n") >= 3) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return stats.select(
        *keys, "n",
        F.when(defined, F.col("_c") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))).alias("rho"),
    )


def finite(column: str) -> Column:
    return F.coalesce(S.finite_status(F.col(column).cast("double")) == "ok", F.lit(False))


def _key(keys: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(k) for k in keys])


def permutation_correlation(rows: DataFrame, keys: Sequence[str], replicates: int = R.PERMUTATIONS,
                            seed: int = R.SEED, x: str = "x", y: str = "y", order: str = "day") -> DataFrame:
    """Two-sided test of the rank correlation of paired values.

    A key with a value that isn't finite is not tested (status ``not_finite``).
    The rank sums and spreads do not change under a permutation, so a replicate
    is compared by the sum of rank products around its expectation; twice the
    ranks are whole numbers, which keeps ties exact.
    """
    ranks = average_ranks(average_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    ranks = ranks.withColumn("_rx", (F.col("_rx") * 2).cast("long")).withColumn("_ry", (F.col("_ry") * 2).cast("long"))
    packed = ranks.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_rx").alias("a"), F.col("_ry").alias("b")))).alias("p"),
        F.count(F.lit(1)).alias("n"), F.sum("_rx").alias("_sx"), F.sum("_ry").alias("_sy"),
        F.sum(F.col("_rx") * F.col("_ry")).alias("_sxy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("_sxx"), F.sum(F.col("_ry") * F.col("_ry")).alias("_syy"),
        F.min(finite(x) & finite(y)).alias("finite"),
    )
    n = F.col("n")
    spread_x = n * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    spread_y = n * F.col("_syy") - F.col("_sy") * F.col("_sy")
    packed = (
        packed.withColumn("_key", _key(keys))
        .withColumn("_a", F.transform("p", lambda s: s["a"])).withColumn("_b", F.transform("p", lambda s: s["b"]))
        .withColumn("_obs", n * F.col("_sxy") - F.col("_sx") * F.col("_sy"))
        .withColumn("statistic", F.when(F.col("finite") & (spread_x > 0) & (spread_y > 0), F.col("_obs") / F.sqrt(spread_x.cast("double") * spread_y)))
        .drop("p")
    )
    usable = packed.where((n >= MIN_SAMPLE) & F.col("statistic").isNotNull())

    def extremes(row: dict, replicates: np.ndarray) -> np.ndarray:
        a, b = np.array(row["_a"], np.int64), np.array(row["_b"], np.int64)
        products = (b[R.orders(row["_number"], replicates, a.size)] * a).sum(axis=1)
        return (np.abs(a.size * products - row["_sx"] * row["_sy"]) >= abs(row["_obs"])).sum()

    work = usable.select(*keys, "_key", "_a", "_b", n.alias("_size"), "_sx", "_sy", "_obs")
    extreme = R.count_extremes(work, keys, replicates, extremes, "extreme long", seed).groupBy(*keys).agg(F.sum("extreme").alias("extreme"))
    return _p_values(packed, extreme, keys, replicates)


def _p_values(packed: DataFrame, extreme: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    return packed.select(*keys, "n", "statistic", "finite").join(extreme, list(keys), "left").select(
        *keys, "n", "statistic", "extreme",
        ((F.col("extreme") + 1) / F.lit(float(replicates + 1))).alias("p_value"),
        F.when(~F.col("finite"), "not_finite").when(F.col("extreme").isNotNull(), "ok").when(F.col("n") < MIN_SAMPLE, "sample_too_small")
        .otherwise("undefined").alias("status"),
    )


def two_groups(rows: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value",
               order: str = "day", left: str = "in") -> DataFrame:
    """Per key: the values of both groups as one array, left group first, and moments.

    A key with a value that isn't finite has ``finite`` false, and neither effect nor p-value.
    """
    is_left = F.col(side) == left
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(
            F.when(is_left, 0).otherwise(1).alias("g"), F.col(order).alias("o"), F.col(value).alias("v")
        ))).alias("_rows"),
        F.count_if(is_left).alias("n_in"), F.count_if(~is_left).alias("n_out"),
        F.avg(F.when(is_left, F.col(value))).alias("mean_in"),
        F.avg(F.when(~is_left, F.col(value))).alias("mean_out"),
        F.var_samp(F.when(is_left, F.col(value))).alias("var_in"),
        F.var_samp(F.when(~is_left, F.col(value))).alias("var_out"),
        F.sum(F.when(is_left, F.col(value))).alias("sum_in"), F.sum(value).alias("sum_all"),
        F.min(finite(value)).alias("finite"),
    )


def standardized_difference(groups: DataFrame) -> DataFrame:
    """Mean difference over the pooled sample sigma; needs 3 values a side and a spread."""
    n_in, n_out = F.col("n_in"), F.col("n_out")
    pooled = F.sqrt(((n_in - 1) * F.col("var_in") + (n_out - 1) * F.col("var_out"))
                    / F.nullif((n_in + n_out - 2).cast("double"), F.lit(0.0)))
    return groups.withColumn(
        "effect",
        F.when(F.col("finite") & (n_in >= 3) & (n_out >= 3),
               (F.col("mean_in") - F.col("mean_out")) / F.nullif(pooled, F.lit(0.0))),
    )


def permutation_mean_difference(groups: DataFrame, keys: Sequence[str],
                                replicates: int = R.PERMUTATIONS, seed: int = R.SEED) -> DataFrame:
    """Adds ``extreme`` and ``p_value`` of the mean difference to ``two_groups`` rows.

    With the pooled sum fixed, the difference of means grows with the sum of the
    left group alone.
    """
    n_in, n_out = F.col("n_in"), F.col("n_out")
    named = groups.withColumn("_key", _key(keys))
    usable = named.where(F.col("finite") & (n_in >= MIN_SAMPLE) & (n_out >= MIN_SAMPLE)).select(
        *keys, "_key", F.transform("_rows", lambda s: s["v"].cast("double")).alias("_v"), n_in.alias("_left"), (n_in + n_out).alias("_size"), "sum_in", "sum_all")

    def extremes(row: dict, replicates: np.ndarray) -> np.ndarray:
        v, left, n = np.array(row["_v"]), row["_left"], row["_size"]
        sums = v[R.orders(row["_number"], replicates, n)[:, :left]].sum(axis=1)
        observed = abs(row["sum_in"] * n - row["sum_all"] * left)
        return (np.abs(sums * n - row["sum_all"] * left) >= observed - ROUNDING * max(1.0, observed)).sum()

    extreme = R.count_extremes(usable, keys, replicates, extremes, "extreme long", seed).groupBy(*keys).agg(F.sum("extreme").alias("extreme"))
    return groups.join(extreme, list(keys), "left").withColumn(
        "p_value", (F.col("extreme") + 1) / F.lit(float(replicates + 1))
    )


def with_confidence(rows: DataFrame, required: int, p: str = "p_value", effect: str = "effect",
                    covered: str = "n_in") -> DataFrame:
    """Significance, effect and coverage scores, and their weighted sum."""
    return (
        rows.withColumn("significance_score", S.significance_score(F.col(p)))
        .withColumn("effect_score", S.effect_score(F.col(effect)))
        .withColumn("coverage_score", S.coverage_score(F.col(covered), F.lit(required)))
        .withColumn("confidence", S.confidence(
            F.col("significance_score"), F.col("effect_score"), F.col("coverage_score")))
    )
