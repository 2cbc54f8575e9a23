"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values which decide results.
TOLERANCE = 1e-9
ZERO_FLOOR = 1e-9
ZERO_SHARE = 0.01
SIGNIFICANCE_BANDS = ((0.01, 1.0), (0.05, 0.7), (0.10, 0.4))
CONFIDENCE_WEIGHTS = {"significance": 0.40, "effect": 0.35, "coverage": 0.25}
EFFECT_SMALL = 0.2
EFFECT_LARGE = 0.8
EFFECT_FLOOR = 0.2


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, NULL for a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def log_mean(a: Column, b: Column) -> Column:
    """Logarithmic mean; a when both are equal, NULL when one is not positive."""
    return (
        F.when(a == b, a)
        .when((a > 0) & (b > 0), (a - b) / F.nullif(F.ln(a) - F.ln(b), F.lit(0.0)))
    )


def lmdi_term(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Share of factor x in the change of the product from y0 to y1."""
    ok = (x0 > 0) & (x1 > 0) & (y0 > 0) & (y1 > 0)
    return F.when(ok, log_mean(y1, y0) * (F.ln(x1) - F.ln(x0)))


def rate(contribution: Column, delta: Column) -> Column:
    """contribution/delta; NULL, never 0, when nothing changed."""
    return contribution / F.nullif(delta, F.lit(0.0))


def relative_residual(total: Column, delta: Column) -> Column:
    return F.abs(total - delta) / F.greatest(F.abs(delta), F.lit(1.0))


def zero_replacement(x0: Column, x1: Column) -> Column:
    """Small positive stand-in for a factor value of zero.

    1 % of the smaller non-zero absolute value of the factor, at least 1e-9; a
    factor which is zero in both periods gets 1.0 twice and contributes nothing.
    """
    smallest = F.least(F.nullif(F.abs(x0), F.lit(0.0)), F.nullif(F.abs(x1), F.lit(0.0)))
    return F.when(smallest.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(ZERO_FLOOR), smallest * ZERO_SHARE))


def significance_score(p: Column) -> Column:
    expr = F.when((p < 0) | (p > 1), F.lit(None).cast("double"))
    for upper, score in SIGNIFICANCE_BANDS:
        expr = expr.when(p < upper, F.lit(score))
    return expr.when(p.isNotNull(), F.lit(0.0))


def effect_score(effect: Column, small: float = EFFECT_SMALL, large: float = EFFECT_LARGE) -> Column:
    if small <= 0 or large <= small:
        raise ValueError(f"effect thresholds out of order: {small}, {large}")
    size = F.abs(effect)
    slope = (size - small) / (large - small)
    return (
        F.when(size <= small, F.lit(EFFECT_FLOOR))
        .when(size >= large, F.lit(1.0))
        .when(size.isNotNull(), F.lit(EFFECT_FLOOR) + slope * (1.0 - EFFECT_FLOOR))
    )


def coverage_score(covered: Column, required: Column) -> Column:
    share = covered.cast("double") / F.nullif(required.cast("double"), F.lit(0.0))
    return F.when(required > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def confidence(significance: Column, effect: Column, coverage: Column) -> Column:
    parts = (
        significance * CONFIDENCE_WEIGHTS["significance"],
        effect * CONFIDENCE_WEIGHTS["effect"],
        coverage * CONFIDENCE_WEIGHTS["coverage"],
    )
    return reduce(lambda a, b: a + b, parts)


def risk_difference(a: Column, b: Column) -> Column:
    """a - b for rates; NULL when one of them is not a rate."""
    return F.when(a.between(0.0, 1.0) & b.between(0.0, 1.0), a - b)


def direction_consistency(values: Column) -> Column:
    """Aggregate: share of the larger sign among the non-zero values."""
    up, down = F.count_if(values > 0), F.count_if(values < 0)
    return F.coalesce(F.greatest(up, down) / F.nullif((up + down).cast("double"), F.lit(0.0)), F.lit(0.0))


def finite_status(value: Column) -> Column:
    return (
        F.when(value.isNull(), "missing")
        .when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), "infinite")
        .otherwise("ok")
    )
