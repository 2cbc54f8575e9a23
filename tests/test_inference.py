"""Grouped tests against plain numpy with the same seeded orders."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions import scalar as S
from deltatree.operators import hypotheses as H
from deltatree.operators import inference as I


def order_of(key, b, n, seed=R.SEED):
    """Positions of a replicate by the hash, number by number."""
    def mix(x):
        x = ((x ^ x >> 15) * 0x2C1B3C6D) & 0x7FFFFFFF
        x = ((x ^ x >> 12) * 0x297A2D39) & 0x7FFFFFFF
        return x ^ x >> 15
    number = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF
    row = mix(number ^ ((b * 668265263) & 0x7FFFFFFF))
    return sorted(range(n), key=lambda i: (mix(row ^ ((i * 374761393) & 0x7FFFFFFF)), i))


def shuffled(key, b, values):
    return [values[i] for i in order_of(key, b, len(values))]


@pytest.fixture(scope="module")
def paired():
    rng = random.Random(3)
    out = []
    for key, n in (("a", 40), ("b", 25), ("short", 6)):
        for day in range(n):
            x = rng.randrange(12)
            out.append((key, day, float(x), float(x + rng.randrange(9))))
    out += [("flat", d, 1.0, float(d)) for d in range(20)]
    return pd.DataFrame(out, columns=["k", "day", "x", "y"])


def test_ranks_and_spearman(spark, paired):
    df = spark.createDataFrame(paired)
    got = I.average_ranks(df, ["k"], "x", "r").toPandas().sort_values(["k", "day"])
    want = paired.sort_values(["k", "day"]).groupby("k")["x"].rank()
    assert np.allclose(got["r"], want)
    rho = {r["k"]: r["rho"] for r in I.spearman(df, ["k"]).collect()}
    assert rho["flat"] is None
    a = paired[paired.k == "a"]
    assert rho["a"] == pytest.approx(np.corrcoef(a.x.rank(), a.y.rank())[0, 1])


def test_permutation_correlation(spark, paired):
    got = {r["k"]: r for r in I.permutation_correlation(spark.createDataFrame(paired), ["k"], 100).collect()}
    assert got["short"]["status"] == "sample_too_small" and got["flat"]["status"] == "undefined"
    for key in ("a", "b"):
        g = paired[paired.k == key].sort_values("day")
        rx, ry = g.x.rank().to_numpy() * 2, g.y.rank().to_numpy() * 2
        n, obs = len(g), len(g) * (rx * ry).sum() - rx.sum() * ry.sum()
        extreme = sum(abs(n * (rx * np.array(shuffled(key, b, list(ry)))).sum() - rx.sum() * ry.sum()) >= abs(obs) for b in range(100))
        assert got[key]["p_value"] == pytest.approx((1 + extreme) / 101)


def test_permutation_mean_difference(spark):
    rng = random.Random(4)
    rows = [("k", "in", d, float(rng.randrange(100) + 25)) for d in range(30)] + [("k", "out", d, float(rng.randrange(100))) for d in range(35)]
    rows += [("few", "in", d, 1.0) for d in range(4)] + [("few", "out", d, 2.0) for d in range(40)]
    df = spark.createDataFrame(rows, "k string, side string, day int, value double")
    groups = I.standardized_difference(I.two_groups(df, ["k"]))
    got = {r["k"]: r for r in I.permutation_mean_difference(groups, ["k"], 150).collect()}
    a, b = [r[3] for r in rows[:30]], [r[3] for r in rows[30:65]]
    pooled = a + b
    obs = abs(sum(a) * 65 - sum(pooled) * 30)
    extreme = sum(abs(sum(shuffled("k", rep, pooled)[:30]) * 65 - sum(pooled) * 30) >= obs for rep in range(150))
    assert got["k"]["extreme"] == extreme and got["k"]["p_value"] == pytest.approx((1 + extreme) / 151)
    sd = np.sqrt((29 * np.var(a, ddof=1) + 34 * np.var(b, ddof=1)) / 63)
    assert got["k"]["effect"] == pytest.approx((np.mean(a) - np.mean(b)) / sd)
    assert got["few"]["p_value"] is None and got["few"]["effect"] is None


def test_too_few_replicates(spark):
    with pytest.raises(ValueError):
        R.count_extremes(spark.range(1).withColumn("_key", F.lit("a")), ["id"], 99, len, "x long")


def test_orders_are_fair():
    """Every value reaches every place about equally often."""
    at = R.orders(R.key_number(R.SEED, "k"), np.arange(20_000), 6)
    counts = np.array([np.bincount(at[:, p], minlength=6) for p in range(6)])
    assert abs(counts / 20_000 - 1 / 6).max() < 0.012
    assert len({tuple(r) for r in at.tolist()}) == 720


def test_values_that_are_not_finite(spark, paired):
    bad = spark.createDataFrame(paired).withColumn("x", F.when((F.col("k") == "a") & (F.col("day") == 3), F.lit(float("nan"))).otherwise(F.col("x")))
    got = {r["k"]: r for r in I.permutation_correlation(bad, ["k"], 100).collect()}
    assert (got["a"]["status"], got["a"]["p_value"], got["a"]["statistic"]) == ("not_finite", None, None) and got["b"]["status"] == "ok"
    rows = [("k", side, d, float("inf") if d == 3 else float(d)) for side in ("in", "out") for d in range(20)]
    groups = I.standardized_difference(I.two_groups(spark.createDataFrame(rows, "k string, side string, day int, value double"), ["k"]))
    (r,) = I.with_confidence(I.permutation_mean_difference(groups, ["k"], 100), 21).collect()
    assert (r["effect"], r["p_value"], r["confidence"]) == (None, None, None)


def test_score_tables(spark):
    p = spark.createDataFrame([(v,) for v in (0.009, 0.01, 0.049, 0.05, 0.0999, 0.10, 1.5)], "p double")
    assert [r[0] for r in p.select(S.significance_score(F.col("p"))).collect()] == [1.0, 0.7, 0.7, 0.4, 0.4, 0.0, None]
    e = spark.createDataFrame([(v,) for v in (0.0, -0.2, 0.5, 0.8, -3.0)], "e double")
    assert [r[0] for r in e.select(S.effect_score(F.col("e"))).collect()] == pytest.approx([0.2, 0.2, 0.6, 1.0, 1.0])
    c = spark.createDataFrame([(10, 21), (30, 21), (1, 0)], "c int, r int")
    assert [r[0] for r in c.select(S.coverage_score(F.col("c"), F.col("r"))).collect()] == pytest.approx([10 / 21, 1.0, None])
    d = spark.createDataFrame([(1.0,), (2.0,), (-1.0,), (0.0,)], "v double")
    assert d.agg(S.direction_consistency(F.col("v"))).first()[0] == pytest.approx(2 / 3)
    rates = spark.createDataFrame([(0.3, 0.1), (1.2, 0.1)], "a double, b double")
    assert [r[0] for r in rates.select(S.risk_difference(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.2, None])


def test_last_hard_verdict_wins(spark):
    rows = [("h", 1, "sample", "insufficient_evidence", 0.0), ("h", 2, "control", "passed", 0.0), ("h", 3, "precedence", "cause_after_effect", 0.3),
            ("h", 4, "placebo", "trend_driver", 0.0), ("p", 1, "sample", "passed", 0.0), ("p", 3, "precedence", "cause_after_effect", 0.3), ("q", 1, "sample", "passed", 0.0)]
    df = spark.createDataFrame(rows, "hypothesis_id string, step_order int, step string, verdict string, penalty double")
    got = {r["hypothesis_id"]: r for r in H.combine_checks(df).collect()}
    assert got["h"]["verdict"] == "trend_driver" and got["h"]["excluded"]
    assert got["h"]["reasons"] == "sample:insufficient_evidence;precedence:cause_after_effect;placebo:trend_driver"
    assert got["p"]["verdict"] == "passed_with_penalty" and not got["p"]["excluded"] and got["q"]["verdict"] == "passed"


def test_first_deviation_compares_numbers(spark):
    rows = [("s", d, 10.0 if d == 9 else 1.0 + 0.01 * d) for d in range(20)] + [("t", d, 1.0) for d in range(20)] + [("u", d, float(d)) for d in range(4)]
    df = spark.createDataFrame(rows, "k string, day int, value double")
    got = {r["k"]: r["deviation_day"] for r in H.first_deviation(df, ["k"]).collect()}
    assert got == {"s": 10, "t": None, "u": None}
