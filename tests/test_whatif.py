import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions.periods import Period
from deltatree.operators import whatif as W
from deltatree.plans.common import retail

SCHEMA = "k string, day int, x double, y double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for d in range(80):
        x = rng.uniform(1, 3)
        out.append(("power", d, x, 5 * x ** 1.5))
        out.append(("noisy", d, x, 5 * x ** -0.8 * math.exp(rng.gauss(0, 0.3))))
        out.append(("flat_y", d, x, 4.0))
        out.append(("flat_x", d, 2.0, x))
    out += [("short", d, 1.0 + d, 10.0 + 2 * d) for d in range(10)] + [("tiny", d, 1.0, 1.0) for d in range(3)]
    return out


def test_estimates(spark, rows):
    got = {r["k"]: r for r in W.estimate(spark.createDataFrame(rows, SCHEMA), ["k"], 120).collect()}
    assert got["power"]["method"] == "log_log" and got["power"]["value"] == pytest.approx(1.5)
    assert got["power"]["low"] <= got["power"]["value"] <= got["power"]["high"] and got["power"]["r_squared"] == pytest.approx(1)
    assert got["flat_y"]["r_squared"] == 0 and got["flat_y"]["confidence"] <= 0.40 and "weak fit" in got["flat_y"]["notes"]
    short = got["short"]
    want = ((np.mean([10 + 2 * d for d in range(5, 10)]) - 14) / 14) / ((np.mean(range(6, 11)) - 3) / 3)
    assert short["method"] == "finite_difference" and short["value"] == pytest.approx(want)
    assert (short["low"], short["high"]) == pytest.approx((want * 0.5, want * 1.5)) and short["confidence"] <= 0.5
    assert got["tiny"]["method"] == "refused" and got["flat_x"]["method"] == "refused"


def test_one_day_that_is_not_finite(spark, rows):
    bad = [("nan", d, float("nan") if d == 5 else 1.0 + d, 2.0 + d) for d in range(70)] + [("inf", d, 1.0 + d, float("inf") if d == 5 else 2.0 + d) for d in range(20)]
    got = {r["k"]: r for r in W.estimate(spark.createDataFrame(bad, SCHEMA), ["k"], 120).collect()}
    for key in ("nan", "inf"):
        assert (got[key]["method"], got[key]["value"], got[key]["confidence"]) == ("refused", None, None) and "not finite" in got[key]["notes"]


def test_bootstrap_against_numpy(spark, rows):
    noisy = [(math.log(r[2]), math.log(r[3])) for r in rows if r[0] == "noisy"]
    slopes = []
    for b in range(120):
        pick = R.draws(R.key_number(R.SEED, "noisy"), np.array([b]), 80)[0]
        lx, ly = np.array([noisy[i][0] for i in pick]), np.array([noisy[i][1] for i in pick])
        slopes.append(np.cov(lx, ly, bias=True)[0, 1] / np.var(lx))
    packed = W.pack(spark.createDataFrame([r for r in rows if r[0] == "noisy"], SCHEMA), ["k"])
    got = W.bootstrap_slopes(packed, ["k"], 120).first()
    assert got["valid_draws"] == 120
    assert (got["draw_low"], got["draw_high"]) == pytest.approx(tuple(np.quantile(slopes, [0.05, 0.95])))


def test_curve_envelope_and_refusals(spark):
    data = [("a", 1.0, 0.5, 2.0, 100.0, 10.0), ("b", 1.0, 0.5, 2.0, -1.0, 10.0), ("c", None, None, None, 100.0, 10.0), ("d", 1.0, 0.5, 2.0, 100.0, 0.0)]
    est = spark.createDataFrame(data, "k string, value double, low double, high double, base_value double, factor_base double").withColumn(
        "method", F.lit("log_log")).withColumn("notes", F.array().cast("array<string>")).withColumn("r_squared", F.lit(0.9))
    out = W.curve(est, ["k"], (-0.3, 0.0, 0.5)).collect()
    down = next(r for r in out if r["k"] == "a" and r["adjustment"] == -0.3)
    assert down["expected"] == pytest.approx(70) and down["expected_low"] == pytest.approx(49) and down["expected_high"] == pytest.approx(100 * 0.7 ** 0.5)
    assert [r["out_of_range"] for r in out if r["k"] == "a"] == [False, False, True]
    assert {r["k"]: r["reason"] for r in out} == {"a": "", "b": "base value not positive", "c": "no elasticity", "d": "factor base not positive"}
    with pytest.raises(ValueError):
        W.curve(est, ["k"], (-1.0,))


DAYS = [date(2020, 1, 1) + timedelta(days=i) for i in range(80)]
KNOBS = (
    W.Knob("retail", "avg_price", "price", "CAST(SUM(fact.revenue_cents) AS DOUBLE) / NULLIF(SUM(fact.units), 0)"),
    W.Knob("retail", "rush_share", "rush", "CAST(SUM(CASE WHEN is_rush THEN fact.units ELSE 0 END) AS DOUBLE) / NULLIF(SUM(fact.units), 0)", proxy="urgency"),
    W.Knob("retail", "lines_mix", "mix", "", "it follows from the orders"),
    W.Knob("margin", "tax_rate", "tax", "SUM(fact.tax_cents)"),
)
WINDOW, NOW = Period("2020-01-01", "2020-03-20"), Period("2020-03-01", "2020-03-20")


@pytest.fixture(scope="module")
def knob_case(spark):
    """Revenue grows with the square of the price in channel A and with the share of A over both; B & C is one code."""
    rows = []
    for i, day in enumerate(DAYS):
        price = 100 + i % 13
        rows.append((day, "A", "n", 10 + i % 5, (10 + i % 5) * price))
        rows.append((day, "B & C", "n", 20, 20 * (90 + i % 7)))
        if i < 3:
            rows.append((day, "D", "s", 5, 500))
    cube = spark.createDataFrame(rows, "day date, channel string, region string, units long, revenue_cents long").withColumn("orders", F.col("units")).withColumn("lines", F.col("units"))
    slices = spark.createDataFrame([("all", {}), ("a", {"channel": ["A"]}), ("two", {"channel": ["A", "B & C"], "region": ["n"]}), ("d", {"channel": ["D"]}),
                                    ("none", {"channel": ["Z"]})], "slice_id string, dims map<string, array<string>>")
    urgency = spark.createDataFrame([("A", True), ("B & C", False)], "code string, is_rush boolean")
    return cube, slices, {"urgency": W.Proxy("channel", urgency)}


def test_what_if_from_the_expression_of_the_knob(spark, knob_case):
    cube, slices, proxies = knob_case
    wanted = slices.select("slice_id", F.explode(F.array(*[F.lit(f) for f in ("avg_price", "rush_share", "lines_mix", "tax_rate", "weather")])).alias("factor"))
    requests = wanted.withColumn("request_id", F.concat_ws("/", "slice_id", "factor"))
    rows = W.run_whatif(requests, cube, slices, ("channel", "region"), retail(), KNOBS, proxies, WINDOW, NOW, (-0.1, 0.0, 0.1), replicates=200).collect()
    got = {}
    for x in rows:
        got.setdefault(x.request_id, []).append(x)
    assert len(got) == 25
    assert got["a/lines_mix"][0].reason == "it follows from the orders" and got["a/lines_mix"][0].status == "not_estimable"
    assert got["a/weather"][0].status == "not_intervenable" and got["a/tax_rate"][0].status == "no_proxy"
    assert {x.reason for x in got["none/avg_price"]} == {"no observations"} and got["none/avg_price"][0].adjustment is None
    assert got["d/avg_price"][0].reason == "no elasticity"  # three days
    assert {x.reason for x in got["a/rush_share"]} == {"no elasticity"}  # the share of one channel doesn't move
    for name in ("all", "a", "two"):
        inside = [x for x in cube.collect() if (name != "a" or x.channel == "A") and (name != "two" or x.region == "n")]
        now = [x for x in inside if NOW.start <= x.day.isoformat() <= NOW.end]
        curve = {x.adjustment: x for x in got[f"{name}/avg_price"]}
        assert curve[0.0].base_value == curve[0.0].expected == sum(x.revenue_cents for x in now)
        assert curve[0.1].factor_value == pytest.approx(1.1 * sum(x.revenue_cents for x in now) / sum(x.units for x in now))
        assert curve[0.0].method == "log_log" and curve[0.1].expected_low <= curve[0.1].expected <= curve[0.1].expected_high
    share = {x.adjustment: x for x in got["two/rush_share"]}
    urgent = sum(x.units for x in cube.collect() if x.channel == "A" and x.day.isoformat() >= NOW.start)
    everything = sum(x.units for x in cube.collect() if x.region == "n" and x.day.isoformat() >= NOW.start)
    assert share[0.0].factor_value == pytest.approx(urgent / everything)


def test_combinations_stand_in_columns(spark, knob_case):
    cube, slices, proxies = knob_case
    rows = W.whatif_by(cube, slices.where("slice_id = 'all'"), ("channel", "region"), ("channel", "region"), retail(), KNOBS, proxies, WINDOW, NOW, (0.0,), replicates=200).collect()
    keys = {(x.factor, x.channel, x.region) for x in rows}
    assert keys == {(f, c, g) for f in ("avg_price", "rush_share") for c, g in (("A", "n"), ("B & C", "n"), ("D", "s"))}
    last = next(x for x in rows if (x.factor, x.channel) == ("avg_price", "A"))
    assert last.factor_value == 100 + 79 % 13 and last.n == 80
    with pytest.raises(ValueError):
        W.whatif_by(cube, slices, ("channel", "region"), ("colour",), retail(), KNOBS, proxies, WINDOW, NOW)


def test_proxies_that_do_not_fit(spark, knob_case):
    cube, _, proxies = knob_case
    with pytest.raises(ValueError, match="no table"):
        W.with_proxies(cube, KNOBS, {})
    clash = W.Proxy("channel", proxies["urgency"].table.withColumnRenamed("is_rush", "units"))
    with pytest.raises(ValueError, match="already"):
        W.with_proxies(cube, KNOBS, {"urgency": clash})
