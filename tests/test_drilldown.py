"""Drill-down of a table of slices: default and wanted pivots, refusals, sums against plain ones, cross-checks."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from deltatree.functions.periods import Period
from deltatree.operators import decompose as D
from deltatree.operators import drilldown as L
from deltatree.operators import values as V
from deltatree.plans.common import retail

BASE, CURRENT = Period("2020-01-01", "2020-01-05"), Period("2020-01-06", "2020-01-10")
DIMS = ("channel", "nation", "region", "segment")
SLICES = [
    ("all", {}, None), ("one", {"channel": ["A"]}, None), ("two", {"channel": ["A", "B"], "region": ["n"]}, None),
    ("locked", {"channel": ["A"], "region": ["n"], "segment": ["1"]}, None),
    ("asked", {"region": ["s"]}, [["nation"], ["channel", "segment"], ["region"]]),
    ("refused", {}, [[], ["channel", "channel"], ["colour"], list(DIMS), ["segment"]]),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [(date(2020, 1, 1) + timedelta(days=rng.randrange(10)), rng.choice("ABC"), rng.choice("xyz"), rng.choice("ns"), rng.choice("12"), rng.randrange(1, 5),
             rng.randrange(1, 9), rng.randrange(100, 900)) for _ in range(300)]


@pytest.fixture(scope="module")
def made(spark, rows):
    cube = spark.createDataFrame(rows, "day date, channel string, nation string, region string, segment string, orders long, units long, revenue_cents long")
    cube = cube.groupBy("day", *DIMS).agg(*[F.sum(c).alias(c) for c in ("orders", "units", "revenue_cents")]).withColumn("lines", F.col("units"))
    slices = spark.createDataFrame(SLICES, "slice_id string, dims map<string, array<string>>, pivots array<array<string>>")
    plans = L.pivot_plans(slices, retail(), DIMS)
    return cube, slices, plans, L.drilldown(cube, slices, plans, retail(), BASE, CURRENT, DIMS, 2)


def test_plans(made):
    plans = {(r.slice_id, r.pivot): r.status for r in made[2].collect()}
    ok = {k for k, status in plans.items() if status == "ok"}
    assert ok == {("all", "channel"), ("all", "region"), ("all", "segment"), ("one", "region"), ("one", "segment"), ("two", "segment"),
                  ("locked", "channel"), ("locked", "region"), ("locked", "segment"), ("asked", "nation"), ("asked", "channel,segment"), ("asked", "region"),
                  ("refused", "segment")}
    assert {s for k, s in plans.items() if k not in ok} == {"no_dimension", "repeated_dimension", "unknown_dimension", "too_many_dimensions"}


def test_every_slice_has_its_own_tables(rows, made):
    got = {}
    for r in made[3].collect():
        got.setdefault((r.slice_id, r.pivot), []).append(r)
    assert set(got) == {(r.slice_id, r.pivot) for r in made[2].where("status = 'ok'").collect()}
    dims_of = {s: dims for s, dims, _ in SLICES}
    for (name, pivot), table in got.items():
        inside = [x for x in rows if all(x[1 + DIMS.index(d)] in codes for d, codes in dims_of[name].items())]
        want = {}
        for x in inside:
            key = "&".join(f"{d}={x[1 + DIMS.index(d)]}" for d in sorted(pivot.split(",")))
            side = BASE.start <= x[0].isoformat() <= BASE.end
            want.setdefault(key, [0, 0])[0 if side else 1] += x[7]
        assert {r.combination: (r.base, r.current) for r in table} == {k: tuple(map(float, v)) for k, v in want.items()}
        order = sorted(want, key=lambda k: (-abs(want[k][1] - want[k][0]), k))
        assert [r.combination for r in sorted(table, key=lambda r: r["rank"])] == order and all(r.passed and r.status == "exact" for r in table)
        assert {r.layer_delta for r in table} == {float(sum(v[1] - v[0] for v in want.values()))}
        assert sum(r.in_top for r in table) == min(2, len(table))


def test_ledger_and_highlights(spark, made):
    cube, slices, _, table = made
    pairs = V.slice_pairs(cube, slices, retail(), BASE, CURRENT, DIMS)
    ledger = L.drilldown_ledger(table, D.decompose(pairs, retail(), ["slice_id"]), pairs, "revenue").collect()
    assert len(ledger) == 13 + 6 and all(r.passed for r in ledger)
    assert all(r.crossed == (None if r.source == "decomposition" else True) for r in ledger)
    wrong = pairs.withColumn("c_revenue", F.col("c_revenue") + F.when(F.col("slice_id") == "one", 1.0).otherwise(0.0))
    crossed = {r.slice_id for r in L.drilldown_ledger(table, D.decompose(pairs, retail(), ["slice_id"]), wrong, "revenue").where("NOT crossed").collect()}
    assert crossed == {"one"}
    tops = {(r.slice_id, r.pivot): r for r in L.drilldown_highlights(table).collect()}
    assert len(tops) == 13 and all(0 < r.coverage <= 1 for r in tops.values())
