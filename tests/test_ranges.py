"""Ranks by range and the event index: exact, and without a task or a join that grows with one key."""

import random

import pytest
from pyspark.sql import functions as F

from deltatree.operators import calendar as C
from deltatree.operators import ranks as R
from deltatree.sources import facts as X

DIMS = ("channel", "region", "segment")


@pytest.mark.parametrize("value", [0.0, 250.0])
def test_ranks_when_nearly_all_sizes_are_equal(spark, monkeypatch, value):
    """Nine tenths of a group have one size: its ranges are still cut."""
    stored = {}
    keep = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df, name: stored.setdefault(name, keep(df, name)))
    rng = random.Random(3)
    rows = [("hot" if i % 20 else None, f"{rng.random():.17f}", value if i % 10 else float(i)) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, k string, v double").repartition(4)
    got = {(r.g, r.k): r.place for r in R.range_ranks(df, ["g"], [F.col("v").desc(), F.col("k")], "place", 16).collect()}
    for group in ("hot", None):
        order = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        assert [got[group, r[1]] for r in order] == list(range(1, len(order) + 1))
    sizes = [r["count"] for r in stored["ranked"].groupBy(F.shiftright("_id", 33)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20000 / 16


def test_ranks_without_rows(spark):
    df = spark.createDataFrame([], "g string, k string")
    assert R.range_ranks(df, ["g"], [F.col("k")]).collect() == []


def test_grid_of_a_million_codes(spark):
    """A long list is joined by number; no task holds it or makes all its rows."""
    codes = spark.range(1_000_000).select(F.concat(F.lit("c"), "id").alias("sku"))
    side = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "side string")
    fact = spark.createDataFrame([(1, "c17", "a", 5), (1, "c999999", "b", 7), (9, "c1", "a", 9)], "day int, sku string, side string, units long")
    grid = X.densify(fact, {"sku": codes, "side": side}, spark.createDataFrame([(1,)], "day int"), ["units"])
    rows = grid.agg(F.count(F.lit(1)), F.count_if("filled"), F.sum("units"), F.count_distinct("sku")).first()
    assert tuple(rows) == (2_000_000, 1_999_998, 12, 1_000_000)
    with pytest.raises(ValueError, match="at most"):
        X.densify(fact, {"sku": codes, "side": side}, spark.createDataFrame([(1,)], "day int"), ["units"], most=1_999_999)


def test_both_ways_to_a_grid_agree(spark):
    codes = {"sku": spark.createDataFrame([(f"c{i}",) for i in range(30)] + [(None,)], "sku string"),
             "side": spark.createDataFrame([("a",), ("b",)], "side string")}
    fact = spark.createDataFrame([(1, "c1", "a", 5), (2, "c2", "b", 7)], "day int, sku string, side string, units long")
    days = spark.createDataFrame([(1,), (2,), (2,)], "day int")
    one, other = (sorted(map(tuple, X.densify(fact, codes, days, ["units"], listed=n).collect())) for n in (100, 1))
    assert one == other and len(one) == 2 * 30 * 2
    assert X.densify(fact, codes, days.where("day > 5"), ["units"]).collect() == []


def calendar(spark, n, rng, free):
    """Events of one week that name one or two dimensions, some without codes; some open."""
    rows = []
    for i in range(n):
        names = rng.sample(DIMS, rng.choice([1, 1, 2]))
        dims = {d: [] if rng.random() < free else [f"{d}{rng.randrange(400)}" for _ in range(rng.choice([1, 1, 3]))] for d in names}
        rows.append((i, f"e{i}", "2020-03-04", None if rng.random() < 0.1 else "2020-03-05", dims))
    return spark.createDataFrame(rows, "event_id long, name string, s string, e string, dims map<string, array<string>>").select(
        "event_id", "name", F.col("s").cast("date").alias("start_day"), F.col("e").cast("date").alias("end_day"), "dims")


def slices(spark, n, rng, free):
    rows = []
    for i in range(n):
        names = rng.sample(DIMS, rng.choice([0, 1, 2, 3]))
        rows.append((f"w{i}", {d: [] if rng.random() < free else [f"{d}{rng.randrange(400)}" for _ in range(rng.choice([1, 2]))] for d in names}))
    rows.append(("all", {}))
    return spark.createDataFrame(rows, "window_id string, slice_dims map<string, array<string>>").select(
        "*", F.lit("2020-03-02").cast("date").alias("window_start"), F.lit("2020-03-08").cast("date").alias("window_end"))


def test_shared_events_are_those_with_an_overlap(spark):
    rng = random.Random(8)
    windows, events = slices(spark, 150, rng, 0.2), calendar(spark, 80, rng, 0.2)
    near = C.events_near(windows, events).where(C.dimension_overlap(F.col("dims"), F.col("slice_dims"), DIMS) > 0)
    want = sorted((r.window_id, r.event_id, r.gap) for r in near.collect())
    got = sorted((r.window_id, r.event_id, r.gap) for r in C.events_sharing(windows, events, DIMS).collect())
    assert got == want and len(set(got)) == len(got) and got


def test_pairs_made_grow_with_pairs_kept(spark):
    """Many slices of one week: what is joined is a small multiple of what matches, not windows times events."""
    rng = random.Random(9)
    windows, events = slices(spark, 100_000, rng, 0.0).where(F.size("slice_dims") > 0), calendar(spark, 300, rng, 0.0)
    asked = C._window_weeks(windows, 3).withColumn("_key", F.explode(C.window_lookups(F.col("slice_dims"), DIMS)))
    posted = C._event_weeks(windows, events, 3).withColumn("_key", F.explode(C.event_postings(F.col("dims"))))
    made = asked.join(posted, ["_bucket", "_key"]).count()
    kept = C.events_sharing(windows, events, DIMS).count()
    assert 0 < kept <= made <= 4 * kept and made < windows.count() * 300 / 50
