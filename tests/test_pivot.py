import random

import pytest
from pyspark.sql import functions as F

from deltatree.operators import pivot as P


def table(spark, pairs, top_n=2):
    rows = [("g", k, b, c, b is not None, c is not None) for k, (b, c) in pairs.items()]
    df = spark.createDataFrame(rows, "g string, slice_id string, base double, current double, in_base boolean, in_current boolean")
    out = P.exact_contributions(df)
    total = sum((c or 0) - (b or 0) for b, c in pairs.values())
    return {r["slice_id"]: r for r in P.add_ranks(out.withColumn("layer_delta", F.lit(float(total))), ["g"], ["slice_id"], top_n).collect()}


def test_ranked_table(spark):
    got = table(spark, {"paid_ads": (100.0, 60.0), "natural_search": (80.0, 85.0), "livestream": (20.0, 20.0)})
    assert [got[k]["rank"] for k in ("paid_ads", "natural_search", "livestream")] == [1, 2, 3]
    assert got["paid_ads"]["contribution"] == -40 and got["paid_ads"]["coverage"] == 1.0
    assert got["paid_ads"]["rate"] == pytest.approx(-40 / -35) and all(r["passed"] for r in got.values())


def test_new_and_vanished(spark):
    got = table(spark, {"a": (10.0, 4.0), "b": (5.0, None), "c": (None, 3.0)})
    assert {k: r["note"] for k, r in got.items()} == {"a": "", "b": "vanished", "c": "new"}
    assert sum(r["contribution"] for r in got.values()) == -8


def test_no_change(spark):
    got = table(spark, {"a": (1.0, 2.0), "b": (2.0, 1.0)})
    assert all(r["rate"] is None and r["table_note"] == "no_change" for r in got.values())


def test_share_split(spark):
    rows = spark.createDataFrame([("x", "a", -100.0, 3.0), ("x", "b", -100.0, 1.0), ("y", "a", 5.0, -1.0), ("y", "b", 5.0, 2.0), ("z", "a", 5.0, 0.0)],
                                 "g string, k string, delta double, w double")
    got = {(r["g"], r["k"]): r for r in P.allocate_by_share(rows, ["g"], F.col("delta"), F.col("w")).collect()}
    assert (got["x", "a"]["contribution"], got["x", "b"]["contribution"]) == (-75.0, -25.0)
    assert got["y", "a"]["status"] == "negative_share" and got["z", "a"]["status"] == "zero_share"
    assert got["y", "b"]["contribution"] is None


def test_rank_with_a_hot_group_and_ties(spark):
    """A third of all rows share one value; half are zero. Ranks must equal a plain sort."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        value = 500.0 if i % 3 == 0 else 0.0 if i % 3 == 1 else float(rng.randrange(2000))
        rows.append(("hot" if i % 10 else "cold", f"{rng.choice('abc')}{i:05d}", value))
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = {(r["g"], r["k"]): r["rank"] for r in P.ranked(df, ["g"], F.abs("v"), ["k"]).collect()}
    for group in ("hot", "cold"):
        order = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        assert [got[group, r[1]] for r in order] == list(range(1, len(order) + 1))
