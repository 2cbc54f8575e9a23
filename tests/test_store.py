"""Stored runs: commits, retries, resuming; a run for a table of slices against plain sums."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deltatree.functions.periods import Period
from deltatree.operators import values as V
from deltatree.operators.attribution import Attribution
from deltatree.plans.common import retail
from deltatree.sources.store import MARK, RunStore, read_results, source_mark, write_results


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path), "retail", "r1")


def test_a_repeated_write_changes_nothing(spark, store):
    rows = spark.range(5).withColumn("slice_id", F.lit("a"))
    for _ in range(3):
        assert store.write("step", rows).count() == 5
    assert store.write("step", rows.limit(1)).count() == 5 and store.kinds() == ["step"]
    assert store.read("step").dtypes == rows.dtypes
    empty = store.write("none", rows.where("id < 0"))
    assert empty.count() == 0 and empty.columns == rows.columns


def test_a_failed_write_leaves_nothing(spark, store):
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.write("step", broken)
    assert store.committed("step") is None and store.kinds() == []
    with pytest.raises(LookupError):
        store.read("step")
    assert store.stage("step", lambda: spark.range(2)).count() == 2


def test_two_writers_at_once(spark, store, tmp_path):
    """A writer that committed unseen: all readers take the same one."""
    store.write("step", spark.range(3))
    first = store.committed("step")
    folder = tmp_path / "scenario=retail" / "run_id=r1" / "kind=step"
    (folder / f"{MARK}zzzz").touch()
    assert store.committed("step") == first and store.read("step").count() == 3
    store.discard()
    assert store.kinds() == []


def test_names_of_folders(spark, tmp_path):
    for name in ("", "../x", "a/b", "a=b", ".hidden"):
        with pytest.raises(ValueError):
            RunStore(spark, str(tmp_path), "retail", name)
        with pytest.raises(ValueError):
            RunStore(spark, str(tmp_path), "retail", "ok").folder(name)


def test_result_rows_and_their_payload(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None, [1.5]), ("b", 2, "é\n\"", [])], "slice_id string, seq int, note string, xs array<double>")
    for _ in range(2):
        write_results(rows, str(tmp_path), "retail", "r1", "step", ("slice_id",))
        write_results(rows.limit(1), str(tmp_path), "retail", "r2", "step", ("slice_id",))
    got = read_results(spark, str(tmp_path), "retail", "r1", "step", "seq int, note string, xs array<double>")
    assert sorted(map(tuple, got.collect())) == [("retail", "r1", "step", "a", 1, None, [1.5]), ("retail", "r1", "step", "b", 2, "é\n\"", [])]


def test_changed_files_have_another_mark(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    one = source_mark(spark, [str(tmp_path / "t")])
    assert one == source_mark(spark, [str(tmp_path / "t")])
    spark.range(3).write.mode("append").parquet(str(tmp_path / "t"))
    assert one != source_mark(spark, [str(tmp_path / "t")])


BASE, CURRENT = Period("2020-01-01", "2020-01-10"), Period("2020-01-11", "2020-01-20")
DIMS = ("channel", "nation", "region", "segment")


def plain_rows():
    rng = random.Random(4)
    return [(date(2020, 1, 1) + timedelta(days=k), rng.choice("AB"), rng.choice("xyz"), rng.choice(["n", "s"]), rng.choice("12"), rng.randrange(1, 9),
             rng.randrange(1, 30), rng.randrange(100, 9000)) for k in range(20) for _ in range(40)]


SLICES = [
    ("wide", {"channel": ["A", "B"], "nation": ["x", "y"], "region": ["n"], "segment": ["1", "2"]}),
    ("repeated", {"nation": ["x", "x", "z"], "segment": ["1"]}),
    ("one", {"channel": ["A"]}), ("everything", {}), ("unknown", {"channel": ["A", "none"]}), ("wrong", {"colour": ["red"]}), ("bare", {"channel": []}),
]


@pytest.fixture
def run(spark, store):
    cube = spark.createDataFrame(plain_rows(), "day date, channel string, nation string, region string, segment string, orders long, units long, revenue_cents long")
    cube = cube.groupBy("day", *DIMS).agg(*[F.sum(c).alias(c) for c in ("orders", "units", "revenue_cents")]).withColumn("lines", F.col("units"))
    slices = spark.createDataFrame(SLICES, "slice_id string, dims map<string, array<string>>")
    built = []

    def made(**more):
        return Attribution(store, retail(), BASE, CURRENT, Period("2020-01-01", "2020-01-20"), DIMS, lambda: cube,
                           lambda _: built.append("slices") or slices, replicates=200, **more)

    return made, built


def test_slices_of_several_codes_in_four_dimensions(run):
    made, _ = run
    attribution = made()
    status = {r.slice_id: r.status for r in attribution.slices.collect()}
    assert status == {"wide": "ok", "repeated": "ok", "one": "ok", "everything": "ok", "unknown": "unknown_code", "wrong": "unknown_dimension",
                      "bare": "empty_codes", "all": "ok"}
    pairs = {r.slice_id: r for r in attribution.pairs.collect()}
    split = {}
    for r in attribution.contributions.collect():
        split.setdefault(r.slice_id, {})[r.factor] = r
    assert "all" not in split
    shares = {r.slice_id: r.share for r in attribution.shares.collect()}
    total = [sum(x[7] for x in plain_rows() if period.start <= x[0].isoformat() <= period.end) for period in (BASE, CURRENT)]
    for name, dims in SLICES:
        if status[name] != "ok":
            assert pairs[name].b_revenue is None and {r.status for r in split[name].values()} == {"missing_value"} and shares[name] is None
            continue
        inside = [x for x in plain_rows() if all(x[1 + DIMS.index(d)] in codes for d, codes in dims.items())]
        sums = [[sum(x[i] for x in inside if p.start <= x[0].isoformat() <= p.end) for i in (5, 6, 7)] for p in (BASE, CURRENT)]
        assert (pairs[name].b_revenue, pairs[name].c_revenue) == (sums[0][2], sums[1][2])
        (o0, u0, r0), (o1, u1, r1) = sums
        mean = (r1 - r0) / math.log(r1 / r0)
        assert split[name]["orders"].contribution == pytest.approx(mean * math.log(o1 / o0))
        assert split[name]["price_per_unit"].contribution == pytest.approx(mean * math.log(r1 / u1 / (r0 / u0)))
        assert shares[name] == pytest.approx(abs(r1 - r0) / abs(total[1] - total[0]))
    gate = {r.slice_id: r.reason for r in attribution.verified.collect()}
    assert set(gate) == {"wide", "repeated", "one", "everything"}


def test_names_of_slices_are_their_own(spark):
    """Codes with the signs that join codes and dimensions: no two slices share a series."""
    dims = [{"a": ["x|y"]}, {"a": ["x", "y"]}, {"a": ["x&b=z"]}, {"a": ["x"], "b": ["z"]}, {}, {"a": ['"']}]
    rows = spark.createDataFrame([(d,) for d in dims] + [({"a": ["y", "x", "x"]},)], "d map<string, array<string>>")
    names = [r[0] for r in rows.select(V.slice_name(F.col("d"))).collect()]
    assert len(set(names[:6])) == 6 and names[6] == names[1]


def test_a_run_goes_on_after_a_failure(spark, run, store):
    made, built = run

    def lost(cube):
        raise RuntimeError("the driver died")

    failing = made(build_hypotheses=lost)
    assert failing.contributions.count() == 3 * len(SLICES)
    with pytest.raises(RuntimeError):
        _ = failing.verdicts
    assert store.kinds() == ["contributions", "pairs", "slices"] and built == ["slices"]
    again = made()
    marks = {k: store.committed(k) for k in store.kinds()}
    assert again.verdicts.count() == 12 and built == ["slices"]
    assert marks == {k: store.committed(k) for k in marks} and {"verdicts", "checks", "results", "series"} <= set(store.kinds())
    assert again.steps().count() == 2 * 7 + 12


def jobs(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_later_stages_read_the_stored_run(spark, sf_dir):
    queries = entry.queries()
    queries["rp1_report"](spark, sf_dir).collect()
    for name in ("pc7_apply", "rp1_report", "hy3_verify"):
        assert jobs(spark, f"stored {name}", lambda name=name: queries[name](spark, sf_dir).collect()) < 20
