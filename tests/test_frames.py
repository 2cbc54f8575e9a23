"""Facts, slices, calendars, shocks and streams on small fixtures."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltatree.functions.periods import Period
from deltatree.operators import calendar as C
from deltatree.operators import quality as Q
from deltatree.operators import values as V
from deltatree.sources import facts as X
from deltatree.sources import tables as T


def test_whole_rounds_halves_away_from_zero(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.4999999, -0.5, -2.5, 0.0)], "v double")
    assert [r[0] for r in df.select(X.whole(F.col("v"))).collect()] == [1, 2, 2, -1, -3, 0]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Tables in which one order and one part hold a third of all lines each."""
    path = str(tmp_path_factory.mktemp("skew"))
    rng = random.Random(2)
    lines = []
    for i in range(3000):
        order = 7 if i % 3 == 0 else rng.randrange(200)
        part = 3 if i % 3 == 1 else rng.randrange(40)
        lines.append((order, part, 1, i, float(rng.randrange(1, 9)), float(rng.randrange(100, 9999)) / 100, 0.05, 0.02, rng.choice("NRA"), "O", datetime(1998, 1, 1)))
    orders = [(k, k % 9, "O", 1.0, datetime(1998, 1, 1) + timedelta(days=k % 20), f"{k % 3}-X") for k in range(200)]
    frames = {
        "lineitem": (lines, X.SCHEMAS["lineitem"]), "orders": (orders, X.SCHEMAS["orders"]),
        "part": ([(k, "p", f"B{k % 4}", f"T{k % 2}", 1, 2.5) for k in range(30)], X.SCHEMAS["part"]),
        "customer": ([(k, "c", k % 4, 0.0, f"S{k % 2}") for k in range(8)], X.SCHEMAS["customer"]),
        "nation": ([(k, f"N{k}", k % 2) for k in range(3)], X.SCHEMAS["nation"]),
        "region": ([(0, "R0"), (1, "R1")], X.SCHEMAS["region"]),
    }
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return path, lines, orders


def test_cubes_keep_every_line(spark, skewed):
    path, lines, _ = skewed
    cents = sum(round(x[5] * 100) for x in lines)
    by_order = X.daily_cube(spark, path, ("channel", "region", "segment")).agg(F.sum("lines"), F.sum("revenue_cents"), F.sum("orders")).first()
    assert by_order[0] == 3000 and by_order[1] == cents and by_order[2] == len({x[0] for x in lines})
    by_line = X.daily_cube(spark, path, ("category", "sku", "channel")).agg(F.sum("lines"), F.sum("revenue_cents")).first()
    assert tuple(by_line) == (3000, cents)
    unknown = X.daily_cube(spark, path, ("region", "sku"), ("lines",)).where("region = 'unknown' and sku = 'unknown'")
    assert unknown.agg(F.sum("lines")).first()[0] > 0
    with pytest.raises(ValueError):
        X.daily_cube(spark, path, ("sku",), ("orders",))


def test_order_path_shuffles_lines_once(spark, skewed):
    path = skewed[0]
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = X.order_rows(own, path, ("channel",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "partial_sum" in plan


def test_period_reaches_the_scan(spark, sf_dir):
    plan = X.order_heads(spark, sf_dir, (), "1998-01-01", "1998-01-28")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan and "o_totalprice" not in plan


def test_store_and_load(spark, skewed, tmp_path):
    cube = X.daily_cube(spark, skewed[0], ("channel",), ("units",))
    path = X.write_fact(cube, str(tmp_path / "fact"), ("channel",))
    got = X.load_facts(X.open_fact(spark, path), ("day", "units"), "1998-01-03", "1998-01-05")
    want = cube.where("day between date'1998-01-03' and date'1998-01-05'").agg(F.sum("units")).first()[0]
    assert got.agg(F.sum("units")).first()[0] == want
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().executedPlan().toString()


def test_slice_table_equals_literals(spark, skewed):
    cube = X.daily_cube(spark, skewed[0], ("channel", "region", "segment"), ("units",))
    specs = {"all": {}, "a": {"channel": ["0-X", "1-X"], "segment": ["S0"]}, "b": {"region": ["R1"]}}
    schema = "slice_id string, dims map<string,array<string>>"
    table = spark.createDataFrame([(k, {d: list(c) for d, c in s.items()}) for k, s in specs.items()], schema)
    a = {r[0]: r[1] for r in V.tag_slices(cube, specs).groupBy("slice_id").agg(F.sum("units")).collect()}
    b = {r[0]: r[1] for r in V.join_slices(cube, table, ("channel", "region", "segment")).groupBy("slice_id").agg(F.sum("units")).collect()}
    assert a == b and len(a) == 3
    with pytest.raises(ValueError):
        V.slice_condition({"channel": []})


def test_narrowing_and_overflow(spark):
    schema = "slice_id string, locked map<string,array<string>>, extra map<string,array<string>>"
    df = spark.createDataFrame([("ok", {"c": ["x", "y"]}, {"c": ["y"], "d": ["z"]}), ("no", {"c": ["x"]}, {"c": ["y"]})], schema)
    got = {r["slice_id"]: r for r in Q.narrow_slices(df).collect()}
    assert got["ok"]["dims"] == {"c": ["y"], "d": ["z"]} and got["ok"]["status"] == "ok" and got["no"]["status"] == "conflict"
    small = T.limited(spark.range(5), 5, ["id"]).collect()
    assert len(small) == 5 and {r["status"] for r in small} == {"complete"}
    assert {r["status"] for r in T.limited(spark.range(6), 5, ["id"]).collect()} == {"overflow"}


def test_bad_parameter_fails(spark, tmp_path):
    path = tmp_path / "p.csv"
    header = "param_key,scope,value,unit,source_type,source_name,source_url,captured_on,used_for,note\n"
    path.write_text(header + "a.x,s,0.5,u,official,n,u,2026-01-01,f,\na.y,s,abc,u,official,n,u,2026-01-01,f,\n")
    with pytest.raises(Exception):
        T.load_parameters(spark, str(path)).collect()


def test_events_near_against_brute_force(spark):
    rng = random.Random(9)
    start = date(2020, 1, 1)
    windows = [(f"w{i}", start + timedelta(days=7 * i), start + timedelta(days=7 * i + rng.randrange(12))) for i in range(40)]
    events = []
    for i in range(120):
        s = start + timedelta(days=rng.randrange(-60, 340))
        events.append((i, s, None if i % 11 == 0 else s + timedelta(days=rng.choice([0, 2, 9, 200]))))
    w = spark.createDataFrame(windows, "window_id string, window_start date, window_end date")
    e = spark.createDataFrame(events, "event_id int, start_day date, end_day date")
    got = {(r["window_id"], r["event_id"]): r["gap"] for r in C.events_near(w, e, 3).collect()}
    want = {}
    for wid, ws, we in windows:
        for eid, es, ee in events:
            gap = (ws - ee).days if ee and ee < ws else (es - we).days if es > we else 0
            if gap <= 3:
                want[wid, eid] = gap
    assert got == want
    assert C.events_near(w, e, 3).count() == len(want)


def test_overlap_counts_names_and_codes(spark):
    schema = "e map<string,array<string>>, s map<string,array<string>>"
    rows = [({"channel": ["a"]}, {"channel": ["a"]}, 1.0), ({"channel": ["a"]}, {"channel": ["b"]}, 0.0), ({"channel": ["a"], "category": ["x"]}, {"channel": ["a"]}, 0.5),
            ({"channel": ["a"]}, {}, 0.5), ({"channel": []}, {"channel": ["b"]}, 1.0), ({}, {"channel": ["b"]}, 0.0)]
    df = spark.createDataFrame([r[:2] for r in rows], schema)
    got = [r[0] for r in df.select(C.dimension_overlap(F.col("e"), F.col("s"), ("channel", "region"))).collect()]
    assert got == pytest.approx([r[2] for r in rows])


def test_first_promotion_wins(spark):
    days = spark.createDataFrame([(date(y, 6, d),) for y in (2020, 2021) for d in (14, 15, 18, 20, 25)], "day date")
    got = {r["day"]: r["promo_name"] for r in C.in_promotion(days, [("a", 6, 15, 6, 18, 2.0), ("b", 6, 18, 6, 20, 3.0)]).collect()}
    assert [got[date(2021, 6, d)] for d in (14, 15, 18, 20, 25)] == [None, "a", "a", "b", None]


def test_injected_causes_are_found(spark, sf_dir):
    """Closed loop: shocks of known size must be among the first three causes."""
    from deltatree.operators import shocks as K
    from deltatree.plans.common import retail

    cube = X.daily_cube(spark, sf_dir, ("channel", "region", "segment"), ("orders", "lines", "units", "revenue_cents"))
    shocks = (
        K.Shock("price", "price_per_unit", ("revenue_cents",), 0.3, Period("1998-02-01", "1998-04-30")),
        K.Shock("basket", "basket", ("units", "revenue_cents"), 6.0, Period("1999-02-01", "1999-04-30")),
    )
    truth = K.truth_rows(cube, shocks, "revenue_cents", "units")
    assert truth.where("not recheck_ok").count() == 0
    cases = K.evaluate_attribution(K.inject_shocks(cube, shocks), retail(), shocks, truth)
    got = K.evaluation_summary(cases).first()
    assert got["top1_rate"] == 1.0 and got["top3_rate"] == 1.0 and got["all_conserved"]


def test_late_rows_are_dropped(spark, tmp_path):
    """The last file holds a row of a day that the watermark has closed already."""
    from deltatree.streaming import daily as D

    folder = tmp_path / "in"
    schema = "ts timestamp_ntz, kind string, value double"
    for i, days in enumerate(([1, 2, 9], [10], [1, 11])):
        rows = [(datetime(2024, 1, d, 12), "a", 1.0) for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"f{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = D.run_to_end(D.daily_fact(stream, ["kind"], "value"), "late")
    got = {r["day"]: r["n"] for r in out.collect()}
    assert got == {date(2024, 1, 1): 1, date(2024, 1, 2): 1, date(2024, 1, 9): 1}


def test_hot_part_is_split(spark, skewed):
    """A part with a third of all lines: AQE splits its partition in the join with parts."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    own = spark.newSession()
    for key, value in conf.items():
        own.conf.set(key, value)
    df = X.line_rows(own, skewed[0], ("sku",), ("units", "material_cents"))
    assert len(df.collect()) == 3000
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_slices_are_refused_not_widened(spark, skewed):
    cube = X.daily_cube(spark, skewed[0], ("channel", "region"), ("units",))
    rows = [("ok", {"channel": ["0-X"]}), ("sku", {"channel": ["0-X"], "sku": ["x"]}), ("none", {"region": []}), ("code", {"region": ["R1", "nowhere"]})]
    table = spark.createDataFrame(rows, "slice_id string, dims map<string,array<string>>")
    assert {r[0]: r[1] for r in V.check_slices(table, cube, ("channel", "region")).collect()} == {
        "ok": "ok", "sku": "unknown_dimension", "none": "empty_codes", "code": "unknown_code"}
    assert {r[0] for r in V.join_slices(cube, table, ("channel", "region")).select("slice_id").distinct().collect()} == {"ok", "code"}


def test_four_dimensions_and_codes_with_separators(spark):
    cube = spark.createDataFrame([("a&b=c", "x", "y", "z", 1), ("a", "b=c&x", "y", "z", 2)], "p string, q string, r string, s string, n int")
    table = spark.createDataFrame([("one", {"p": ["a&b=c"], "q": ["x"], "r": ["y"], "s": ["z"]}), ("two", {"q": ["x", "b=c&x"]})], "slice_id string, dims map<string,array<string>>")
    got = {(r["slice_id"], r["n"]) for r in V.join_slices(cube, table, ("p", "q", "r", "s")).collect()}
    assert got == {("one", 1), ("two", 1), ("two", 2)}


def test_promotion_over_the_year_end(spark):
    from datetime import date

    from deltatree.operators.calendar import in_promotion

    days = spark.createDataFrame([(date(1997, m, d),) for m, d in ((1, 1), (1, 6), (2, 28), (6, 15), (12, 24), (12, 31))], "day date")
    got = {r["day"].isoformat()[5:]: r["promo_name"] for r in in_promotion(days, [("turn", 12, 25, 1, 5, 1.5), ("leap", 2, 29, 3, 1, 1.1)]).collect()}
    assert got == {"01-01": "turn", "01-06": None, "02-28": "leap", "06-15": None, "12-24": None, "12-31": "turn"}


def test_event_list_holds_whole_events_and_marks_a_cut(spark):
    from datetime import date

    rows = [(i, "promotion", date(1998, 1, i), date(1998, 1, i + 2) if i < 9 else None) for i in range(1, 10)]
    events = spark.createDataFrame(rows, "event_id int, type string, start_day date, end_day date")
    assert [r["event_id"] for r in Q.list_events(events, "promotion", "1998-01-03", "1998-01-08").collect()] == [6, 5, 4, 3]
    assert {r["status"] for r in Q.list_events(events, limit=4).collect()} == {"overflow"}


def test_shocks_clamp_to_the_stage_before_and_must_not_overlap(spark):
    from deltatree.functions.periods import Period
    from deltatree.operators import shocks as K

    week = Period("1998-01-01", "1998-01-07")
    df = spark.createDataFrame([("1998-01-02", 10, 8, 6)], "day string, created long, paid long, shipped long").selectExpr("cast(day as date) day", "created", "paid", "shipped")
    shock = K.Shock("s", "paid", ("paid", "shipped"), 2.0, week, stages=("created", "paid", "shipped"))
    assert tuple(K.inject_shock(df, shock).first())[1:] == (10, 10, 10)
    with pytest.raises(ValueError, match="overlap"):
        K.inject_shocks(df, (shock, K.Shock("t", "paid", ("paid",), 1.5, week)))


def test_checksums_differ_with_any_field(spark):
    from deltatree.operators import report as R

    rows = [(s, 1, "x", 1, a, v, b) for s, a, v, b in (("p", "a|b", 1.0, "c"), ("q", "a", 1.0, "b|c"), ("r", "a|b", 2.0, "c"), ("s", "a|b", None, "c"), ("t", "a|b", 1.0, None))]
    df = spark.createDataFrame(rows, "slice_id string, segment_index int, segment string, position int, label string, value double, display string")
    assert len({r["checksum"] for r in R.content_checksum(df).collect()}) == 5


def test_run_log_keeps_scenarios_apart(spark):
    from deltatree.operators.anomaly import run_status

    log = spark.createDataFrame([(1, "retail", "revenue", "1998-01-01", "done"), (2, "retail", "revenue", "1998-01-01..1998-01-31", "failed")], "id int, scenario string, metric string, period string, status string")
    rows = spark.createDataFrame([("retail", "revenue"), ("margin", "revenue")], "scenario string, code string").selectExpr("*", "date '1998-01-01' as start_day")
    got = {r["scenario"]: (r["n_runs"], r["latest_status"], r["run_ids"]) for r in run_status(rows, log, "code", "start_day").collect()}
    assert got == {"retail": (2, "failed", [1, 2]), "margin": (0, None, [])}
