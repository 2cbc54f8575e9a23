"""Every operator id has a query; queries give the rows of their SQL."""

import os

import pytest

import __spark_entry__ as entry
from deltatree.plans import catalog
from tools.check import compare, connect

IDS = (
    [f"src{i}" for i in (1, 3, 4, 7, 8)] + [f"flt{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11)] + [f"prj{i}" for i in (1, 2, 3)]
    + [f"jn{i}" for i in range(1, 14)] + [f"ag{i}" for i in range(1, 15)] + [f"dc{i}" for i in range(1, 22)]
    + [f"an{i}" for i in range(1, 8)] + [f"in{i}" for i in range(1, 13)] + [f"hy{i}" for i in range(1, 7)]
    + [f"pc{i}" for i in range(1, 8)] + [f"ev{i}" for i in range(1, 5)] + [f"wi{i}" for i in range(1, 10)]
    + [f"dq{i}" for i in range(1, 11)] + ["pe1", "pe2", "el1", "el2", "el3"] + [f"rp{i}" for i in range(1, 8)]
    + [f"so{i}" for i in range(1, 7)] + ["set1", "set2", "set3", "st1", "st2", "st3"]
)

SAMPLE = (
    "src1_load_facts", "src3_load_parameters", "src7_write_results", "flt2_slice_table", "flt7_narrow", "prj2_unknown_label",
    "jn4_outer", "jn6_weekly_lags", "jn7_events_near", "jn10_dense_grid", "ag6_pivots", "ag9_fingerprint",
    "dc5_lmdi_zero", "dc8_tree", "dc11_decompose", "dc15_dimension_table", "dc16_ranked", "an5_verdict", "in3_permutation_correlation",
    "ev3_match", "wi4_estimate", "dq6_staleness", "pe1_inject", "st1_daily_stream", "flt4_refused", "flt8_event_list", "jn5_align", "jn8_promo_days",
    "jn11_reconcile", "jn12_run_log", "an7_series_band", "wi7_knobs", "set3_warnings", "dq1_tables", "dq9_date_table", "dq10_sku_costs", "el2_negative_cases",
    "rp5_actions",
    # the stored run, slices of several codes, drill-down, knobs, substitution, targets
    "dc11_slice_table", "dc17_slice_table", "flt2_slice_status", "hy5_multi_code", "src7_steps", "src7_hypotheses", "src7_evidence", "hy1_candidates",
    "hy6_conclusion", "pc7_apply", "rp1_report", "dc15_drilldown", "rp6_drilldown", "rp7_drilldown", "wi8_knob_curves", "wi9_knob_combinations",
    "jn5_knob_series", "dc5_substitution", "el1_cases", "el1_targets", "so1_rank_combinations",
)


def test_every_operator_has_a_query():
    names = entry.queries()
    missing = [i for i in IDS if not any(n == i or n.startswith(f"{i}_") for n in names)]
    assert not missing
    assert set(catalog.all_oracles()) == set(catalog.all_queries())
    assert set(catalog.all_queries()) <= set(names)


@pytest.mark.parametrize("name", list(catalog.all_queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    ok, message, rows = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, message
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
