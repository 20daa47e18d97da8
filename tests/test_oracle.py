"""Registered queries against their SQL at the smallest scale (all of them with PANELTIDE_ALL=1)."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = """panel_star score_and_rank permit_momentum strengths_weaknesses top_contributors rank_changes walk_forward_summary
baseline_headline orthogonality precision_several_k weighted_tau_gappy weighted_tau_split ranks_split quantiles_split scan_positional
scan_json_matrix scan_area_year_files annual_mean_min_obs universe_drop_log code_at_period match_any_place as_of_before_cut
complete_membership weighted_rollup_filled net_flow month_over_year boundary_consistent_series bootstrap_tau paired_gap rank_intervals
retention_gate early_rows mid_period_rows cross_source_divergence flag_report grade_runs""".split()
NAMES = sorted(queries()) if os.environ.get("PANELTIDE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), FOLDER)
    # at the smallest size some of the others hold no row; the queries of the default run all do
    assert ok or name not in SOME and note.startswith("rows=0"), note


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
