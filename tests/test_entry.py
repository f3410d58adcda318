"""The driver contract, and registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, oracle

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
# All of them with SWEEPLOG_ALL=1; otherwise one or two per area.
CHOSEN = list(QUERIES) if os.environ.get("SWEEPLOG_ALL") else [
    "line_refs", "format_header", "line_timestamps", "pack_windows_docs", "slices", "coverage_audit", "indicator_mentions", "findings",
    "sweep", "drilldown_targets", "evidence_timeline", "injection_scan", "report_problems", "ledger", "collapse_text", "unresolved_refs",
    "uncited_claims", "reply_parse", "role_stats", "latency_spread", "phase_durations", "rejection_reasons", "metric_delta",
    "run_estimate", "traffic_profile", "burst_sessions", "host_attribution", "live_sweep",
]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_contract():
    assert set(TWINS) <= set(QUERIES) and len(QUERIES) > 90


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert {"case_id", "file", "indicator", "match_count", "first_ref", "last_ref"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_twin(spark, con, name):
    line, good = compare(spark, con, name, QUERIES[name], TWINS.get(name), SF)
    assert good, line
