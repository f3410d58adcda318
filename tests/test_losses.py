"""No row, record or digit is lost on the way: rows in against rows out at the edges of the operators."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sweeplog.operators import drilldown, indicators, outcomes, scorer, traffic
from sweeplog.operators import runstats as R
from sweeplog.operators.quantiles import latency_spread
from sweeplog.plans import jobs
from sweeplog.sources import casefiles as CF
from sweeplog.sources import runlog

AT = dt.datetime(2031, 5, 6, 7, 8, 9)


def test_events_with_null_run_or_time_are_numbered(spark):
    rows = spark.createDataFrame([("r", AT, 1, "k"), ("r", None, 2, "k"), (None, AT, 3, "k")], "investigation_id string, ts timestamp_ntz, sequence bigint, kind string")
    got = {(r.investigation_id, r.sequence): r.event_id for r in runlog.number_events(rows).collect()}
    assert got == {("r", 2): 1, ("r", 1): 2, (None, 3): 1}


def test_traffic_with_null_keys_or_times_stays(spark):
    events = spark.createDataFrame([("s", "d", AT, 1), ("s", "d", None, 2), (None, "d", AT, 3)], "source string, domain string, ts timestamp, line_no bigint")
    assert sum(r.events for r in traffic.sessions(events, 5.0).collect()) == 3
    rows = spark.createDataFrame([("a", AT, 1), (None, AT, 2), ("a", None, 3)], "ip string, ts timestamp, id bigint")
    leases = spark.createDataFrame([("a", AT, "h", 60, 1), (None, AT, "nobody", 60, 2)], "ip string, ts timestamp, host string, lease_s bigint, line_no bigint")
    got = {r.id: r.host for r in traffic.attribute_hosts(rows, leases).collect()}
    assert got == {1: "h", 2: None, 3: None}


def test_written_events_and_history_read_back(spark, tmp_path):
    events = spark.createDataFrame([(f"r{i % 2}", AT + dt.timedelta(seconds=i), i, "state_transition") for i in range(6)], "investigation_id string, ts timestamp_ntz, sequence bigint, kind string")
    runlog.append_events(runlog.number_events(events), str(tmp_path / "log"))
    back = runlog.read_run_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r.investigation_id, r.event_id, r.kind) for r in back) == [(f"r{k}", i, "state_transition") for k in (0, 1) for i in (1, 2, 3)]
    stats = spark.range(5).select(F.concat(F.lit("run-"), "id").alias("investigation_id"), F.lit("vllm").alias("backend"))
    runlog.write_json(stats.coalesce(1), str(tmp_path / "stats"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps({"investigation_id": "run-9"}, indent=1))
    (tmp_path / "one" / "b.json").write_text("{torn")
    assert sorted(r.investigation_id for r in runlog.read_history(spark, str(tmp_path / "stats")).collect()) == [f"run-{i}" for i in range(5)]
    assert [r.investigation_id for r in runlog.read_history(spark, f"{tmp_path}/one/*.json").collect()] == ["run-9"]


def test_only_files_of_logs_and_all_of_them(spark, tmp_path):
    logs = tmp_path / "case-1" / "logs"
    (logs / "sub").mkdir(parents=True)
    (logs / "a.log").write_text("one\ntwo\n")
    (logs / "_b.log").write_text("three\n")
    (logs / "sub" / "deep.log").write_text("four\n")
    got = sorted(tuple(r) for r in CF.read_lines(spark, str(tmp_path)).collect())
    assert got == [("case-1", "_b.log", 1, "three"), ("case-1", "a.log", 1, "one"), ("case-1", "a.log", 2, "two")]


def test_all_domains_of_an_alert_are_looked_for(spark):
    names = [f"host{i}.example.com" for i in range(7)]
    alert = spark.createDataFrame([("c", "a", "d", "r", "open", "low", "x", "y", " ".join(names), [], {})], (
        "case_id string, alert_id string, detector string, rule_name string, status string, severity string, first_seen string, last_seen string, summary string,"
        " entities array<struct<kind:string,value:string,note:string>>, raw_detector_fields map<string,string>"))
    assert set(names) <= set(indicators.directives(alert).first().indicators)
    assert len([x for x in indicators.directives(alert, per_kind=4).first().indicators if x in names]) == 4


def test_hits_outside_the_window_are_left_out(spark):
    hits = spark.createDataFrame(
        [("c", "f", 1, "i", "2030-01-01T00:00:00Z"), ("c", "f", 2, "i", "2026-01-01T00:00:00Z"), ("c", "f", 3, "i", None)],
        "case_id string, file string, line_no bigint, indicator string, raw_ts string")
    directive = spark.createDataFrame([("c", "2029-12-31T00:00:00Z/2030-12-31T00:00:00Z")], "case_id string, time_window string")
    assert sorted(r.line_no for r in indicators.hits_in_window(hits, directive).collect()) == [1, 3]


def test_small_values_add_up(spark):
    values = spark.range(1000).select(F.lit("k").alias("k"), F.lit(4.9e-06).alias("v"))
    assert latency_spread(values, ["k"], "v").first().total == pytest.approx(4.9e-03)
    large = spark.createDataFrame([("k", 1e30), ("k", 1.0)], "k string, v double")
    assert latency_spread(large, ["k"], "v").first().total == pytest.approx(1e30)


def test_missing_verdicts_and_states_are_reported(spark):
    ddl = "investigation_id string, kind string, from_state string, to_state string, payload struct<ok:boolean,problems:array<string>>"
    log = spark.createDataFrame([
        ("r", "grunt_validation", None, None, (None, ["x"])), ("r", "grunt_validation", None, None, (False, ["x"])),
        ("r", "state_transition", None, "TASKING", None), ("r", "state_transition", "RECEIVED", None, None), ("r", "state_transition", "RECEIVED", "TASKING", None)], ddl)
    assert tuple(R.validations(log).first())[1:3] == (2, 2)
    assert {r.reason: r.reports for r in R.rejection_reasons(log).collect()} == {"other": 2}
    assert sorted((r.from_state or "", r.to_state or "") for r in R.illegal_transitions(log).collect()) == [("", "TASKING"), ("RECEIVED", "")]


def test_task_ids_differ_for_any_round_size(spark):
    chosen = spark.createDataFrame([("c", 1, i + 1, f"s{i}", "f", i) for i in range(6)], "case_id string, iteration bigint, rank bigint, slice_id string, file string, window_index bigint")
    slices = spark.createDataFrame([("c", f"s{i}", 1, 2) for i in range(6)], "case_id string, slice_id string, start_line bigint, end_line bigint")
    assert len({r.task_id for r in drilldown.taskings(chosen, slices, 6).collect()}) == 6


def test_any_bad_answer_of_a_reader_is_a_row(spark):
    shown = spark.createDataFrame([("c", f"s{i}", ["f:L1"], ["x"], []) for i in range(4)], "case_id string, slice_id string, refs array<string>, texts array<string>, feedback array<string>")

    def reader(lines, task, feedback):
        return {"s0": None, "s1": {"finish_reason": "stop"}, "s2": {"reply": "{}", "completion_tokens": "many"}, "s3": "fine"}[task["slice_id"]]

    got = {r.slice_id: r for r in scorer.score(shown, reader).collect()}
    assert all(got[f"s{i}"].error and got[f"s{i}"].reply is None for i in range(3))
    assert got["s3"].error is None and got["s3"].reply == "fine"


def test_a_task_says_why_it_has_no_answer(spark):
    task = "task_id string, case_id string, iteration bigint, slice_id string, file string, window_index bigint, instruction string, commander_intent string"
    tasks = spark.createDataFrame([(f"t{i}", "c", 0, f"s{i}", "f", i, "i", "p") for i in range(3)], task)
    report = "struct<relevant:boolean>"
    answers = spark.createDataFrame([("t0", None, None, None, "aborted"), ("t1", None, None, None, "internal")], f"task_id string, attempts bigint, report {report}, problems array<string>, reason string")
    assert {r.task_id: r.reason for r in outcomes.settle(tasks, answers).collect()} == {"t0": "aborted", "t1": "internal", "t2": "timeout"}


def test_sweep_takes_a_window(spark):
    lines = spark.createDataFrame([("c", "f", i + 1, f"202{5 + i}-01-01T00:00:00Z seen bad.example.com") for i in range(3)], "case_id string, file string, line_no bigint, text string")
    directive = spark.createDataFrame([("c", "s", ["bad.example.com"], "r", [], "2026-06-01T00:00:00Z/2030-01-01T00:00:00Z")], (
        "case_id string, alert_restatement string, indicators array<string>, relevance_criteria string, explicitly_irrelevant array<string>, time_window string"))
    slices = jobs.slice_case_logs(lines, budget=900)["slices"]
    found = [f for r in jobs.sweep(lines, slices, directive, budget=900).collect() for f in r.report.findings]
    assert [(f.match_count, f.first_ref) for f in found] == [(1, "f:L3")]


def test_staged_tables_are_discarded(spark):
    from sweeplog.session import discard_staged, materialize

    discard_staged(spark)
    kept = materialize(spark.range(3), "staged")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert kept.count() == 3 and discard_staged(spark) == 1
    import os

    assert not os.path.exists(path)
