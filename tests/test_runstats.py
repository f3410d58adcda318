"""Run logs and counters with known numbers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sweeplog.operators import runstats as R
from sweeplog.sources import metrics, runlog


def lines(spark, records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


def step(event, ts, to, run="r", before="X"):
    return {"event_id": event, "investigation_id": run, "ts": ts, "kind": "state_transition", "from_state": before, "to_state": to}


def call(event, role, ms, **more):
    return {"event_id": event, "investigation_id": "r", "kind": "llm_call", "role": role, "latency_ms": ms, **more}


def test_phases_start_at_the_first_transition_and_skip_bad_times(spark):
    log = runlog.records(lines(spark, [
        step(1, "2026-08-14T10:00:00.000+00:00", "TASKING"), step(2, "2026-08-14T10:00:20.000+00:00", "SWEEPING"),
        step(3, "broken", "COLLECTING"), step(4, "2026-08-14T10:00:21.500+00:00", "COLLECTING"),
        step(5, "2026-08-14T10:31:41.500+00:00", "PLANNING"), step(6, "2026-08-14T10:32:41.500+00:00", "COLLECTING"),
        step(7, "2026-08-14T10:33:41.500+00:00", "SYNTHESIZING"),
    ]))
    got = {r.state: r.seconds for r in R.phase_durations(log).collect()}
    assert got == {"TASKING": 20.0, "SWEEPING": 1.5, "COLLECTING": 1940.0, "PLANNING": 60.0}


def test_roles_retries_errors_and_null_tokens(spark):
    log = runlog.records(lines(spark, [
        call(1, "grunt", 1000.0, attempt=1, usage={"prompt_tokens": 10, "completion_tokens": 5}),
        call(2, "grunt", 3000.0, attempt=2, usage={"prompt_tokens": 10, "completion_tokens": None}, error="transport"),
        call(3, "grunt", 2000.0, usage=None), {"event_id": 4, "investigation_id": "r", "kind": "llm_call"},
    ]))
    got = {r.role: r for r in R.role_counts(log).collect()}
    grunt = got["grunt"]
    assert (grunt.calls, grunt.retries, grunt.errors, grunt.prompt_tokens, grunt.completion_tokens) == (3, 1, 1, 20, 5)
    assert got["unknown"].calls == 1
    spread = {r.role: r for r in R.role_latency(log).collect()}
    assert (spread["grunt"].median, spread["grunt"].max, spread["grunt"].total) == (2.0, 3.0, 6.0)


def test_torn_lines_are_skipped_or_kept(spark):
    text = lines(spark, [call(1, "grunt", 1.0), '{"event_id": 2, "invest', "", "   ", '{"a":1} {"b":2}', '{"a":1}}', "[1]", "x" * 900])
    assert runlog.records(text).count() == 1
    kept = runlog.tolerant(text).collect()
    assert [r.kind for r in kept] == ["llm_call"] + ["unparseable_line"] * 5
    assert len(kept[-1].raw) == 500


def test_reasons_per_report(spark):
    problems = ["findings[0] cites 'a:L1', which is not in slice s."] * 3
    log = runlog.records(lines(spark, [
        {"event_id": 1, "investigation_id": "r", "kind": "grunt_validation", "payload": {"ok": False, "problems": problems}},
        {"event_id": 2, "investigation_id": "r", "kind": "grunt_validation", "payload": {"ok": True, "problems": []}},
    ]))
    assert [(r.reason, r.reports) for r in R.rejection_reasons(log).collect()] == [("fabricated_reference", 1)]
    assert R.validations(log).first().rejection_rate == 0.5


def test_counter_deltas_and_null_ratios(spark):
    ddl = "investigation_id string, role string, snapshot string, metric string, value double"
    rows = []
    for name, before, after in (("prompt_tokens_total", 1000.0, 3000.0), ("prefix_cache_queries_total", 100.0, 300.0),
                                ("prefix_cache_hits_total", 20.0, 120.0)):
        rows += [("r", "grunt", "before", f"vllm:{name}", before), ("r", "grunt", "after", f"vllm:{name}", after)]
    rows += [("r", "late", "after", "vllm:prompt_tokens_total", 7.0), ("r", "gone", "before", "vllm:prompt_tokens_total", 7.0)]
    got = {r.role: r for r in R.metric_delta(spark.createDataFrame(rows, ddl)).collect()}
    assert (got["grunt"].prompt_tokens, got["grunt"].prefix_cache_hit_rate) == (2000, 0.5)
    assert got["grunt"].mean_e2e_latency_s is None and got["late"].prompt_tokens == 7 and "gone" not in got


def test_scrape_adds_label_sets_and_skips_noise(spark):
    text = ['# HELP vllm:prompt_tokens_total x', 'vllm:prompt_tokens_total{a="1"} 1.5e+03', 'vllm:prompt_tokens_total{a="2"} 20',
            'vllm:prompt_tokens_total{a="3"} n/a', "vllm:other 5", "vllm:request_success_total 3"]
    df = spark.createDataFrame([("r", t) for t in text], "run string, text string")
    assert {r.metric: r.value for r in metrics.parse_scrape(df, ["run"]).collect()} == {
        "vllm:prompt_tokens_total": 1520.0, "vllm:request_success_total": 3.0}


def test_gpu_samples_keep_absent_apart_from_zero(spark):
    df = spark.createDataFrame([("0, 55.5, [N/A]",), ("1, 2",)], "t string").select(metrics.gpu_sample(F.col("t")).alias("s"))
    rows = [r.s for r in df.collect()]
    assert (rows[0].gpu_util, rows[0].gpu_power_w, rows[0].gpu_temp_c) == (0.0, 55.5, None) and rows[1] is None


HISTORY = "investigation_id string, backend string, worker_calls bigint, slices bigint, collecting_s double, concurrency_configured double"


@pytest.mark.parametrize(
    "rows, concurrency, low, high",
    [
        ([("run-1", "vllm", 136, 83, 1880.0, 8.0), ("run-2", "stub", 9, 9, 1.0, 8.0)], 8, 30, 33),
        ([("run-1", "vllm", 136, 83, 1880.0, 8.0)], 4, 60, 66),
        ([("run-1", "vllm", 136, 83, 1880.0, 0.0)], 8, 30, 33),
        ([("run-1", "vllm", 136, 0, 1880.0, 8.0)], 8, 31.1, 31.2),
        ([], 8, 31.1, 31.2),
    ],
)
def test_estimate(spark, rows, concurrency, low, high):
    work = spark.createDataFrame([("c", 83)], "case_id string, slices bigint")
    got = R.estimate(work, spark.createDataFrame(rows, HISTORY), concurrency).first()
    assert low < got.minutes < high


STATS = {
    "investigation_id": "run-1", "concurrency_configured": 8, "backend": "vllm", "time": {"by_phase_s": {"COLLECTING": 1880.0}},
    "work": {"slices": 83}, "roles": {"grunt": {"calls": 136}},
}


def test_run_stats_with_all_parts(spark):
    log = runlog.records(lines(spark, [
        step(1, "2026-08-14T10:00:00.000+00:00", "COLLECTING"), step(2, "2026-08-14T10:00:30.000+00:00", "DONE"),
        call(3, "grunt", 60_000.0), call(4, "commander", 1000.0),
        {"event_id": 5, "investigation_id": "r", "kind": "grunt_validation", "payload": {"ok": False, "problems": ["x"]}},
    ]))
    inventory = spark.createDataFrame([("r", 10, 2)], "investigation_id string, line_count bigint, slice_count bigint")
    samples = spark.createDataFrame([("r", "gpu_util", 10.0), ("r", "gpu_util", 30.0)], "investigation_id string, name string, value double")
    metric = spark.createDataFrame([("r", "grunt", "after", "vllm:request_success_total", 9.0)],
                                   "investigation_id string, role string, snapshot string, metric string, value double")
    got = R.run_stats(log, inventory=inventory, metrics=metric, samples=samples).first()
    assert (got.terminal_state, got.aborted_by_operator) == ("DONE", False)
    assert got.time.by_phase_s == {"COLLECTING": 30.0} and got.time.effective_parallelism == 2.0
    assert (got.work.files, got.work.lines_swept, got.work.slices, got.work.llm_calls) == (1, 10, 2, 2)
    assert got.work.rejection_reasons == {"other": 1} and got.roles["grunt"].latency_s.total == 60.0
    assert got.server["grunt"].requests == 9 and got.machine["gpu_util"].mean == 20.0


def test_append_only_log_and_history(spark, tmp_path):
    ddl = "investigation_id string, ts timestamp_ntz, sequence bigint, kind string"
    import datetime as dt

    def events(n, start):
        return spark.createDataFrame(
            [(f"r{i % 2}", dt.datetime(2026, 1, 1, start, i), i, "state_transition") for i in range(n)], ddl)

    path = str(tmp_path / "log")
    first = runlog.number_events(events(6, 1))
    runlog.append_events(first, path)
    written = spark.read.json(path)
    runlog.append_events(runlog.number_events(events(4, 2), written.select("investigation_id", "event_id")), path)
    rows = spark.read.json(path).orderBy("investigation_id", "event_id").collect()
    assert [(r.investigation_id, r.event_id) for r in rows] == [(f"r{k}", i) for k in (0, 1) for i in range(1, 6)]
    assert rows[0].ts == "2026-01-01T01:00:00.000Z"

    out = tmp_path / "out"
    for name, body in (("run-1", STATS), ("run-2", None)):
        (out / name).mkdir(parents=True)
        (out / name / "stats.json").write_text(json.dumps(body, indent=2) if body else "{broken")
    history = runlog.read_history(spark, f"{out}/*/stats.json")
    assert [r.investigation_id for r in history.collect()] == ["run-1"]
    flat = R.latest_run(R.history_rows(history)).first()
    assert (flat.investigation_id, flat.slices, flat.collecting_s, flat.concurrency_configured) == ("run-1", 83, 1880.0, 8.0)

    meta = spark.sql("SELECT 'r' AS run, named_struct('model', 'm', 'api_key', 'secret') AS worker")
    runlog.write_json(meta, str(tmp_path / "meta"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "meta").glob("*.json"))


def test_transitions_outside_the_table(spark):
    log = runlog.records(lines(spark, [
        step(1, "x", "TASKING", before="RECEIVED"), step(2, "x", "DONE", before="TASKING"), step(3, "x", "SWEEPING", before="DONE")]))
    got = sorted((r.from_state, r.to_state) for r in R.illegal_transitions(log).collect())
    assert got == [("DONE", "SWEEPING"), ("TASKING", "DONE")]


def test_statistics_of_many_runs_are_not_broadcast(spark):
    log = runlog.records(lines(spark, [step(1, "2026-08-14T10:00:00.000+00:00", "COLLECTING"), call(2, "grunt", 1000.0)]))
    inventory = spark.createDataFrame([("r", 10, 2)], "investigation_id string, line_count bigint, slice_count bigint")
    plan = R.run_stats(log, inventory=inventory)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [investigation_id" not in plan


def test_folders_of_the_sink_do_not_grow_with_the_runs(spark, tmp_path):
    events = spark.range(3000).selectExpr("concat('r', id % 1500) AS investigation_id", "timestamp_micros(id) AS ts", "id AS sequence", "'llm_call' AS kind")
    path = str(tmp_path / "log")
    runlog.append_events(runlog.number_events(events), path)
    assert len(list((tmp_path / "log").glob("runs=*"))) <= runlog.FOLDERS
    back = runlog.read_run_log(spark, path).groupBy("investigation_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n"))
    assert back.filter("a = 1 AND b = 2 AND n = 2").count() == 1500
    assert [r.event_id for r in runlog.read_run(spark, path, "r7").orderBy("event_id").collect()] == [1, 2]


def test_edges_of_many_runs_are_not_broadcast(spark):
    log = runlog.records(lines(spark, [step(n, f"2026-08-14T10:00:0{n}.000+00:00", "COLLECTING") for n in range(1, 4)]))
    gaps = R.phase_gaps(log)
    assert sorted(r.micros for r in gaps.collect()) == [1_000_000, 1_000_000]
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
