"""The sweep followed by rounds of closer reads, and what is stamped on a brief."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sweeplog.operators import brief as B
from sweeplog.operators import drilldown as D
from sweeplog.operators import runstats as R
from sweeplog.plans import jobs

BUDGET = 2_000
PER_SLICE = 10


@pytest.fixture(scope="module")
def case(spark):
    """Twelve slices of ten lines; every slice but the last has hits, the third most, the eighth second most."""
    hits = {1: {3}, 2: {1, 2, 7}, 3: {1, 2, 3, 5, 6, 9}, 4: {4}, 5: {1, 9}, 6: {2}, 7: {3}, 8: {1, 2, 3, 4, 5}, 9: {2}, 10: {5, 6}, 11: {1}, 12: set()}
    rows = [("c", "f", (k - 1) * PER_SLICE + i, "evil line" if i in hits[k] else "plain") for k in hits for i in range(1, PER_SLICE + 1)]
    slices = [("c", "f", f"f-{k:04d}", k, (k - 1) * PER_SLICE + 1, k * PER_SLICE) for k in hits]
    return {
        "hits": hits,
        "lines": spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string"),
        "slices": spark.createDataFrame(slices, "case_id string, file string, slice_id string, window_index bigint, start_line bigint, end_line bigint"),
        "directive": spark.createDataFrame([("c", "look", ["evil", "none"], "")], "case_id string, alert_restatement string, indicators array<string>, time_window string"),
    }


def run(case, **options):
    return jobs.investigate(case["lines"], case["slices"], case["directive"], budget=BUDGET, **options)


def test_rounds_follow_what_the_last_one_confirmed(case):
    rows = run(case, rounds=3, max_tasks=2).collect()
    chosen = {k: [r.window_index for r in sorted(rows, key=lambda r: r.task_id) if r.iteration == k] for k in range(4)}
    assert len(chosen[0]) == 12 and chosen[1] == [3, 8]
    assert chosen[2] == [2, 4]  # beside what was confirmed: the densest first, ties by window
    assert chosen[3] == [5, 1]
    assert len({r.task_id for r in rows}) == len(rows) and all(r.outcome == "report" for r in rows)


def test_closer_reads_report_runs_of_lines(case):
    rows = {r.window_index: r for r in run(case, rounds=1, max_tasks=2).filter("iteration = 1").collect()}
    found = [(f.match_count, f.first_ref, f.last_ref, len(f.representative_refs)) for f in rows[3].report.findings]
    assert found == [(3, "f:L21", "f:L23", 3), (2, "f:L25", "f:L26", 2), (1, "f:L29", "f:L29", 1)]
    assert rows[3].report.slice_metadata.lines_examined == PER_SLICE and rows[3].task_id == "c/i1-t0"
    assert [f.match_count for f in rows[8].report.findings] == [5]


def test_the_loop_ends_when_nothing_is_left(case):
    rows = run(case, rounds=20, max_tasks=5).collect()
    assert sorted(r.window_index for r in rows if r.iteration > 0) == list(range(1, 12)) and max(r.iteration for r in rows) == 3
    none = run(case | {"directive": case["directive"].withColumn("indicators", F.array(F.lit("none")))}, rounds=2)
    assert none.agg(F.max("iteration")).first()[0] == 0


def test_a_bad_reader_is_rejected_and_its_slices_are_not_chosen_again(case):
    def wrong(lines, tasks, directive, *, budget):
        report = F.col("report")
        made = D.close_reports(lines, tasks, directive, budget=budget)
        cited = F.transform(report["findings"], lambda f: f.withField("first_ref", F.lit("f:L999")))
        return made.withColumn("report", report.withField("findings", cited))

    rows = run(case, rounds=2, max_tasks=2, reader=wrong).filter("iteration > 0").collect()
    assert {(r.outcome, r.reason) for r in rows} == {("failure", "citations")}
    assert sorted((r.iteration, r.window_index) for r in rows) == [(1, 3), (1, 8), (2, 2), (2, 5)]


def test_brief_records_and_statistics_carry_what_is_stamped(spark):
    claim = "array(named_struct('description', 'd', 'raw_line_refs', array('f:L1', 'f:L9')), named_struct('description', 'no ref', 'raw_line_refs', cast(array() AS array<string>)))"
    bodies = spark.sql(f"SELECT 'c' case_id, i investigation_id, 'text' investigation_narrative, {claim} timeline, "
                       "cast(array() AS array<struct<supporting_evidence:array<struct<description:string,raw_line_refs:array<string>>>,"
                       "contradicting_evidence:array<struct<description:string,raw_line_refs:array<string>>>>>) hypotheses FROM VALUES ('r1'), ('r2') AS t(i)")
    inventory = spark.sql("SELECT 'c' case_id, 'f' file, 5L line_count, 1L slice_count")
    briefs = spark.sql("SELECT 'c' case_id, 'A-1' alert_id")
    log = spark.createDataFrame(
        [("r1", 1, "2026-08-14T10:00:00.000+00:00", "TASKING", "ABORTING"), ("r1", 2, "2026-08-14T10:00:07.500+00:00", "SYNTHESIZING", "DONE")],
        "investigation_id string, event_id bigint, ts string, from_state string, to_state string").withColumn("kind", F.lit("state_transition"))
    got = {r.investigation_id: r for r in B.records(briefs, bodies, inventory, R.final_states(log)).collect()}
    assert (got["r1"].terminal_state, got["r1"].aborted_by_operator, got["r1"].alert_id) == ("DONE", True, "A-1")
    assert (got["r2"].terminal_state, got["r2"].aborted_by_operator) == ("", False)
    assert got["r1"].unresolved_citations == ["f:L9"] and got["r1"].uncited_claims == ["timeline[1]: no ref"]
    assert R.wall_clock(log).first().wall_clock_s == 7.5
