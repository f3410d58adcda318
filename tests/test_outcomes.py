"""What must survive the collapse: positives, counted negatives, failures, bounded lists."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sweeplog import schemas
from sweeplog.operators import brief as B
from sweeplog.operators import drilldown as D
from sweeplog.operators import outcomes as O

DDL = (
    "task_id string, case_id string, iteration bigint, slice_id string, file string, window_index bigint, instruction string, "
    "commander_intent string, outcome string, attempts bigint, reason string, detail string, body string"
)


def row(n, *, matches=0, checks=(), relevant=None, failure=None, case="c"):
    slice_id = f"a.log-{n:04d}"
    found = [{"description": "p", "match_count": matches, "representative_refs": [f"a.log:L{n}"], "first_ref": f"a.log:L{n}",
              "last_ref": f"a.log:L{n}", "confidence": "high"}] if matches else []
    body = None if failure else json.dumps(
        {"slice_metadata": {"slice_id": slice_id, "file": "a.log", "lines_examined": 9},
         "relevant": bool(matches) if relevant is None else relevant, "findings": found,
         "checked_for": [{"checked_for": c, "found": f, "result": "r"} for c, f in checks]}
    )
    return (f"t{n}", case, 0, slice_id, "a.log", n, "read", "why", "failure" if failure else "report", 1, failure,
            "gone" if failure else None, body)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("report", F.from_json("body", schemas.REPORT_DDL))


def test_buckets_and_stray_hits(spark):
    df = frame(spark, [row(1, matches=3), row(2, checks=[("lease", True)]), row(3, failure="timeout"), row(4, relevant=True)])
    got = O.coverage(df).first()
    assert (got.tasks, got.detailed, got.empty, got.failed) == (4, 1, 2, 1)
    assert (got.stray_hits, got.relevant_without_findings, got.matching_lines) == (1, 1, 3)
    assert O.stray_hits(df).first().checked_for == "lease"
    assert "was not examined" in O.failure_lines(df).first().text


def test_one_negative_over_twelve_slices(spark):
    df = frame(spark, [row(n, checks=[("beacon", False)]) for n in range(1, 13)])
    got = O.negative_checks(df).collect()
    assert [(r.checked_for, r.slices) for r in got] == [("beacon", 12)]
    assert "'beacon': absent from 12 slice(s)" in O.coverage_text(df).first().negatives


def test_negatives_are_bounded_with_ties_by_first_occurrence(spark):
    rows = [row(n, checks=[(f"subject {300 - n}", False)]) for n in range(1, 201)] + [row(250, checks=[("late", False)] * 2)]
    got = O.top_negatives(frame(spark, rows)).orderBy("rank").collect()
    assert len(got) == 25 and got[0].checked_for == "late"
    assert [r.checked_for for r in got[1:4]] == ["subject 299", "subject 298", "subject 297"]
    assert O.negative_checks(frame(spark, rows)).count() == 201


def test_first_forty_in_window_order_beyond_four_digits(spark):
    rows = [row(n) for n in [*range(9_990, 10_040)]]
    got = O.first_empty(frame(spark, rows)).first()
    assert got.empty == 50 and got.more == 10
    assert got.listed.split(", ")[:2] == ["a.log-9990", "a.log-9991"] and got.listed.split(", ")[-1] == "a.log-10029"


def test_ledger_texts(spark):
    df = frame(spark, [row(1, matches=3), row(2), row(3, failure="aborted")])
    got = {r.task_id: r.detail for r in O.ledger(df).collect()}
    assert got == {"t1": "3 matching line(s) in 1 finding(s), 1 attempt(s)", "t2": "swept, nothing relevant, 1 attempt(s)",
                   "t3": "aborted: gone"}


def test_settle_keeps_finished_work_and_fails_the_rest(spark):
    done = frame(spark, [row(1, matches=1), row(2, matches=1), row(3, matches=1)])
    answers = done.filter("task_id <> 't3'").select(
        "task_id", "attempts", "report",
        F.when(F.col("task_id") == "t2", F.array(F.lit("findings[0] cites 'x'"))).otherwise(F.array().cast("array<string>")).alias("problems"),
    )
    got = {r.task_id: r for r in O.settle(done, answers, missing="aborted", missing_detail="cancelled").collect()}
    assert got["t1"].outcome == "report" and got["t1"].report is not None
    assert (got["t2"].reason, got["t2"].detail) == ("citations", "report rejected after 1 attempt(s)")
    assert (got["t3"].reason, got["t3"].detail, got["t3"].attempts) == ("aborted", "cancelled", 0)


def test_drilldown_takes_the_densest_and_knows_neighbours(spark):
    df = frame(spark, [row(n, matches=n) for n in range(1, 21)])
    slices = spark.createDataFrame(
        [("c", "a.log", n, f"a.log-{n:04d}", n * 10, n * 10 + 9) for n in range(1, 21)],
        "case_id string, file string, window_index bigint, slice_id string, start_line bigint, end_line bigint",
    )
    chosen = D.choose(df, max_drilldowns=2, max_tasks=4)
    assert sorted((r.iteration, r.match_count) for r in chosen.collect()) == [
        (1, 17), (1, 18), (1, 19), (1, 20), (2, 13), (2, 14), (2, 15), (2, 16)]
    around = D.neighbours(chosen.filter("rank = 1"), slices).collect()
    assert [r.window_index for r in around] == [19]
    assert D.taskings(chosen, slices).filter("task_id = 'c/i2-t0'").first().slice_id == "a.log-0016"


def test_uncited_claims_have_locators(spark):
    ddl = ("case_id string, investigation_id string, investigation_narrative string, "
           "timeline array<struct<description:string,raw_line_refs:array<string>>>, "
           "hypotheses array<struct<supporting_evidence:array<struct<description:string,raw_line_refs:array<string>>>,"
           "contradicting_evidence:array<struct<description:string,raw_line_refs:array<string>>>>>")
    bodies = spark.createDataFrame(
        [("c", "i", "text", [("cited", ["a.log:L1"]), ("x" * 200, [])], [([("s", ["a.log:L9"])], [("none", [])])]),
         ("c", "j", None, [], [])], ddl)
    got = sorted(r.claim for r in B.uncited_claims(B.claims(bodies)).collect())
    assert got == ["hypotheses[0].contradicting_evidence[0]: none", "timeline[1]: " + "x" * 120]
    inventory = spark.createDataFrame([("c", "a.log", 3)], "case_id string, file string, line_count bigint")
    counts = {r.investigation_id: r for r in B.quality_counts(bodies, inventory).collect()}
    assert (counts["i"].unresolved_citations, counts["i"].uncited_claims, counts["i"].narrative_chars) == (1, 2, 4)
    assert (counts["j"].timeline_events, counts["j"].narrative_chars) == (0, 0)
