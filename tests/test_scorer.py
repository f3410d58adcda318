"""A reader of the test's own: accepted, corrected on retry, cut off, raising, fabricating."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle

from sweeplog.operators import scorer as SC
from sweeplog.operators import slices as SL

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reader(lines, task, feedback):
    slice_id, file = task["slice_id"], task["file"]

    def report(refs, relevant=True, **more):
        finding = {"description": "x", "match_count": len(refs), "representative_refs": refs, "first_ref": refs[0] if refs else "",
                   "last_ref": refs[-1] if refs else "", "confidence": "high"}
        return json.dumps({"slice_metadata": {"slice_id": slice_id, "file": file, "lines_examined": len(lines)},
                           "relevant": relevant, "findings": [finding] if relevant else [],
                           "checked_for": [{"checked_for": "lease", "found": False, "result": "no"}], **more})

    first = lines["ref"].iloc[0]
    if file == "good.log":
        return "```json\n" + report([first]) + "\n```"
    if file == "retry.log":
        return report([first]) if feedback else report([f"{file}:L4000"])
    if file == "cut.log":
        return {"reply": report([first])[:-20], "finish_reason": "length", "completion_tokens": 900}
    if file == "raise.log":
        raise RuntimeError("endpoint gone")
    if file == "verdict.log":
        return report([first], verdict="benign")
    return report([], relevant=False)


@pytest.fixture(scope="module")
def outcomes(spark):
    files = ["good.log", "retry.log", "cut.log", "raise.log", "verdict.log", "quiet.log"]
    rows = [("c", f, i, f"{f} line {i}") for f in files for i in range(1, 31)]
    lines = spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string")
    directive = spark.createDataFrame([("c", "look", ["x"])], "case_id string, alert_restatement string, indicators array<string>")
    places = SL.slice_places(lines, budget=10_000)
    result = SC.sweep_with_scorer(lines, places, directive, reader, budget=10_000, concurrency=2)
    return {r.file: r for r in result.collect()}


def test_fenced_reply_is_accepted_at_once(outcomes):
    row = outcomes["good.log"]
    assert (row.outcome, row.attempts) == ("report", 1)
    assert row.report.findings[0].representative_refs == ["good.log:L1"]
    assert row.report.slice_metadata.lines_examined == 30


def test_fabricated_ref_is_corrected_on_retry(outcomes):
    assert (outcomes["retry.log"].outcome, outcomes["retry.log"].attempts) == ("report", 2)


def test_cut_reply_fails_with_its_own_reason(outcomes):
    row = outcomes["cut.log"]
    assert (row.outcome, row.reason, row.attempts) == ("failure", "truncated", 2)
    assert "cut off at the token limit (900 tokens)" in row.validation_errors[0]


def test_raising_reader_is_a_failure_row_without_retry(outcomes):
    row = outcomes["raise.log"]
    assert (row.outcome, row.reason, row.attempts) == ("failure", "transport", 1)
    assert "endpoint gone" in row.detail


def test_unknown_field_is_rejected(outcomes):
    row = outcomes["verdict.log"]
    assert (row.outcome, row.reason) == ("failure", "schema")
    assert row.validation_errors == ["field verdict: Extra inputs are not permitted"]


def test_nothing_found_is_a_report(outcomes):
    assert outcomes["quiet.log"].outcome == "report" and not outcomes["quiet.log"].report.relevant


def test_a_reply_is_parsed_once(spark):
    from pyspark.sql import functions as F

    from sweeplog.functions import replies

    plan = spark.createDataFrame([("{}",)], "reply string").select(replies.report_reply_problems(F.col("reply")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") <= 2


def _replies():
    finding = {"description": "x", "match_count": 2, "representative_refs": ["a:L1"], "first_ref": "", "last_ref": "", "confidence": "low"}
    check = {"checked_for": "k", "found": False, "result": "no"}
    plain = {"slice_metadata": {"slice_id": "s", "file": "f", "lines_examined": 3}, "relevant": True, "findings": [finding], "checked_for": [check]}
    less = lambda d, *names: {k: v for k, v in d.items() if k not in names}
    given = [plain, plain | {"findings": [], "checked_for": []}, less(plain, "findings", "checked_for"), less(plain, "relevant"), plain | {"more": 1}]
    for name in finding:
        odd = [less(finding, name), *(finding | {name: v} for v in (None, 3, 3.5, "high", "x", [], [None], [1, "x"], ["a", None], {"a": 1}, 1 << 70, True))]
        given += [plain | {"findings": [finding, x]} for x in odd] + [plain | {"findings": [x]} for x in odd]
    for name in check:
        odd = [less(check, name), *(check | {name: v} for v in (None, 3, "x", True))]
        given += [plain | {"checked_for": [check, x]} for x in odd] + [plain | {"checked_for": [x]} for x in odd]
    for name in plain["slice_metadata"]:
        given += [plain | {"slice_metadata": x} for x in (less(plain["slice_metadata"], name), plain["slice_metadata"] | {name: None}, plain["slice_metadata"] | {name: 2.5})]
    given += [plain | {name: v} for name in plain for v in (None, [], [None], {}, "x", 1, [finding, "x"], [check, 1], [finding, None])]
    texts = [json.dumps(x) for x in given]
    texts += [None, "", "[]", "1", "null", "{", texts[0] + "x", texts[0][:-1] + ', "relevant": false}', texts[0].replace('"relevant"', '"Relevant"')]
    return texts + ["```json\n" + texts[0] + "\n```", "```\n```json\n" + texts[0] + "\n```\n```", " \n" + texts[0] + "\t", texts[0].replace(": 2,", ": 2.0,")]


def test_the_short_way_gives_what_all_rules_give(spark):
    from pyspark.sql import functions as F

    from sweeplog import schemas
    from sweeplog.functions import replies

    reply, ddl = F.col("reply"), schemas.REPORT_DDL
    rows = spark.createDataFrame([(t,) for t in _replies()], "reply string")
    got = rows.select("reply", replies.read_report(reply, ddl).alias("r"), replies.report_reply_problems(reply).alias("p"), replies.parse_report(reply, ddl).alias("t")).collect()
    assert len(got) > 200 and 10 < sum(r.p == [] for r in got) < len(got) / 2
    for r in got:
        assert r.r.problems == r.p and r.r.report == (r.t if r.p == [] else None), r.reply


def test_judging_reads_a_reply_once(spark):
    answers = spark.createDataFrame([("c", "s", "{}", "stop", 1)], "case_id string, slice_id string, reply string, finish_reason string, completion_tokens bigint")
    slices = spark.createDataFrame([("c", "s", "f", 1, 2)], "case_id string, slice_id string, file string, start_line bigint, end_line bigint")
    plan = SC.judge(answers, slices)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_json(") == 1 and plan.count("```") == 2  # typed once, and its fence is taken off once


def test_answers_hold_their_place_and_are_judged_without_a_join(spark):
    fields = "task_id string, case_id string, slice_id string, file string, start_line bigint, end_line bigint, refs array<string>, texts array<string>, feedback array<string>"
    rows = [(f"c/sweep/{f}-0001", "c", f"{f}-0001", f, 4, 5, [f"{f}:L4", f"{f}:L5"], ["a", "b"], []) for f in ("good.log", "retry.log", "raise.log", "cut.log")]
    answers = SC.score(spark.createDataFrame(rows, fields), reader)
    alone = SC.judge(answers, None)
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()
    slices = spark.createDataFrame([r[1:6] for r in rows], "case_id string, slice_id string, file string, start_line bigint, end_line bigint")
    picked = lambda df: {(r.slice_id, r.file, r.start_line, r.end_line, r.report is None, tuple(r.problems)) for r in df.collect()}
    assert picked(alone) == picked(SC.judge(answers, slices)) and len(picked(alone)) == 4
    assert {(r.task_id, r.file, r.start_line, r.end_line) for r in answers.collect()} == {(r[0], r[3], 4, 5) for r in rows}


def test_texts_without_the_end_of_a_name_hold_no_domain():
    from sweeplog.binding import views as V
    from sweeplog.functions import lines as L

    ends = L.DOMAIN.rsplit("(?:", 1)[1].removesuffix(r")\b").split("|")
    assert L.DOMAIN.endswith(r"\.)+(?:" + "|".join(ends) + r")\b") and V.DOMAIN_ENDS == tuple(f".{end}" for end in ends)
