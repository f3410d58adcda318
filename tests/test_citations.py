"""Report rules, one case per rule, against a slice of three lines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sweeplog import schemas
from sweeplog.functions import problems as P
from sweeplog.operators import citations as C

FILE, SLICE = "dns_resolver.log", "dns_resolver.log-0002"


def finding(refs, count=None, first=None, last=None):
    return {
        "description": "pattern", "match_count": len(refs) if count is None else count, "representative_refs": refs,
        "first_ref": (refs[0] if refs else "") if first is None else first,
        "last_ref": (refs[-1] if refs else "") if last is None else last, "confidence": "medium",
    }


def report(findings, relevant=True, checks=(), slice_id=SLICE):
    return {"slice_metadata": {"slice_id": slice_id, "file": FILE, "lines_examined": 3}, "relevant": relevant,
            "findings": findings, "checked_for": list(checks)}


L5, L6, L7 = (f"{FILE}:L{n}" for n in (5, 6, 7))
FOUND = {"checked_for": "lease", "found": True, "result": "line 5"}
ABSENT = {"checked_for": "lease", "found": False, "result": "no"}

CASES = {
    "well cited": (report([finding([L5, L6])]), []),
    "nothing in it": (report([], relevant=False), []),
    "negative check": (report([], relevant=False, checks=[ABSENT]), []),
    "no refs": (report([finding([])]), ["no representative_refs"]),
    "fabricated": (report([finding([f"{FILE}:L4000"])]), ["not in slice", "not in slice", "not in slice"]),
    "other file": (report([finding([L5], first="proxy.log:L5")]), ["endpoints cites 'proxy.log:L5'"]),
    "leading zero": (report([finding([f"{FILE}:L05"], first="", last="")]), ["not in slice"]),
    "malformed": (report([finding(["line five"], first="", last="")]), ["citation 'line five' is malformed"]),
    "over cap": (report([finding([L5, L6, L7, L5, L6, L7], count=6)]), ["the limit is 5"]),
    "count below refs": (report([finding([L5, L6], count=1)]), ["has match_count 1 but cites 2 lines"]),
    "bad end point": (report([finding([L5], last=f"{FILE}:L8")]), ["endpoints cites"]),
    "empty end point": (report([finding([L5], first="", last="")]), []),
    "irrelevant with findings": (report([finding([L5])], relevant=False), ["irrelevant comes with findings"]),
    "irrelevant with a hit": (report([], relevant=False, checks=[FOUND]), ["positive result for 'lease'"]),
    "relevant with a hit": (report([finding([L5])], checks=[FOUND]), []),
    "wrong slice": (report([finding([L5])], slice_id="other-0001"), ["slice_metadata.slice_id is 'other-0001'"]),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(name, "c", SLICE, json.dumps(given)) for name, (given, _) in CASES.items()]
    reports = spark.createDataFrame(rows, "name string, case_id string, slice_id string, body string").withColumn(
        "report", F.from_json("body", schemas.REPORT_DDL)
    )
    slices = spark.createDataFrame([("c", SLICE, FILE, 5, 7)], "case_id string, slice_id string, file string, start_line bigint, end_line bigint")
    kept = C.with_problems(reports, slices).withColumn("compat", P.failure_reason(F.col("problems"), compat=True)).withColumn(
        "reason", P.failure_reason(F.col("problems"))
    )
    return {r["name"]: r for r in kept.collect()}


@pytest.mark.parametrize("name", CASES)
def test_rule(judged, name):
    wanted = CASES[name][1]
    got = judged[name].problems
    assert len(got) == len(wanted), got
    for text, phrase in zip(got, wanted):
        assert phrase in text


def test_malformed_ref_is_a_citation_failure_unless_compat(judged):
    assert judged["malformed"].reason == "citations" and judged["malformed"].compat == "schema"
    assert judged["fabricated"].reason == judged["fabricated"].compat == "citations"


def test_unicode_names_are_well_formed(spark):
    from sweeplog.functions.lines import is_well_formed_ref

    refs = {"é.log:L1": True, "a b.log:L1": False, "a/b-c.d:L12": True, "a:L": False, "x:y:L1": False, "a.log:L1x": False}
    df = spark.createDataFrame([(r,) for r in refs], "ref string").withColumn("ok", is_well_formed_ref(F.col("ref")))
    assert {r.ref: r.ok for r in df.collect()} == refs


def test_reasons_count_once_per_report_and_truncation_hides_the_rest(spark):
    rows = [
        (["findings[0] cites 'a:L1', which is not in slice s", "findings[0] cites 'a:L2', which is not in slice s"],),
        (["Your reply was cut off at the token limit (900 tokens)", "Response was not valid JSON."],),
        (["findings[0] returned 9 representative_refs; the limit is 5.", "something else"],),
    ]
    df = spark.createDataFrame(rows, "problems array<string>").select(P.rejection_reasons(F.col("problems")).alias("r"))
    assert [r.r for r in df.collect()] == [["fabricated_reference"], ["truncated_at_token_limit"], ["refs_over_cap", "other"]]


def test_unresolved_refs_use_file_sizes(spark):
    refs = ["a.log:L1", "a.log:L3", "a.log:L4", "b.log:L1", "nonsense", "a.log:L0", "a.log:L1"]
    cited = spark.createDataFrame([("c", r) for r in refs], "case_id string, ref string")
    inventory = spark.createDataFrame([("c", "a.log", 3)], "case_id string, file string, line_count bigint")
    got = sorted(r.ref for r in C.unresolved_refs(cited, inventory).collect())
    assert got == ["a.log:L0", "a.log:L4", "b.log:L1", "nonsense"]
