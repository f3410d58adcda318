"""The sweep on a small case: hits, findings, filters and reports against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sweeplog import session
from sweeplog.functions import render
from sweeplog.functions.lines import text_indicators
from sweeplog.operators import citations as C
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators import slices as SL
from sweeplog.plans import jobs

ALERT = (
    "SELECT 'c' AS case_id, 'A-1' AS alert_id, 'flow' AS detector, 'periodic lookups' AS rule_name, 'open' AS status, "
    "'medium' AS severity, 'a' AS first_seen, 'b' AS last_seen, '10.1.2.3 asked x.bad-sync.net and bad-sync.net' AS summary, "
    "array(named_struct('kind', 'host', 'value', 'wks-1', 'note', 'lease'), named_struct('kind', 'ip', 'value', '10.1.2.3', 'note', '')) AS entities, "
    "map('b', '2', 'a', '1') AS raw_detector_fields"
)
BUDGET = 600


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    parts = ["10.1.2.3", "wks-1", "x.bad-sync.net", "noise", "routine lookup", "2031-02-05T08:14:55Z", "Feb  5 07:31:09"]
    # hot.log holds nearly all lines.
    return {
        "hot.log": [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(2500)],
        "small.log": ["10.1.2.3", "nothing"], "other.log": ["nothing"] * 40,
    }


@pytest.fixture(scope="module")
def lines(spark, texts):
    rows = [("c", f, i, t) for f, ts in texts.items() for i, t in enumerate(ts, 1)]
    return spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string").repartition(5)


@pytest.fixture(scope="module")
def directive(spark):
    return I.directives(spark.sql(ALERT), irrelevant=["routine lookup"], time_window="2031-02-05T08:00:00Z/2031-02-05T09:00:00Z")


INDICATORS = ["x.bad-sync.net", "bad-sync.net", "10.1.2.3", "wks-1"]


def test_indicators_come_in_order_and_once(directive):
    assert directive.first().indicators == INDICATORS


def test_indicators_are_capped_per_kind(spark):
    text = " ".join(f"h{i}.example.com 10.0.0.{i}" for i in range(9))
    got = spark.createDataFrame([(text,)], "t string").select(text_indicators(F.col("t")).alias("i")).first().i
    assert got == [f"h{i}.example.com" for i in range(4)] + [f"10.0.0.{i}" for i in range(4)]


@pytest.mark.parametrize("limit", [None, 0])
def test_mentions_equal_a_plain_scan(lines, directive, texts, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(session.join_small, "__kwdefaults__", session.join_small.__kwdefaults__ | {"limit_bytes": limit})
    got = {(r.file, r.indicator): r for r in I.mentions(I.indicator_hits(lines, directive)).collect()}
    want = {}
    for file, rows in texts.items():
        for n, text in enumerate(rows, 1):
            for indicator in INDICATORS:
                if indicator in text:
                    want.setdefault((file, indicator), []).append(n)
    assert got.keys() == want.keys()
    for key, numbers in want.items():
        refs = [f"{key[0]}:L{n}" for n in numbers]
        assert (got[key].match_count, got[key].first_ref, got[key].last_ref) == (len(refs), refs[0], refs[-1])
        assert got[key].representative_refs == refs[:5]


def test_sweep_reports_are_valid_and_complete(lines, directive, texts):
    slices = SL.slice_places(lines, budget=BUDGET)
    outcomes = jobs.sweep(lines, slices, directive, budget=BUDGET)
    assert outcomes.count() == slices.count()
    problems = C.with_problems(outcomes.drop("file"), slices).filter(F.size("problems") > 0)
    assert problems.count() == 0
    total = O.coverage(outcomes).first()
    assert total.matching_lines == sum(i in t for ts in texts.values() for t in ts for i in INDICATORS)
    assert total.failed == 0 and total.detailed + total.empty == total.tasks
    once = I.line_totals(I.indicator_hits(lines, directive)).first()
    assert once.distinct_lines == sum(any(i in t for i in INDICATORS) for ts in texts.values() for t in ts)
    assert O.negative_checks(outcomes).count() == 0  # what is absent follows from the directive
    absent = {r.checked_for: r.slices for r in O.negatives_by_difference(outcomes, directive).collect()}
    assert absent == {r.checked_for: r.slices for r in O.negative_checks(I.with_absent(outcomes, directive)).collect()}
    assert absent["wks-1"] + outcomes.filter(F.exists("report.findings", lambda f: f["description"].contains("wks-1"))).count() == total.tasks


def test_exclusion_never_hides_a_hit(lines, directive, texts):
    rows = I.apply_exclusions(lines, directive).collect()
    for r in rows:
        listed, hit = "routine lookup" in r.text, any(i in r.text for i in INDICATORS)
        assert (r.excluded, r.conflict) == (listed and not hit, listed and hit)
    assert any(r.conflict for r in rows) and any(r.excluded for r in rows)


def test_time_window(spark, directive):
    stamps = ["2031-02-05T08:14:55Z in", "2031-02-05 09:30:00 out", "Feb  5 07:31:09 no year", "1928044800.123456 epoch", "none"]
    lines = spark.createDataFrame([("c", "f", i, t) for i, t in enumerate(stamps, 1)], "case_id string, file string, line_no bigint, text string")
    assert sorted(r.line_no for r in I.within_window(lines, directive).collect()) == [1, 3, 4, 5]
    assert sorted(r.line_no for r in I.within_window(lines, directive, keep_untimed=False).collect()) == [1, 4]
    assert I.within_window(lines, directive.withColumn("time_window", F.lit(""))).count() == 5


def test_time_range_is_textual(spark):
    rows = [("c", "a", 1, "Feb  5 07:31:09 x"), ("c", "a", 2, "1928044800.123456 y"), ("c", "b", 1, "no stamp")]
    lines = spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string")
    got = {r.file: r.time_range for r in SL.file_times(lines).collect()}
    assert got == {"a": "1928044800.123456/Feb  5 07:31:09", "b": "unknown (no timestamps recognised)"}


def test_fenced_alert_marks_owned_fields(spark):
    block = spark.sql(ALERT).select(render.fence_alert().alias("b")).first().b
    assert block.startswith('<<<UNTRUSTED_DATA kind="external_alert"') and block.endswith("\n>>>END_UNTRUSTED_DATA")
    assert "status (READ-ONLY, owned by flow): open" in block
    assert "\n  host=wks-1 lease\n  ip=10.1.2.3\ndetector_fields:\n  a = 1\n  b = 2\n" in block


def test_token_hits_match_parent_domains_only_on_label_borders(spark):
    rows = [("c", "f", 1, "q a.b.bad-sync.net"), ("c", "f", 2, "q notbad-sync.net"), ("c", "f", 3, "ip 10.1.2.3 10.1.2.34")]
    lines = spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string")
    wanted = spark.createDataFrame([("c", "bad-sync.net"), ("c", "10.1.2.3")], "case_id string, indicator string")
    assert sorted((r.line_no, r.indicator) for r in I.token_hits(lines, wanted).collect()) == [(1, "bad-sync.net"), (3, "10.1.2.3")]


def test_ground_outside_the_window_is_not_reported_clear(spark):
    stamps = {1: "2031-02-05T08:04:12Z evil", 2: "2031-02-05T08:05:12Z x", 3: "2034-01-01T00:00:00Z evil", 4: "2034-01-01T00:00:00Z evil bad", 5: "2031-02-05T08:06:00Z bad"}
    lines = spark.createDataFrame([("c", "f", i, t) for i, t in stamps.items()], "case_id string, file string, line_no bigint, text string")
    directive = spark.createDataFrame([("c", "look", ["evil", "bad", "none"], "2031-02-01T00:00:00Z/2031-03-01T00:00:00Z")],
                                      "case_id string, alert_restatement string, indicators array<string>, time_window string")
    slices = spark.createDataFrame([("c", "f", f"f-000{k}", k, a, b) for k, a, b in ((1, 1, 2), (2, 3, 4), (3, 5, 5))],
                                   "case_id string, file string, slice_id string, window_index bigint, start_line bigint, end_line bigint")
    outcomes = jobs.sweep(lines, slices, directive, budget=BUDGET)
    state = {r.slice_id: (r.report.relevant, [c.checked_for for c in r.report.checked_for], r.seen) for r in outcomes.collect()}
    assert state == {"f-0001": (True, [], ["evil"]), "f-0002": (False, ["bad", "evil"], ["bad", "evil"]), "f-0003": (True, [], ["bad"])}
    assert {(r.checked_for, r.slices) for r in O.negatives_by_difference(outcomes, directive).collect()} == {("none", 3), ("evil", 1), ("bad", 1)}
    assert {(r.checked_for, r.slices) for r in O.seen_outside(outcomes).collect()} == {("bad", 1), ("evil", 1)}
    text = jobs.collapse(outcomes, directive).first()
    assert "'none': absent from 3 slice(s)" in text.negatives and "'evil': absent from 1" in text.negatives


@pytest.mark.parametrize("listed", [100_000, 3])
def test_seeded_hits_equal_the_plain_scan(spark, listed, monkeypatch):
    import random

    monkeypatch.setattr(I, "LISTED_SEEDS", listed)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé.日") for _ in range(n))
    rows = [(rng.choice("cd"), "f", i, word(rng.randrange(0, 40))) for i in range(400)] + [("c", "g", 1, None), ("e", "g", 1, "abab")]
    names = {c: list({word(rng.randrange(1, 7)) for _ in range(90)}) + ["", "ab"] for c in "cd"}
    lines = spark.createDataFrame(rows, "case_id string, file string, line_no bigint, text string")
    directive = spark.createDataFrame([*names.items(), ("e", []), ("x", None)], "case_id string, indicators array<string>")
    want = sorted((c, f, n, i) for c, f, n, t in rows for i in set(names.get(c, [])) if t and i and i in t)
    for indexed in (None, False):
        got = I.indicator_hits(lines, directive, indexed=indexed).select("case_id", "file", "line_no", "indicator").collect()
        assert sorted(tuple(r) for r in got) == want
    none = directive.filter("case_id = 'e'")
    assert I.indicator_hits(lines, none, indexed=True).count() == 0 == I.indicator_hits(lines, none).count()


def test_the_plan_for_many_indicators_holds_no_list_of_them(spark, lines):
    directive = spark.createDataFrame([("c", "r", [f"host-{i:05d}.example.com" for i in range(10_000)], "")],
                                      "case_id string, alert_restatement string, indicators array<string>, time_window string")
    hits = I.indicator_hits(lines, directive)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "host-00" not in plan and hits.count() == 0
