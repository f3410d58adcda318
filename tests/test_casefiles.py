"""Case folders written by the test: numbering over file pieces, odd names, bad alerts."""

from __future__ import annotations

import json
import random

import pytest

from sweeplog.operators import slices as SL
from sweeplog.sources import casefiles as CF

ALERT = {
    "alert_id": "A-1", "detector": "flow", "rule_name": "periodic lookups", "status": "open", "severity": "medium",
    "first_seen": "2031-02-05T09:10:11Z", "last_seen": "2031-02-05T10:20:21Z", "summary": "10.1.2.3 asked bad-sync.net",
}


def write_case(parent, name, files, alert=None):
    logs = parent / name / "logs"
    logs.mkdir(parents=True)
    for file, data in files.items():
        (logs / file).write_bytes(data if isinstance(data, bytes) else data.encode())
    if alert is not None:
        (parent / name / "alert.json").write_text(alert if isinstance(alert, str) else json.dumps(alert))


def listing(spark, parent):
    rows = [(p.name, str(p)) for p in sorted(parent.iterdir())]
    return CF.list_cases(spark.createDataFrame(rows, "case_id string, root string"))


@pytest.mark.parametrize("max_bytes", ["128m", "300"])
def test_lines_equal_splitlines(spark, tmp_path, max_bytes):
    rng = random.Random(3)
    long = "\n".join("x" * rng.randint(0, 40) for _ in range(500)) + "\n"
    files = {
        "plain.log": "a\nb\n\nc", "crlf.log": "a\r\nb\rc\r\n", "odd.log": "a\x0bb\x0c\n\x1c\x85c\u2028d\u2029\ne\x1e",
        "bytes.log": b"ok\n\xff\xfe bad \xc3\xa9\n", "long.log": long, "_hidden.log": long + "tail", "sp ace+1.log": "one\ntwo",
        "_odd.log": "a\x0bb\r\nc\x85", ".skip": "no", "empty.log": "",
    }
    write_case(tmp_path, "c1", files, ALERT)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
    try:
        lines = CF.read_lines(spark, str(tmp_path), listing(spark, tmp_path), piece_bytes=400)
        rows = lines.orderBy("file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in rows:
        assert r.case_id == "c1"
        got.setdefault(r.file, []).append(r.text)
        assert r.line_no == len(got[r.file])
    for name, data in files.items():
        text = data.decode("utf-8", errors="replace") if isinstance(data, bytes) else data
        if name != ".skip":
            assert got.get(name, []) == text.splitlines(), name
    assert ".skip" not in got


def test_many_cases_in_one_read(spark, tmp_path):
    for i in range(5):
        write_case(tmp_path, f"case-{i}", {"a.log": f"line of {i}\nsecond", "b.log": "x"}, ALERT)
    lines = CF.read_lines(spark, str(tmp_path))
    assert lines.groupBy("case_id").count().filter("count = 3").count() == 5
    inventory = SL.file_inventory(lines, SL.slice_places(lines))
    assert inventory.count() == 10


def test_alerts_have_a_closed_schema(spark, tmp_path):
    write_case(tmp_path, "good", {"a.log": "x"}, {**ALERT, "entities": [{"kind": "ip", "value": "10.1.2.3"}],
                                                   "raw_detector_fields": {"b": "2", "a": "1"}})
    write_case(tmp_path, "missing", {"a.log": "x"}, {k: v for k, v in ALERT.items() if k != "status"})
    write_case(tmp_path, "unknown", {"a.log": "x"}, {**ALERT, "verdict": "benign"})
    write_case(tmp_path, "typed", {"a.log": "x"}, {**ALERT, "severity": 3, "entities": [{"kind": "ip", "worth": 1}]})
    write_case(tmp_path, "broken", {"a.log": "x"}, "{not json")
    rows = {r.case_id: r for r in CF.read_alerts(spark, str(tmp_path)).collect()}
    assert rows["good"].problems == [] and rows["good"].status == "open"
    assert rows["good"].entities[0].value == "10.1.2.3" and rows["good"].raw_detector_fields == {"b": "2", "a": "1"}
    assert rows["missing"].problems == ["field status: Field required"] and rows["missing"].alert_id is None
    assert rows["unknown"].problems == ["field verdict: Extra inputs are not permitted"]
    assert rows["typed"].problems == [
        "field severity: expected STRING", "field entities.0.value: Field required",
        "field entities.0.worth: Extra inputs are not permitted",
    ]
    assert "not valid JSON" in rows["broken"].problems[0]


def test_case_audit_names_what_is_wrong(spark, tmp_path):
    write_case(tmp_path, "good", {"a.log": "x"}, ALERT)
    write_case(tmp_path, "no-alert", {"a.log": "x"})
    write_case(tmp_path, "no-logs", {}, ALERT)
    write_case(tmp_path, "odd", {"a b.log": "x", "_u.log": "y"}, ALERT)
    (tmp_path / "bare").mkdir()
    (tmp_path / "file").write_text("no folder")
    found = listing(spark, tmp_path)
    lines = CF.read_lines(spark, str(tmp_path)).filter("file <> '_u.log'")
    rows = {(r.case_id, r.problem) for r in CF.case_audit(found, CF.read_alerts(spark, str(tmp_path)), lines).collect()}
    assert rows == {
        ("no-alert", "has no alert.json"), ("no-logs", "logs contains no log files"), ("bare", "has no alert.json"),
        ("bare", "has no logs/ directory"), ("file", "is not a directory"),
        ("odd", "lines of this file cannot be cited: name outside the ref grammar"), ("odd", "listed but not read"),
    }
    complete = CF.read_lines(spark, str(tmp_path), found)
    rest = {r.problem for r in CF.case_audit(found, CF.read_alerts(spark, str(tmp_path)), complete).collect()}
    assert "listed but not read" not in rest


def test_many_small_files_share_tasks(spark):
    many = spark.range(30_000).selectExpr("concat('/x/', id) AS path", "3000L AS size", "0L AS block")
    assert CF._dealt(many, CF.PIECE_BYTES).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    large = spark.range(64).selectExpr("'/x' AS path", f"64L * {CF.PIECE_BYTES} AS size", f"id * {CF.PIECE_BYTES} AS block")
    assert CF._dealt(large, CF.PIECE_BYTES).rdd.getNumPartitions() == 64


def test_case_folder_below_a_uri_holds_names_with_blanks(spark, tmp_path, monkeypatch):
    from sweeplog.binding import files as binding

    monkeypatch.setattr(binding, "staging_path", lambda *_: f"file://{tmp_path}/cases")
    root = binding.case_folder(spark, "/root/testdata/sf0.001")
    found = CF.list_cases(CF.case_folders(spark, root)).filter("kind = 'log'")
    assert found.filter("contains(file, ' ')").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 50 = 0 AND text IS NOT NULL").count() > 0


def test_an_alert_is_parsed_once(spark):
    documents = spark.createDataFrame([("c", json.dumps(ALERT))], "case_id string, value string")
    plan = CF.parse_alerts(documents)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") <= 2
