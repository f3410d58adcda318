"""A small DNS case with five planted bursts and look-alike traffic, written by the test."""

from __future__ import annotations

import random

import pytest

from sweeplog.operators import traffic as T
from sweeplog.sources import typed

BURSTS = (96, 210, 64, 288, 130)


@pytest.fixture(scope="module")
def dns(spark):
    rng = random.Random(11)
    names = [n for n, _ in typed.DNS_COLUMNS]
    rows = []

    def query(ts, src, name, qtype, rcode, answers):
        cells = dict.fromkeys(names, "-") | {"ts": f"{ts:.6f}", "id.orig_h": src, "query": name, "qtype_name": qtype,
                                             "rcode_name": rcode, "answers": answers, "AA": "F", "rejected": "T"}
        rows.append((ts, cells))

    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for i, count in enumerate(BURSTS):
        ts = 1_786_700_000.0 + i * 2400
        for _ in range(count):
            ts += rng.choice([0.2, 0.4, 3.0])
            query(ts, "10.1.1.56", f"{hexed(rng.choice([28, 40]))}.t.bad-sync.net", "TXT" if rng.random() < 0.82 else "CNAME",
                  "NOERROR", hexed(64) + "," + hexed(20))
    for i in range(300):
        query(1_786_700_000.0 + i * 30, "10.1.1.9", f"{i % 250}.2.3.4.zen.list.example.org", "A", "NXDOMAIN", "-")
        query(1_786_700_000.5 + i * 30, f"10.1.1.{i % 9 + 10}", f"{hexed(40)}.avts.example.net", "TXT", "NOERROR", "v=1")
    rows.sort(key=lambda r: r[0])
    text = ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tdns", "#open\tx",
            "#fields\t" + "\t".join(names), "#types\t" + "\t".join(t for _, t in typed.DNS_COLUMNS)]
    text += ["\t".join(cells.values()) for _, cells in rows] + ["cut\tshort"]
    lines = spark.createDataFrame([("c", "dns.log", i, t) for i, t in enumerate(text, 1)],
                                  "case_id string, file string, line_no bigint, text string")
    return typed.tab_separated(lines)


def test_header_gives_types(dns):
    row = dns.filter("query LIKE '%.bad-sync.net'").first()
    assert row.rejected is True and row.AA is False and row.uid is None and len(row.answers) == 2
    assert dns.filter("malformed").count() == 1


def test_five_bursts_with_all_planted_queries(dns):
    flows = T.flows(dns.filter("NOT malformed"))
    got = T.sessions(flows, 600.0, partitions=13).filter("domain = 'bad-sync.net'").orderBy("session_no").collect()
    assert [r.events for r in got] == list(BURSTS) and sum(r.events for r in got) == 788


def test_profile_tells_the_burst_from_its_look_alikes(dns):
    flows = T.flows(dns.filter("NOT malformed"))
    share = {(r.source, r.domain): r for r in T.type_share(flows).collect()}
    planted, listed = share[("10.1.1.56", "bad-sync.net")], share[("10.1.1.9", "example.org")]
    assert 0.75 < planted.txt_share < 0.9 and planted.noerror_share == 1.0
    assert listed.txt_share == 0.0 and listed.noerror_share == 0.0
    payload = {(r.source, r.qtype_name): r.mean_payload for r in T.profile(flows).collect()}
    assert payload[("10.1.1.56", "TXT")] == 85.0 and payload[("10.1.1.9", "A")] == 0.0


def test_steady_gaps_have_little_variation(dns):
    got = {r.source: r.variation for r in T.regularity(T.flows(dns.filter("NOT malformed")), partitions=13).collect()}
    assert got["10.1.1.9"] < 1e-6 and got["10.1.1.56"] > 5


def test_leases_and_attribution(spark):
    text = ["2026-08-14 07:44:57 ACK 10.1.1.56 02:9c:31:5e:08:d1 wks-1 lease=3600", "noise",
            "2026-08-14 09:00:00 RENEW 10.1.1.56 02:9c:31:5e:08:d2 wks-2 lease=28800"]
    lines = spark.createDataFrame([("c", "d.log", i, t) for i, t in enumerate(text, 1)],
                                  "case_id string, file string, line_no bigint, text string")
    held = typed.leases(lines)
    assert held.count() == 2
    rows = spark.sql(
        "SELECT id, '10.1.1.56' AS ip, to_timestamp(t) AS ts FROM VALUES (1, '2026-08-14 07:00:00'), (2, '2026-08-14 08:00:00'), "
        "(3, '2026-08-14 08:50:00'), (4, '2026-08-14 09:00:00'), (5, '2026-08-14 16:00:00') AS v(id, t)")
    for width in (60, 86_400):
        got = {r.id: r.host for r in T.attribute_hosts(rows, held, width).collect()}
        assert got == {1: None, 2: "wks-1", 3: None, 4: "wks-2", 5: "wks-2"}
