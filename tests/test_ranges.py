"""Sessions and gaps over range partitions against pandas, with one key holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweeplog.operators import ranges, traffic

GAP_US = 20_000_000


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"source": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)), "domain": rng.choice(["x", "y"], n, p=[0.9, 0.1])})
    pdf["line_no"] = rng.permutation(n)
    pdf["us"] = 1_700_000_000_000_000 + rng.integers(0, 12_000, n) * 1_000_000  # many equal times
    return pdf


def frame(spark, data):
    rows = spark.createDataFrame(data)
    extra = spark.createDataFrame([("hot", "x", -1, None), ("hot", "x", -2, None), (None, "x", -3, 1_700_000_000_000_000), (None, "x", -4, 1_700_000_001_000_000)], rows.schema)
    return rows.union(extra).withColumn("ts", F.timestamp_micros("us")).drop("us")


def wanted(data):
    out = []
    for (source, domain), part in data.sort_values(["us", "line_no"]).groupby(["source", "domain"]):
        nulls = 2 if (source, domain) == ("hot", "x") else 0
        out += [(source, domain, k + 1, None, None, 1) for k in range(nulls)]
        number = nulls + (part["us"].diff().isna() | (part["us"].diff() > GAP_US)).cumsum()
        for no, piece in part.groupby(number):
            out.append((source, domain, int(no), int(piece["us"].iloc[0]), int(piece["us"].iloc[-1]), len(piece)))
    return out + [(None, "x", 1, 1_700_000_000_000_000, 1_700_000_001_000_000, 2)]


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (40, 10_000), (7, 13), (40, 1)])
def test_sessions_equal_pandas(spark, data, partitions, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = ranges.sessions(frame(spark, data), GAP_US, ["source", "domain"], ["ts", "line_no"], partitions)
        got = found.select("source", "domain", "session_no", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "events").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=str) == sorted(wanted(data), key=str)


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (40, 17)])
def test_regularity_equals_pandas(spark, data, partitions, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.source, r.domain): r for r in traffic.regularity(frame(spark, data), partitions=partitions).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, part in data.groupby(["source", "domain"]):
        gaps = part["us"].sort_values().diff().dropna() / 1e6
        assert got[key].gaps == len(gaps) and got[key].mean_s == pytest.approx(gaps.mean(), rel=1e-12)
        assert got[key].stddev_s == pytest.approx(gaps.std(ddof=0), rel=1e-9)
    assert got[(None, "x")].gaps == 1 and len(got) == len(data.groupby(["source", "domain"])) + 1


def test_no_events(spark, data):
    none = frame(spark, data).limit(0)
    assert traffic.sessions(none, 5.0).count() == 0 and traffic.regularity(none).count() == 0


def test_sessions_are_two_exchanges(spark, data):
    pieces = ranges.session_pieces(frame(spark, data), GAP_US, ["source", "domain"], ["ts", "line_no"])
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
