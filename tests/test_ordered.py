"""Bucketed windows, exact ranks and salted joins against pandas, with one key holding most rows."""

from __future__ import annotations

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweeplog import session
from sweeplog.operators import ordered, quantiles


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)), "id": np.arange(n)})
    pdf["ts"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 900_000, n) // 10 * 10, unit="s")
    pdf["mark"] = np.where(rng.random(n) < 0.1, pdf["id"].astype(str), None)
    pdf["value"] = np.round(rng.exponential(30, n), 2)
    return pdf


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data).withColumn("mark", F.when(F.col("mark") != "NaN", F.col("mark")))


@pytest.mark.parametrize("width", [None, 60, 3600, 86_400])
def test_position_previous_total_latest(rows, data, width):
    bucketed = ordered.with_bucket(rows, ["key"], "ts", width)
    order = ["ts", "id"]
    df = ordered.with_position(bucketed, ["key"], order)
    df = ordered.with_previous(df, ["key"], order, ["id"])
    df = ordered.with_running_total(df, ["key"], order, F.col("id") % 7, "total")
    got = ordered.with_latest(df, ["key"], order, "mark", "latest").toPandas().sort_values(["key", "ts", "id"])
    want = data.sort_values(["key", "ts", "id"])
    group = want.groupby("key")
    assert (got["position"].values == group.cumcount().values + 1).all()
    assert got["previous_id"].fillna(-1).tolist() == group["id"].shift().fillna(-1).tolist()
    assert got["total"].tolist() == (want["id"] % 7).groupby(want["key"]).cumsum().tolist()
    assert got["latest"].fillna("").tolist() == group["mark"].ffill().fillna("").tolist()


def test_bucket_width_follows_the_largest_key(rows):
    assert ordered.bucket_width(rows, ["key"], "ts") == 30 * 86_400
    assert ordered.bucket_width(rows, ["key"], "ts", target_rows=300) == 86_400
    assert ordered.bucket_width(rows, ["key"], "ts", target_rows=40) == 3_600


def test_latency_spread_is_exact(rows, data):
    got = {r.key: r for r in quantiles.latency_spread(rows, ["key"], "value").collect()}
    for key, part in data.groupby("key"):
        values = sorted(part["value"])
        n = len(values)
        assert got[key]["count"] == n and got[key].median == statistics.median(values)
        assert got[key].p95 == values[min(n - 1, int(n * 0.95))] and got[key].max == values[-1]
        assert got[key].total == pytest.approx(sum(values), abs=1e-6)


def test_p95_at_twenty_values_is_the_last(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(1, 21)], "key string, v double")
    got = quantiles.latency_spread(df, ["key"], "v").first()
    assert (got.median, got.p95) == (10.5, 20.0)


def test_ranks_of_negative_and_equal_values(spark):
    values = [-5.0, -0.001, 0.0, 0.0, 0.0, 1e-9, 3.25, 3.25, 1e12]
    df = spark.createDataFrame([("k", v) for v in values], "key string, v double")
    ranks = {f"r{i}": F.lit(i) for i in range(len(values))}
    got = quantiles.at_ranks(df, ["key"], "v", ranks).first()
    assert [got[f"r{i}"] for i in range(len(values))] == values


def test_crowded_buckets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "VALUES", 20)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    rng = np.random.default_rng(5)
    near = [100.0 + float(x) for x in rng.random(3000) ** 6]  # within one hundredth, most of them far closer
    values = near + [7.0] * 500 + [-3.5, 0.0, 2e9] + [100.25] * 300
    df = spark.createDataFrame([("hot", v) for v in values] + [("b", v) for v in near[:41]] + [("hot", None)], "key string, v double")
    got = {r.key: r for r in quantiles.latency_spread(df, ["key"], "v").collect()}
    for key, own in (("hot", sorted(values)), ("b", sorted(near[:41]))):
        assert got[key]["count"] == len(own) and got[key].median == statistics.median(own)
        assert got[key].p95 == own[min(len(own) - 1, int(len(own) * 0.95))] and got[key].max == own[-1]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_equals_broadcast_join(rows, how):
    small = rows.sparkSession.createDataFrame([("hot", 1), ("a", 2)], "key string, x int")
    wide = session.join_small(rows, small, ["key"], how, spread=["id"], limit_bytes=0)
    narrow = session.join_small(rows, small, ["key"], how)
    assert wide.count() == narrow.count()
    assert wide.select(F.sum("id")).first() == narrow.select(F.sum("id")).first()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_small_side_is_not_broadcast_after_all(rows):
    small = rows.sparkSession.createDataFrame([("hot", 1), ("a", 2)], "key string, x int")
    assert "Broadcast" not in _plan(session.join_small(rows, small, ["key"], spread=["id"], limit_bytes=0))
    assert "Broadcast" not in _plan(session.join_small(rows, small, ["key"], limit_bytes=0))


def test_ranks_of_many_keys_are_not_broadcast(rows):
    assert "Broadcast" not in _plan(quantiles.latency_spread(rows, ["key"], "value"))
