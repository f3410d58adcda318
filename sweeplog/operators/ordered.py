"""Position, previous row and running totals inside a key, without sorting a whole key in one task.

A plain window over a key puts all its rows in one task, which fails when one key holds a third of the data.
Here the key is cut into time buckets. Each bucket is ordered on its own, and what a bucket needs from the ones
before it (a count, a total, its last row) is taken from a pre-aggregated table with one row per key and bucket.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.session import materialize

TARGET_ROWS = 1_000_000
# Candidate bucket widths in seconds, widest first.
WIDTHS = (30 * 86_400, 86_400, 3_600, 60, 1)


def _bucket(seconds: Column, width: int) -> Column:
    return F.floor(seconds / F.lit(width)).cast("bigint")


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def bucket_width(df: DataFrame, keys: list[str], ts: str, target_rows: int = TARGET_ROWS) -> int:
    """Widest bucket that keeps every (key, bucket) below `target_rows`.

    One aggregate pass per width tried, with map-side combining; the driver receives one number each. Keys below the
    target need no bucket at all, which the first pass tells.
    """
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= target_rows:
        return WIDTHS[0]
    for width in WIDTHS[1:-1]:
        counts = df.groupBy(*keys, _bucket(_seconds(ts), width).alias("_b")).agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= target_rows:
            return width
    return WIDTHS[-1]


def with_bucket(df: DataFrame, keys: list[str], ts: str, width: int | None = None, *, stored: bool = False) -> DataFrame:
    """Rows with their time bucket, as a written table: the steps below read it several times, its source once.

    `stored` says that the rows come straight from a table, which is then not copied.
    """
    rows = df if stored else materialize(df, "ordered-rows")
    return rows.withColumn("_bucket", _bucket(_seconds(ts), width or bucket_width(rows, keys, ts)))


def _with_edges(df: DataFrame, keys: list[str], aggregates: list[Column], derived: dict[str, Column]) -> DataFrame:
    """Attach to each row what its bucket inherits from the earlier buckets of the key.

    Rows with a null key or time stay: nulls are a key and the first bucket of their own. There is an edge for each key and bucket, which
    grows with the keys, so edges are merged, not broadcast.
    """
    edges = df.groupBy(*keys, "_bucket").agg(*aggregates)
    for name, column in derived.items():
        edges = edges.withColumn(name, column)
    by = [*keys, "_bucket"]
    named = edges.select(*[F.col(k).alias(f"_edge_{i}") for i, k in enumerate(by)], *derived)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_edge_{i}")) for i, k in enumerate(by)])
    return df.join(named.hint("merge"), same).drop(*[f"_edge_{i}" for i in range(len(by))])


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based position in the key. `df` carries `_bucket`; `order` starts with the bucketed time."""
    joined = _with_edges(
        df, keys, [F.count("*").alias("_n")],
        {"_before": F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0))},
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.withColumn(name, F.row_number().over(local) + F.col("_before")).drop("_before")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add `previous_<column>` from the row before in the key, null on the first row."""
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    joined = _with_edges(
        df, keys, [F.max_by(row, F.struct(*order)).alias("_last")],
        {"_carried": F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))},
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = joined.withColumn("_previous", F.coalesce(F.lag(row).over(local), F.col("_carried")))
    for c in columns:
        joined = joined.withColumn(f"previous_{c}", F.col(f"_previous.{c}"))
    return joined.drop("_carried", "_previous")


def with_running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of an integer expression in the key."""
    valued = df.withColumn("_value", value.cast("bigint"))
    joined = _with_edges(
        valued, keys, [F.sum("_value").alias("_total")],
        {"_before": F.coalesce(F.sum("_total").over(_earlier(keys)), F.lit(0))},
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.sum("_value").over(local) + F.col("_before")).drop("_value", "_before")


def with_latest(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Most recent non-null value of `column` at or before each row of the key."""
    joined = _with_edges(
        df, keys, [F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last")],
        {"_carried": F.last("_last", ignorenulls=True).over(_earlier(keys))},
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(local), F.col("_carried"))).drop("_carried")
