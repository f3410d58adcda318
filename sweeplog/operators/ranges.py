"""Bursts and gaps of ordered events in one pass over range-partitioned rows.

Events are dealt by ranges of key and order and sorted in their partition, so a key of any size spreads over as many partitions as it
needs, whatever its times look like, and no width has to be found. Each partition is read once, batch by batch, and gives few
rows: its sessions, or a row of numbers for each key. What a partition's border cuts is put together afterwards from the border
rows, two for each partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sweeplog.session import materialize


def sorted_events(events: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """keys and `_at` (microseconds) of the events, dealt by ranges and sorted; `order` starts with the time column `ts`."""
    by = [*keys, *order]
    rows = events.select(*by)
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).select(*keys, F.unix_micros("ts").alias("_at"))


def _changed(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row's key differs from that of the row before; true for the first."""
    out = np.zeros(rows.num_rows, dtype=bool)
    out[0] = True
    for key in keys:
        code = pc.dictionary_encode(rows.column(key), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _steps(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Each batch behind the last row of the one before: rows, key changes, times, which times are there, and where its own rows start."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.concat_batches([last, batch])
        column = rows.column("_at")
        known = column.is_valid().to_numpy(zero_copy_only=False)
        at = column.fill_null(0).to_numpy(zero_copy_only=False)
        yield rows, _changed(rows, keys), at, known, 0 if last is None else 1
        last = rows.slice(rows.num_rows - 1, 1)


def _key_fields(events: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)


_SESSION = ["first_us", "last_us", "events", "no", "run_first", "slot", "edge"]


def session_pieces(events: DataFrame, gap_us: int, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Sessions as far as a partition sees them: keys, first_us, last_us, events, no (in the partition's part of the key), run_first
    (whether that is the first key of the partition), slot (the partition), edge (1 the partition's first, 2 its last, 3 both)."""
    rows = sorted_events(events, keys, order, partitions)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        held: tuple[pa.RecordBatch, list] | None = None  # key and values of the session that may go on
        runs, given = 0, False

        def made(key: pa.RecordBatch, values: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
            first, last, known, events, no, first_run = values
            mask = ~known
            columns = [pa.array(first, mask=mask), pa.array(last, mask=mask), pa.array(events), pa.array(no), pa.array(first_run), pa.array(np.full(len(no), slot)), pa.array(edge, pa.int32())]
            return pa.RecordBatch.from_arrays([*[key.column(k) for k in keys], *columns], [*keys, *_SESSION])

        for rows, changed, at, known, own in _steps(batches, keys):
            n = rows.num_rows
            opens = changed.copy()
            opens[1:] |= ~known[1:] | ~known[:-1] | (at[1:] - at[:-1] > gap_us)
            starts = np.flatnonzero(opens[own:]) + own
            until = starts[0] if len(starts) else n
            if held is not None:
                values = held[1]
                if until > own:
                    values[1], values[3] = at[until - 1 : until], values[3] + (until - own)
                if not len(starts):
                    continue
                yield made(held[0], values, np.array([0 if given else 1]))
                given = True
            new_key, index = changed[starts], np.arange(len(starts))
            base = np.maximum.accumulate(np.where(new_key, index, -1))
            before = held[1][4][0] if held is not None else 0
            number = np.where(base >= 0, index - base + 1, before + index + 1)
            run = runs + np.cumsum(new_key)
            runs = int(run[-1])
            ends = np.append(starts[1:], n)
            values = [at[starts], at[ends - 1], known[starts], ends - starts, number, run == 1]
            whole = rows.take(pa.array(starts))
            if len(starts) > 1:
                edge = np.zeros(len(starts) - 1, np.int32)
                edge[0] = 0 if given else 1
                yield made(whole.slice(0, len(starts) - 1), [v[:-1] for v in values], edge)
                given = True
            held = whole.slice(len(starts) - 1, 1), [v[-1:] for v in values]
        if held is not None:
            yield made(*held, np.array([2 if given else 3]))

    schema = f"{_key_fields(events, keys)}, first_us bigint, last_us bigint, events bigint, no bigint, run_first boolean, slot bigint, edge int"
    return rows.mapInArrow(found, schema)


def sessions(events: DataFrame, gap_us: int, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """keys, session_no, first_ts, last_ts, events: a pause of more than `gap_us` opens a key's next session.

    Events without a time come first, each a session of its own. The driver gets the two border sessions of each partition.
    """
    pieces = materialize(session_pieces(events, gap_us, keys, order, partitions), "sessions")
    by_slot: dict[int, list] = {}
    for row in pieces.where("edge > 0").collect():
        by_slot.setdefault(row["slot"], []).append(row.asDict())
    whole, carried = joined_at_borders([sorted(rows, key=lambda r: r["edge"]) for _, rows in sorted(by_slot.items())], gap_us, keys)
    spark = events.sparkSession
    carry = spark.createDataFrame(list(carried.items()), "slot bigint, _carry bigint")
    inner = pieces.where("edge = 0").join(F.broadcast(carry), "slot", "left")
    number = F.col("no") + F.when(F.col("run_first"), F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    columns = [*keys, "session_no", "first_us", "last_us", "events"]
    inner = inner.withColumn("session_no", number.cast("bigint")).select(*columns)
    schema = StructType([inner.schema[c] for c in columns])
    border = spark.createDataFrame([tuple(r[k] for k in keys) + (r["no"], r["first_us"], r["last_us"], r["events"]) for r in whole], schema)
    return inner.unionByName(border).select(
        *keys, "session_no", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "events"
    )


def joined_at_borders(slots: list[list[dict]], gap_us: int, keys: list[str]) -> tuple[list[dict], dict[int, int]]:
    """The border sessions with what lies on both sides of a border made one, numbered in their key; and for each partition how many
    sessions its first key has before it."""
    whole, carried, held = [], {}, None
    for rows in slots:
        first, last = rows[0], rows[-1]
        same = held is not None and all(held[k] == first[k] for k in keys)
        goes_on = same and held["last_us"] is not None and first["first_us"] is not None and first["first_us"] - held["last_us"] <= gap_us
        carry = held["no"] - goes_on if same else 0
        carried[first["slot"]] = carry
        if goes_on:
            held |= {"last_us": first["last_us"], "events": held["events"] + first["events"]}
        else:
            whole += [held] if held is not None else []
            held = first | {"no": first["no"] + carry}
        if last is not first:
            whole.append(held)
            held = last | {"no": last["no"] + (carry if last["run_first"] else 0)}
    return whole + ([held] if held is not None else []), carried


def gap_moments(events: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """keys, gaps, mean_us, square_us: number, mean and sum of squared differences from the mean of the gaps between a key's events."""
    rows = sorted_events(events.where("ts IS NOT NULL"), keys, order, partitions)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        held: tuple[pa.RecordBatch, list[np.ndarray]] | None = None

        def made(key: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array(v) for v in (*values, np.full(len(values[0]), slot))]
            return pa.RecordBatch.from_arrays([*[key.column(k) for k in keys], *columns], [*keys, "first_us", "last_us", "gaps", "mean_us", "square_us", "slot"])

        for rows, changed, at, _, own in _steps(batches, keys):
            if own:
                changed[0] = False  # the row before stands for the key that goes on
            starts = np.flatnonzero(changed)
            starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
            ends = np.append(starts[1:], len(at))
            inner = np.ones(len(at), dtype=bool)
            inner[starts] = False
            gap = np.append(0.0, np.diff(at)) * inner
            count = ends - starts - 1
            total = np.add.reduceat(gap, starts)
            mean = total / np.maximum(count, 1)
            apart = (gap - np.repeat(mean, ends - starts)) * inner
            values = [at[starts], at[ends - 1], count, mean, np.add.reduceat(apart * apart, starts)]
            whole = rows.take(pa.array(starts))
            if own:  # put together with what the key has so far
                first, _, n, m, q = (v[0] for v in held[1])
                k, mu, r = values[2][0], values[3][0], values[4][0]
                both = n + k
                values[0][0], values[2][0] = first, both
                values[3][0] = (n * m + k * mu) / max(both, 1)
                values[4][0] = q + r + (m - mu) ** 2 * n * k / max(both, 1)
            if len(starts) > 1:
                yield made(whole.slice(0, len(starts) - 1), [v[:-1] for v in values])
            held = whole.slice(len(starts) - 1, 1), [v[-1:].copy() for v in values]
        if held is not None:
            yield made(*held)

    schema = f"{_key_fields(events, keys)}, first_us bigint, last_us bigint, gaps bigint, mean_us double, square_us double, slot bigint"
    parts = materialize(rows.mapInArrow(found, schema), "gap-parts")
    # a key has a row for each partition that it reaches into; between two of them lies one more gap
    before = F.lag("last_us").over(Window.partitionBy(*keys).orderBy("slot"))
    border = parts.select(*keys, (F.col("first_us") - before).cast("double").alias("mean_us")).where("mean_us IS NOT NULL")
    zero = F.lit(0.0).alias("square_us")
    pieces = parts.where("gaps > 0").select(*keys, "gaps", "mean_us", "square_us").unionByName(border.select(*keys, F.lit(1).cast("bigint").alias("gaps"), "mean_us", zero))
    ends = parts.groupBy(*keys).agg(F.max("last_us").alias("_to"), F.min("first_us").alias("_from"))
    n, m, q = F.sum("gaps"), F.sum(F.col("gaps") * F.col("mean_us")), F.sum("square_us")
    grouped = pieces.groupBy(*keys).agg(
        n.alias("gaps"), (m / n).alias("_mean"), q.alias("_square"), F.collect_list(F.struct("gaps", "mean_us")).alias("_parts")
    )
    spread = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["gaps"] * (p["mean_us"] - F.col("_mean")) * (p["mean_us"] - F.col("_mean")))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_from", "_to")
    return grouped.join(ends, same).select(
        *keys, "gaps", ((F.col("_to") - F.col("_from")) / F.col("gaps")).alias("mean_us"), (F.col("_square") + spread).alias("square_us")
    )
