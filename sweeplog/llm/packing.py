"""Packing of documents into sequences of a fixed capacity by minimum bin slack.

A document longer than the capacity is cut into full pieces and a rest. What is left to place is a multiset of lengths, at most one
count per length up to the capacity, whatever the corpus. For each window the largest remaining length is put in, and a bitset
subset-sum over the remaining lengths (with their counts) finds the multiset that fills the rest closest to the capacity; walking
back through the bitsets gives how often each length is used. Such a fill is repeated as often as the counts allow, so the plan has
about as many fills as there are lengths. Pieces are numbered within their length in buckets of bounded size, and a piece's number
gives its sequence and offset in the plan. Only lengths and counts are gathered; a piece moves once.

Defined results: a null or empty text is a piece of the end id alone; a null id is packed like any other; rows that share an id are
separate documents; an empty table gives no rows. Lengths of 0 (documents without ids, if no end id is added) take no place and
give no piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import id_and_text
from sweeplog.llm.subwords import SubwordEncoder
from sweeplog.session import join_small, materialize

CAPACITY = 4096


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", bare: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for) of each piece: full pieces, then the rest.

    bare: the vocabulary drops white space and case, so that words can be encoded by themselves, in lower case.
    """
    rows = id_and_text(docs, id_col, text_col)
    encoder = SubwordEncoder(tokenizer, end_id, bare=bare)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            for first, ids, at in encoder.texts(block.column("text")):
                sizes = np.diff(at)
                count = -(-sizes // capacity)
                text = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(sizes[text] - start, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = at[text] + start
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = {
                    "doc_id": block.column("doc_id").take(pa.array(first + text)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(sizes[text], pa.int64()),
                }
                if with_ids:
                    # the pieces of a run lie one after the other
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(cut, kinds + (", ids array<int>" if with_ids else ""))


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within the counts, whose sum is the largest that is not over `room`."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        size = 1
        while left:  # counts by binary parts
            take = min(size, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_fills(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, length -> how many in a window) of each fill, in the order in which windows are numbered."""
    counts = {int(k): int(n) for k, n in histogram.items() if n > 0}
    fills = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        fill = closest_fill({k: n for k, n in counts.items() if n}, capacity - largest)
        counts[largest] += 1
        fill[largest] = fill.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        fills.append((times, fill))
        for k, n in fill.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return fills


class Places:
    """Where the piece with a given number among those of its length goes. Rows by length and first number."""

    def __init__(self, fills: list[tuple[int, dict[int, int]]]):
        rows, used, sequence = [], {}, 0
        for times, fill in fills:
            offset = 0
            for length in sorted(fill, reverse=True):
                each = fill[length]
                rows.append((length, used.get(length, 0), each, sequence, offset))
                used[length] = used.get(length, 0) + times * each
                offset += each * length
            sequence += times
        rows.sort()
        self.sequences = sequence
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.lengths, self.first, self.each, self.sequence, self.offset = table.T
        self.begin = np.searchsorted(self.lengths, np.arange((self.lengths.max() if len(rows) else 0) + 2))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length):
            a, b = self.begin[value], self.begin[value + 1]
            rows = np.flatnonzero(length == value)
            at = a + np.searchsorted(self.first[a:b], number[rows], side="right") - 1
            rest = number[rows] - self.first[at]
            sequence[rows] = self.sequence[at] + rest // self.each[at]
            offset[rows] = self.offset[at] + rest % self.each[at] * value
        return sequence, offset


def _numbered(pieces: DataFrame, by: list[str], most: int) -> DataFrame:
    """pieces with `number`, 0 and up within each length.

    A length is dealt over buckets by a hash, about the square root of the largest count each, so that neither a bucket nor a
    length's list of buckets is large where one length has most of the pieces.
    """
    size = max(256, math.isqrt(most))
    buckets = max(1, -(-most // size))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy(*by)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    joined = join_small(ranked, first, ["length", "_bucket"])
    return joined.withColumn("number", F.col("_first") + F.col("_rank")).drop("_bucket", "_first", "_rank")


def place_pieces(pieces: DataFrame, by: list[str], *, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored frame with a length up to the capacity) with sequence_id and offset. by: columns that tell pieces of a length apart;
    pieces alike in all of them are numbered in any order."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = Places(plan_fills(histogram, capacity))
    numbered = _numbered(pieces, by, max(histogram.values(), default=1))
    columns = [c for c in numbered.columns if c != "number"]

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", bare: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with their places; with_ids: also the ids themselves."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity=capacity, id_col=id_col, text_col=text_col, bare=bare, with_ids=with_ids), "pieces")
    return place_pieces(pieces, ["doc_id", "start", "ids_crc32"], capacity=capacity)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of places that are padding."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    totals = filled.agg(F.count(F.lit(1)).alias("sequences"), F.sum("filled").alias("tokens"))
    return totals.withColumn("padding_share", 1 - F.col("tokens") / (F.col("sequences") * capacity))
