"""Fingerprints of documents by locally consistent parsing.

A text's bytes are grouped into phrases, phrases into phrases of phrases, and so on. Where a phrase begins is told by deterministic
coin tossing: a symbol is labelled by the lowest bit in which it differs from the symbol before it and that bit's value, which
makes labels few and leaves neighbours different; after four rounds six labels are left, then three, and phrases begin at the
highest labels and at those lowest ones that have no highest one beside them. Repeats of one symbol are first made one symbol. So a phrase has two or three (at a text's ends one to four)
symbols, its borders depend on a few symbols before and after it and not on where it stands, and equal substrings
are parsed alike but for a few phrases at either end on each level. A phrase's name is a hash of its symbols' names, so names
need no table and are the same in every task and on every run.

A fingerprint holds a name of the whole text and, for each of four levels (phrases of about 5, 13, 30 and 70 bytes), the `KEPT` smallest
hashes of the level's distinct phrases. The likeness of two fingerprints is the share of common phrases, estimated by the smallest
hashes of each level's union, all levels pooled; levels with few phrases weigh little. Equal texts have equal fingerprints and
likeness 1; a text without phrases on these levels has that of its name only.

Documents in order of their ids are next to each other in one range-partitioned pass. The first and the last document of a
partition are written aside, and a small second pass over these, two for each partition, joins the last of each partition to
the first of the next.

Defined results: a null or empty text is empty; rows are ordered by id, null ids first, then by a hash of the text, so repeated rows follow
one another and any order of them gives the same rows; an only row follows itself; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import id_and_text, id_type
from sweeplog.session import materialize

LEVELS = (2, 3, 4, 5)
KEPT = 16
# Text bytes parsed at a time, or one text where that is longer; parsing takes some 50 times as much memory.
BLOCK = 2 * 1024 * 1024

_U = np.uint64
# Names of single bytes, and what a symbol counts by its place in a phrase.
_BYTE_NAMES = tb.mixed(np.arange(1, 257, dtype=_U))
_PLACE = tb.mixed(np.arange(1001, 1009, dtype=_U)) | _U(1)


def _coin(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """2 l + b: l is the lowest bit in which the symbols differ, b its value in the second one."""
    apart = (before ^ symbol).astype(_U)
    low = apart & (~apart + _U(1))
    return (2 * np.bitwise_count(low - _U(1)) + ((symbol.astype(_U) & low) != 0)).astype(np.uint8)


def _table(size: int) -> np.ndarray:
    """The coins of all pairs of labels below `size` (a power of 2)."""
    a = np.arange(size, dtype=_U)
    return _coin(np.repeat(a, size), np.tile(a, size))


_BYTE_COINS, _COINS = _table(256), _table(128)


def _phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at each symbol. first: the places where texts begin; neighbours within a text differ."""
    n = len(symbols)
    if symbols.dtype == np.uint8:
        label = np.empty(n, np.uint8)
        label[1:] = _BYTE_COINS[symbols[:-1].astype(np.uint16) << 8 | symbols[1:]]
        label[first] = symbols[first] & 1
    else:
        label = np.empty(n, np.uint8)
        label[1:] = _coin(symbols[:-1], symbols[1:])
        label[first] = symbols[first] & _U(1)
    for _ in range(3):  # from at most 128 labels to 14, 8, 6
        new = np.empty(n, np.uint8)
        new[1:] = _COINS[label[:-1].astype(np.uint16) << 7 | label[1:]]
        new[first] = label[first] & 1
        label = new
    # 3, 4 and 5 become the least of 0, 1, 2 that no neighbour has; 7 stands beyond a text's ends
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = begins[n] = True
    for high in (3, 4, 5):
        place = np.flatnonzero(label == high)
        left = np.where(begins[place], 7, label[place - 1])
        right = np.where(begins[place + 1], 7, label[np.minimum(place + 1, n - 1)])
        label[place] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    left, right = np.full(n, 7, np.uint8), np.full(n, 7, np.uint8)
    left[1:] = np.where(begins[1:n], 7, label[:-1])
    right[:-1] = np.where(begins[1:n], 7, label[1:])
    highest = (label > left) & (label > right)
    lowest = (label < left) & (label < right)
    lowest[1:] &= ~highest[:-1] | begins[1:n]
    lowest[:-1] &= ~highest[1:] | begins[1:n]
    return highest | lowest | begins[:n]


def _once(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats made one: the places where runs start, their lengths, and which of them begin texts."""
    starts = np.ones(len(symbols), dtype=bool)
    starts[1:] = symbols[1:] != symbols[:-1]
    starts[first] = True
    place = np.flatnonzero(starts)
    return place, np.diff(np.append(place, len(symbols))), np.searchsorted(place, first)


def _named(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each phrase of names: the names in their order."""
    if not len(names):
        return names
    sizes = np.diff(np.append(starts, len(names)))
    within = np.arange(len(names)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        return tb.mixed(np.add.reduceat(names * _PLACE[within], starts) + sizes.astype(_U))


def levels(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1 to `depth` the names of the phrases of all texts, one after the other, and the n + 1 offsets."""
    symbols, at = data, offsets
    for _ in range(depth):
        full = at[1:] > at[:-1]
        place, length, first = _once(symbols, at[:-1][full])
        single = symbols[place]
        names = _BYTE_NAMES[single] if single.dtype == np.uint8 else single
        with np.errstate(over="ignore"):
            names = np.where(length > 1, tb.mixed(names + _U(0x5851F42D4C957F2D) * length.astype(_U)), names)
        starts = np.flatnonzero(_phrase_starts(single, first)) if len(single) else np.zeros(0, np.int64)
        symbols = _named(names, starts)
        inner = np.searchsorted(starts, first)
        counts = np.zeros(len(at), np.int64)
        counts[1:][full] = np.diff(np.append(inner, len(starts)))
        at = np.cumsum(counts)
        yield symbols, at


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Of each text: 8 bytes of its name, the number of hashes of each level, and the hashes (4 bytes, ascending by level)."""
    n = len(offsets) - 1
    kept = []
    for level, (names, at) in enumerate(levels(data, offsets, max(LEVELS)), 1):
        if level not in LEVELS:
            continue
        key = np.repeat(np.arange(n, dtype=_U), np.diff(at)) << _U(32) | tb.mixed(names) >> _U(32)
        key = np.unique(key)
        text = (key >> _U(32)).astype(np.int64)
        from_ = np.searchsorted(text, np.arange(n + 1))
        rank = np.arange(len(key)) - from_[text]
        key = key[rank < KEPT]
        kept.append(((key & _U(0xFFFFFFFF)).astype(">u4"), np.minimum(np.diff(from_), KEPT)))
    whole = _whole(names, at).astype(">u8").tobytes()
    counts = np.stack([c for _, c in kept], axis=1).astype(np.uint8)
    ends = [np.cumsum(c) for _, c in kept]
    flat = [v.tobytes() for v, _ in kept]
    out = []
    for i in range(n):
        parts = [whole[8 * i : 8 * i + 8], counts[i].tobytes()]
        for c, end, values in zip(counts[i].tolist(), ends, flat, strict=True):
            parts.append(values[4 * (int(end[i]) - c) : 4 * int(end[i])])
        out.append(b"".join(parts))
    return out


def _whole(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name of each text's names in their order."""
    place = np.arange(len(names)) - np.repeat(at[:-1], np.diff(at))
    out = np.diff(at).astype(_U)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        with np.errstate(over="ignore"):
            out[full] += np.add.reduceat(tb.mixed(names + tb.mixed(place.astype(_U) + _U(1))), at[full])
    return tb.mixed(out)


def likeness(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Between 0 and 1 for each pair of fingerprints; 1 for equal ones."""

    def keys(prints: list[bytes]) -> np.ndarray:
        depth = len(LEVELS)
        counts = np.frombuffer(b"".join(p[8 : 8 + depth] for p in prints), np.uint8).astype(np.int64)
        values = np.frombuffer(b"".join(p[8 + depth :] for p in prints), ">u4").astype(_U)
        return np.repeat(np.arange(len(counts), dtype=_U), counts) << _U(32) | values

    n = len(first)
    key, times = np.unique(np.concatenate([keys(first), keys(second)]), return_counts=True)
    group = (key >> _U(32)).astype(np.int64)
    starts = np.searchsorted(group, np.arange(n * len(LEVELS) + 1))
    used = np.arange(len(key)) - starts[group] < KEPT
    pair = group[used] // len(LEVELS)
    common, union = np.bincount(pair[times[used] == 2], minlength=n), np.bincount(pair, minlength=n)
    out = common / np.maximum(union, 1)
    out[[a == b for a, b in zip(first, second, strict=True)]] = 1.0
    return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, and the byte places where code points begin (with the end)."""
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.diff(np.searchsorted(place, offsets)), place


def edited(texts: list[bytes], after: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Each text with its last quarter (code points, rounded down) replaced by as many first ones of the text after it; code points."""

    def cut(values: list[bytes], sizes: np.ndarray) -> list[int]:
        """The byte place of code point `sizes` in each value, or its end."""
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        data = np.frombuffer(b"".join(values), np.uint8)
        counts, place = characters(data, offsets)
        return (place[np.searchsorted(place, offsets[:-1]) + np.minimum(sizes, counts)] - offsets[:-1]).tolist()

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in texts])]).astype(np.int64)
    counts, _ = characters(np.frombuffer(b"".join(texts), np.uint8), offsets)
    moved = counts // 4
    return [t[:i] + o[:j] for t, i, o, j in zip(texts, cut(texts, counts - moved), after, cut(after, moved), strict=True)], counts


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


_FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[bytes], after: list[bytes], chained: bool) -> list[pa.Array]:
    """The result's columns for texts and the texts after them; chained: the text after one is the next one of the list."""
    prints = fingerprints(*_joined(texts))
    following = prints[1:] + fingerprints(*_joined(after[-1:])) if chained else fingerprints(*_joined(after))
    changed, counts = edited(texts, after)
    others = fingerprints(*_joined(changed))
    return [
        pa.array(counts.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array(prints, pa.binary()),
        pa.array(others, pa.binary()), pa.array(likeness(prints, others)), pa.array(likeness(prints, following)),
    ]


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next: each document beside its
    edited form, whose last quarter is taken from the start of the next document, and beside the next document."""
    schema = f"doc_id {id_type(docs, id_col)}, {_RESULT}, slot long, edge int, text string"
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("order", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text")
    names = ["doc_id", *_FIELDS, "slot", "edge", "text"]

    def aside(row: pa.RecordBatch, slot: int, edge: int) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in _TYPES]
        return pa.RecordBatch.from_arrays([row.column("doc_id"), *none, pa.array([slot]), pa.array([edge], pa.int32()), row.column("text")], names)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None
        for block in tb.blocks(batches, "text", BLOCK):
            if not block.num_rows:
                continue
            block = block.select(["doc_id", "text"])
            if last is None:
                yield aside(block.slice(0, 1), slot, 0)
            else:
                block = pa.concat_batches([last, block])
            count = block.num_rows - 1
            last = block.slice(count, 1)
            if count:
                texts = block.column("text").cast(pa.binary()).to_pylist()
                none = [pa.nulls(count, t) for t in (pa.int64(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([block.column("doc_id").slice(0, count), *_compared(texts[:-1], texts[1:], True), *none], names)
        if last is not None:
            yield aside(last, slot, 1)

    found = materialize(rows.mapInArrow(made, schema), "fingerprints")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts, after = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text", "after"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_compared(texts, after, False)], ["doc_id", *_FIELDS])

    # the last of a partition beside the first of the next that has rows, and the last of all beside the first of all
    edges = found.where("edge IS NOT NULL").select("doc_id", "slot", "edge", "text")
    ring = sorted(r["slot"] for r in edges.where("edge = 0").select("slot").collect())  # a number for each partition
    following = dict(zip(ring, ring[1:] + ring[:1], strict=True))
    pairs = edges.sparkSession.createDataFrame(list(following.items()), "slot long, next long")
    first = edges.where("edge = 0").select(F.col("slot").alias("next"), F.col("text").alias("after"))
    ends = edges.where("edge = 1").join(F.broadcast(pairs), "slot").join(first, "next").select("doc_id", "text", "after")
    ends = ends.mapInArrow(joined, f"doc_id {id_type(docs, id_col)}, {_RESULT}")
    return found.where("edge IS NULL").select("doc_id", *_FIELDS).unionByName(ends)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (binary) of each document, where it lies."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK):
            data, offsets = tb.text_bytes(block.column("text"))
            counts, _ = characters(data, offsets)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(fingerprints(data, offsets), pa.binary())], ["doc_id", "n_chars", "fingerprint"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(made, f"doc_id {id_type(docs, id_col)}, n_chars long, fingerprint binary")
