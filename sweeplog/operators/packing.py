"""Greedy packing of lines into token-bounded windows, exact and without a whole file in one task.

A window opens at a line and takes lines until the next one would pass the budget. Which windows a block of lines
holds depends only on where the first window inside it opens, and that can only be one of the first few hundred lines,
because every line costs at least the ref overhead. So each block is reduced to a small table "opening offset here ->
opening offset in the next block". These tables are composed in groups of bounded size, the true opening offset of
every block is read off, and each block then cuts its own windows. A file of any length is spread over its blocks.

Costs are added in line order as doubles, and a cut is decided by that sum. Prefix sums find the cut; only when they
come within rounding distance of the budget is the window summed again line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.functions.lines import REF_OVERHEAD_TOKENS
from sweeplog.session import materialize

BLOCK_LINES = 65_536
# Blocks composed in one group, and how often: 256 ** 3 blocks of 65,536 lines bound the longest file.
FAN_IN = 256
LEVELS = 3
ROUNDING = 1e-3


def reach(max_budget: float) -> int:
    """Most lines one window can hold, plus the line that closes it."""
    return int(max_budget // REF_OVERHEAD_TOKENS) + 2


def next_openings(costs: np.ndarray, budget: float) -> np.ndarray:
    """For a window opened at each line, the index of the line that opens the next one (len(costs) when none)."""
    total = np.concatenate(([0.0], np.cumsum(costs)))
    n = len(costs)
    cut = np.searchsorted(total, total[:-1] + budget, side="right") - 1
    cut = np.maximum(cut, np.arange(1, n + 1))
    near = np.zeros(n, dtype=bool)
    for side in (cut, np.minimum(cut + 1, n)):
        near |= np.abs(total[side] - total[:-1] - budget) < ROUNDING
    for start in np.flatnonzero(near):
        running, line = costs[start], start + 1
        while line < n and not running + costs[line] > budget:
            running += costs[line]
            line += 1
        cut[start] = line
    return cut


def _exits(lengths: np.ndarray, own: int, budget: float, chars_per_token: float, width: int) -> np.ndarray:
    """Opening offset in the next block for each possible opening offset here."""
    jump = next_openings(lengths / chars_per_token + float(REF_OVERHEAD_TOKENS), budget)
    position = np.arange(min(width, own))
    while (inside := position < own).any():
        position[inside] = jump[position[inside]]
    return position - own


def _windows(lengths: np.ndarray, own: int, entry: int, budget: float, chars_per_token: float) -> list[int]:
    """Offsets at which windows open in this block."""
    jump = next_openings(lengths / chars_per_token + float(REF_OVERHEAD_TOKENS), budget)
    openings, at = [], entry
    while at < own:
        openings.append(at)
        at = int(jump[at])
    return openings


def _compose(rows: pd.DataFrame) -> np.ndarray:
    tables = [np.asarray(t) for t in rows.sort_values("block")["exits"]]
    out = tables[0]
    for table in tables[1:]:
        # Past the end only in the last block of a file, whose table is never followed.
        out = table[np.minimum(out, len(table) - 1)]
    return out


def _block_entries(tables: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """True opening offset of every block. `tables` has one row per block with its exits; each level covers FAN_IN times more."""
    types = {f.name: f.dataType.simpleString() for f in tables.schema.fields}
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        at, entries = int(rows["entry"].iloc[0]), []
        for table in rows["exits"]:
            entries.append(at)
            at = int(table[at]) if at < len(table) else 0
        out = rows[[*keys, "block"]].copy()
        out["entry"] = entries
        return out

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[keys].head(1).copy()
        out["block"] = int(rows["parent"].iloc[0])
        out["exits"] = [_compose(rows)]
        return out

    walked = f"{key_ddl}, block bigint, entry bigint"
    if levels == 1:
        return tables.withColumn("entry", F.lit(0).cast("bigint")).groupBy(*keys).applyInPandas(walk, walked)
    grouped = tables.withColumn("parent", F.floor(F.col("block") / FAN_IN).cast("bigint"))
    parents = grouped.groupBy(*keys, "parent").applyInPandas(compose, f"{key_ddl}, block bigint, exits array<bigint>")
    parent_entries = _block_entries(parents, keys, levels - 1).withColumnRenamed("block", "parent")
    return (
        grouped.join(parent_entries, [*keys, "parent"])
        .groupBy(*keys, "parent")
        .applyInPandas(walk, walked)
    )


def _cut(keys: list[str], chars_per_token: float, entered: bool):
    """Windows opening in each block; complete windows when the block is a whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            starts, ends, counts = [], [], []
            for i, (lengths, own, first, budget) in enumerate(
                zip(rows["lengths"], rows["own"], rows["first_line"], rows["budget"])
            ):
                entry = int(rows["entry"].iat[i]) if entered else 0
                opened = np.asarray(_windows(np.asarray(lengths, dtype=np.float64), own, entry, budget, chars_per_token))
                counts.append(len(opened))
                if len(opened):
                    opened = opened + first
                    starts.append(opened)
                    ends.append(np.append(opened[1:] - 1, first + own - 1))
            if not starts:
                continue
            taken = np.repeat(np.arange(len(rows)), counts)
            out = rows[[*keys, "block", "own"]].iloc[taken].reset_index(drop=True)
            out["n"] = np.asarray(counts, dtype=np.int64)[taken]
            out["start_line"] = np.concatenate(starts).astype(np.int64)
            out["end_line"] = np.concatenate(ends).astype(np.int64)
            out["ordinal"] = out.index.to_numpy() - np.concatenate(([0], np.cumsum(counts)[:-1]))[taken] + 1
            yield out

    return run


def _blocks(lines: DataFrame, keys: list[str], budget: float, chars_per_token: float, block_lines: int, halo: int,
            charge_header: bool) -> DataFrame:
    """One row per file and block: lengths of its lines plus the first lines of the next block, which close its last window.

    Only lengths are shuffled. The header is gathered in the same shuffle; only block 0 of a file holds it.
    """
    index = F.floor((F.col("line_no") - 1) / F.lit(block_lines)).cast("bigint")
    columns = [*keys, "line_no", F.length("text").alias("length"), index.alias("block")]
    aggregates = [F.array_sort(F.collect_list(F.struct("line_no", "length"))).alias("_lines")]
    if charge_header:
        columns.append(((F.col("line_no") <= L.MAX_HEADER_LINES) & ~L.is_header_line(F.col("text"))).alias("plain"))
        aggregates.append(F.min(F.when(F.col("plain"), F.col("line_no"))).alias("_plain"))
    placed = lines.select(*columns)
    offset = F.col("line_no") - 1 - F.col("block") * block_lines
    owners = F.when((F.col("block") > 0) & (offset < halo), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    grouped = placed.withColumn("block", F.explode(owners)).groupBy(*keys, "block").agg(*aggregates)
    left = F.lit(float(budget))
    if charge_header:
        # A file shorter than the header limit and made of header lines only has no plain line.
        stop = F.coalesce(F.col("_plain"), F.lit(L.MAX_HEADER_LINES + 1))
        head = F.filter(F.slice("_lines", 1, L.MAX_HEADER_LINES), lambda r: r["line_no"] < stop)
        chars = F.aggregate(head, F.lit(0), lambda n, r: n + r["length"])
        left = packing_budget(chars, budget, chars_per_token).cast("double")
    return grouped.select(
        *keys,
        "block",
        F.transform("_lines", lambda r: r["length"]).alias("lengths"),
        (F.col("block") * block_lines + 1).alias("first_line"),
        F.least(F.size("_lines"), F.lit(block_lines)).cast("bigint").alias("own"),
        ((F.col("block") > 0) | (F.size("_lines") > block_lines)).alias("spans"),
        left.alias("budget"),
    )


def packing_budget(header_chars: Column, budget: float, chars_per_token: float) -> Column:
    """What is left for lines after the header rides on every slice; never below 500."""
    left = (F.lit(float(budget)) - header_chars / F.lit(float(chars_per_token))).cast("bigint")
    return F.greatest(F.lit(L.MIN_PACKING_BUDGET).cast("bigint"), left)


def pack_windows(
    lines: DataFrame,
    keys: list[str],
    *,
    budget: float = L.DEFAULT_SLICE_TOKEN_BUDGET,
    chars_per_token: float = L.DEFAULT_CHARS_PER_TOKEN,
    block_lines: int = BLOCK_LINES,
    charge_header: bool = False,
) -> DataFrame:
    """Windows of every file: keys, window_index, start_line, end_line, window_count, line_count.

    `lines` needs keys, line_no (1-based, dense) and text. With `charge_header` the leading `#` lines of a file come
    out of its budget first.
    """
    halo = reach(max(budget, L.MIN_PACKING_BUDGET))
    block_lines = max(block_lines, 4 * halo)
    # Written once in the shared folder: several steps read the lengths, none of them scans text again.
    blocks = materialize(_blocks(lines, keys, budget, chars_per_token, block_lines, halo, charge_header), "line-lengths")
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    opened = f"{key_ddl}, block bigint, ordinal bigint, start_line bigint, end_line bigint, n bigint, own bigint"

    whole = blocks.filter(~F.col("spans")).mapInPandas(_cut(keys, chars_per_token, False), opened).select(
        *keys,
        F.col("ordinal").alias("window_index"),
        "start_line",
        "end_line",
        F.col("n").alias("window_count"),
        F.col("own").alias("line_count"),
    )
    if blocks.filter("spans").isEmpty():
        return whole
    return whole.unionByName(
        _pack_long_files(blocks.filter("spans"), keys, key_ddl, opened, chars_per_token, halo, charge_header)
    )


def _pack_long_files(blocks: DataFrame, keys: list[str], key_ddl: str, opened: str, chars_per_token: float, halo: int,
                     charge_header: bool) -> DataFrame:
    """Windows of files longer than one block. Every join is by file and block, so no file gathers in one task."""
    per_file = blocks.groupBy(*keys).agg(
        F.max("block").alias("_last"),
        F.max(F.col("first_line") + F.col("own") - 1).alias("line_count"),
        F.max(F.when(F.col("block") == 0, F.col("budget"))).alias("_budget"),
    )
    if charge_header:
        budgets = per_file.select(*keys, "_budget", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("block"))
        blocks = blocks.join(budgets, [*keys, "block"]).withColumn("budget", F.col("_budget")).drop("_budget")

    def reduce_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[[*keys, "block"]].copy()
            out["exits"] = [
                _exits(np.asarray(r.lengths, dtype=np.float64), int(r.own), float(r.budget), chars_per_token, halo)
                for r in rows.itertuples(index=False)
            ]
            yield out

    tables = blocks.mapInPandas(reduce_blocks, f"{key_ddl}, block bigint, exits array<bigint>")
    entered = blocks.join(_block_entries(tables, keys, LEVELS), [*keys, "block"])
    openings = entered.mapInPandas(_cut(keys, chars_per_token, True), opened)

    per_block = openings.groupBy(*keys, "block").agg(F.max("n").alias("n"), F.min("start_line").alias("first"))
    by_file = Window.partitionBy(*keys)
    earlier = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.join(per_file.select(*keys, "line_count"), keys).select(
        *keys,
        "block",
        "line_count",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.lead("first").over(by_file.orderBy("block")).alias("next_first"),
        F.sum("n").over(by_file).alias("window_count"),
    )
    last_here = F.col("ordinal") == F.col("n")
    return openings.join(offsets, [*keys, "block"]).select(
        *keys,
        (F.col("before") + F.col("ordinal")).alias("window_index"),
        "start_line",
        F.when(~last_here, F.col("end_line"))
        .otherwise(F.coalesce(F.col("next_first") - 1, F.col("line_count")))
        .alias("end_line"),
        "window_count",
        "line_count",
    )
