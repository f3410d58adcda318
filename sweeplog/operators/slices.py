"""Slices, file inventory, and the audits that prove total coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.operators.packing import BLOCK_LINES, pack_windows, packing_budget, reach
from sweeplog.session import join_small

KEYS = ["case_id", "file"]


def _top_lines() -> list[Column]:
    """Aggregates of a file: its first line that is no header, and its first lines, at most 12 of which reach the list."""
    top = F.col("line_no") <= L.MAX_HEADER_LINES
    plain = F.min(F.when(top & ~L.is_header_line(F.col("text")), F.col("line_no")))
    listed = F.array_sort(F.collect_list(F.when(top, F.struct("line_no", "text"))))
    return [plain.alias("_first"), listed.alias("_top")]


def _header() -> Column:
    """Leading `#` lines from the aggregates of `_top_lines`."""
    stop = F.coalesce(F.col("_first"), F.lit(L.MAX_HEADER_LINES + 1))
    return F.transform(F.filter("_top", lambda r: r["line_no"] < stop), lambda r: r["text"])


def format_headers(lines: DataFrame) -> DataFrame:
    """Leading `#` lines of each file, at most 12: (case_id, file, header_lines, format_header, header_chars)."""
    per_file = lines.filter(F.col("line_no") <= L.MAX_HEADER_LINES).groupBy(*KEYS).agg(*_top_lines())
    return (
        per_file.withColumn("format_header", _header())
        .filter(F.size("format_header") > 0)
        .select(
            *KEYS,
            F.size("format_header").cast("bigint").alias("header_lines"),
            "format_header",
            F.aggregate("format_header", F.lit(0), lambda n, t: n + F.length(t)).cast("bigint").alias("header_chars"),
        )
    )


def _stamps() -> list[Column]:
    """Aggregates of a file: line count, raw time range (text minimum and maximum) and typed range, from `raw` and `ts`."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("raw", "ts") for f, n in ((F.min, "min"), (F.max, "max"))]
    return [F.count("*").alias("line_count"), *ends]


def _stamped(lines: DataFrame, *columns: str) -> DataFrame:
    stamped = lines.select(*KEYS, *columns, L.first_timestamp(F.col("text")).alias("raw"))
    return stamped.withColumn("ts", L.typed_timestamp(F.col("raw")))


def _time_range() -> Column:
    return F.coalesce(F.concat("raw_min", F.lit("/"), "raw_max"), F.lit(L.NO_TIMESTAMPS))


def file_times(lines: DataFrame) -> DataFrame:
    """Line count, raw time range (text minimum and maximum) and typed range per file."""
    return _stamped(lines).groupBy(*KEYS).agg(*_stamps()).withColumn("time_range", _time_range())


def file_facts(lines: DataFrame) -> DataFrame:
    """line_count, time_range and format_header of each file, from one reading of its lines."""
    per_file = _stamped(lines, "line_no", "text").groupBy(*KEYS).agg(*_stamps(), *_top_lines())
    return per_file.select(*KEYS, "line_count", _time_range().alias("time_range"), _header().alias("format_header"))


def line_sizes(lines: DataFrame, chars_per_token: float = L.DEFAULT_CHARS_PER_TOKEN,
               budget: int = L.DEFAULT_SLICE_TOKEN_BUDGET) -> DataFrame:
    """Mean tokens per line (at least 1) and mean-based lines per slice (at least 10) per file."""
    chars = F.sum(F.length("text")) / F.count("*")
    return (
        lines.groupBy(*KEYS)
        .agg(F.greatest(F.lit(1.0), chars / F.lit(float(chars_per_token))).alias("tokens_per_line"))
        .withColumn(
            "lines_per_slice",
            F.greatest(
                F.lit(L.MIN_LINES_PER_SLICE).cast("bigint"),
                F.floor(F.lit(float(budget)) / (F.col("tokens_per_line") + L.REF_OVERHEAD_TOKENS)).cast("bigint"),
            ),
        )
    )


CHUNK_LINES = 4_000_000


def chunk(line: Column) -> Column:
    return F.floor((line - 1) / F.lit(CHUNK_LINES)).cast("bigint")


def per_chunk(per_file: DataFrame) -> DataFrame:
    """Repeat one-row-per-file data once per 4 million lines of the file (`line_count`), as column `_chunk`.

    Rows that carry a line position then join on file and chunk, and a file with a third of all lines does not
    gather in one task.
    """
    last = F.greatest(F.lit(0).cast("bigint"), chunk(F.col("line_count")))
    return per_file.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def slice_places(
    lines: DataFrame,
    files: DataFrame | None = None,
    *,
    budget: int = L.DEFAULT_SLICE_TOKEN_BUDGET,
    chars_per_token: float = L.DEFAULT_CHARS_PER_TOKEN,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Id, file, window numbers and line range of every slice; what joins need, without describing texts.

    `files` (case_id, file) adds files without lines as one empty slice (1, 0).
    """
    windows = pack_windows(
        lines, KEYS, budget=budget, chars_per_token=chars_per_token, block_lines=block_lines, charge_header=True
    )
    if files is not None:
        filled = lines.filter("line_no = 1").select(*KEYS)
        number = lambda n: F.lit(n).cast("bigint")
        empty = files.select(*KEYS).join(filled, KEYS, "left_anti").select(
            *KEYS, number(1).alias("window_index"), number(1).alias("start_line"), number(0).alias("end_line"),
            number(1).alias("window_count"), number(0).alias("line_count"),
        )
        windows = windows.unionByName(empty)
    return windows.withColumn("slice_id", slice_id(F.col("file"), F.col("window_index")))


def build_slices(lines: DataFrame, files: DataFrame | None = None, **sizing) -> DataFrame:
    """One row per slice with its reason, time range and format header."""
    return describe(slice_places(lines, files, **sizing), lines)


def describe(places: DataFrame, lines: DataFrame) -> DataFrame:
    per_file = file_facts(lines)
    windows = places.withColumn("_chunk", chunk(F.col("start_line")))
    return windows.join(per_chunk(per_file).drop("line_count"), [*KEYS, "_chunk"], "left").select(
        "case_id",
        "slice_id",
        "file",
        L.stem(F.col("file")).alias("source"),
        F.lit("").alias("host"),
        F.coalesce("time_range", F.lit(L.NO_TIMESTAMPS)).alias("time_range"),
        F.format_string(
            "systematic sweep, window %d of %d: lines %d-%d of %d in %s",
            "window_index", "window_count", "start_line", "end_line", "line_count", "file",
        ).alias("reason"),
        "start_line",
        "end_line",
        "window_index",
        "window_count",
        F.coalesce("format_header", F.array().cast("array<string>")).alias("format_header"),
    )


def slice_id(file: Column, window_index: Column) -> Column:
    """Full file name plus window number, so `a.log` and `a.json` never share an id."""
    return F.format_string("%s-%04d", file, window_index)


def in_order(slices: DataFrame) -> DataFrame:
    """Slices with `position`, from 1: their place in the case, files by name and slices by window.

    Files are ordered by a row each; slices are not sorted.
    """
    per_file = slices.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("case_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select(*KEYS, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = join_small(slices, before, KEYS, spread=["window_index"])
    return joined.withColumn("position", (F.col("_before") + F.col("window_index")).cast("bigint")).drop("_before")


def file_inventory(lines: DataFrame, slices: DataFrame) -> DataFrame:
    counted = slices.groupBy(*KEYS).agg(F.count("*").alias("slice_count"))
    return (
        counted.join(file_times(lines).select(*KEYS, "line_count", "time_range"), KEYS, "left")
        .select(
            *KEYS,
            F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
            F.coalesce("time_range", F.lit(L.NO_TIMESTAMPS)).alias("time_range"),
            "slice_count",
        )
    )


def locate(rows: DataFrame, slices: DataFrame, *, budget: int, columns: tuple[str, ...] = ("slice_id", "window_index")) -> DataFrame:
    """Attach the slice to rows with (case_id, file, line_no).

    An equi-join on line buckets as wide as the longest possible window: a slice touches at most two buckets,
    and a row meets only the slices of its own bucket. A file of any size spreads over its buckets.
    """
    width = reach(max(budget, L.MIN_PACKING_BUDGET))
    bucket = lambda c: F.floor((F.col(c) - 1) / F.lit(width)).cast("bigint")
    spread = slices.filter(F.col("end_line") >= F.col("start_line")).select(
        *KEYS, "start_line", "end_line", *columns,
        F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("_bucket"),
    )
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    return (
        rows.withColumn("_bucket", bucket("line_no"))
        .join(spread, [*KEYS, "_bucket"])
        .filter(inside)
        .drop("_bucket", "start_line", "end_line")
    )


def slice_lines(lines: DataFrame, slices: DataFrame, *, budget: int) -> DataFrame:
    """Ordered lines of every slice as one array. A slice holds at most budget/12 lines.

    Lines are dealt once, by parts of their file that are sixteen times as long as the longest slice, and put together where they
    meet their slices. Only slices that lie in two parts, about one in sixteen or fewer, move again.
    """
    width = 16 * reach(max(budget, L.MIN_PACKING_BUDGET))
    bucket = lambda c: F.floor((F.col(c) - 1) / F.lit(width)).cast("bigint")
    place = slices.filter(F.col("end_line") >= F.col("start_line")).select(
        *KEYS, "slice_id", "start_line", "end_line", (bucket("start_line") != bucket("end_line")).alias("_cut"),
        F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("_bucket"),
    )
    row = F.struct("line_no", L.line_ref(F.col("file"), F.col("line_no")).alias("ref"), "text")
    joined = lines.select(*KEYS, "line_no", "text", bucket("line_no").alias("_bucket")).join(place, [*KEYS, "_bucket"])
    inside = joined.filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    parts = inside.groupBy(*KEYS, "_bucket", "slice_id", "_cut").agg(F.array_sort(F.collect_list(row)).alias("lines"))
    ends = [F.element_at("lines", 1)["line_no"].alias("start_line"), F.element_at("lines", -1)["line_no"].alias("end_line")]
    whole = parts.filter("NOT _cut").select(*KEYS, "slice_id", "lines")
    joined = parts.filter("_cut").groupBy(*KEYS, "slice_id").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    return whole.unionByName(joined).select(*KEYS, "slice_id", *ends, "lines")


def coverage_audit(lines: DataFrame, slices: DataFrame) -> DataFrame:
    """Per file: lines, lines held by slices, and breaks in the chain of windows. Clean when breaks = 0 and both agree.

    Windows are checked by equi-join of each start with the end before it, so no file is sorted in one task.
    """
    counts = lines.groupBy(*KEYS).agg(
        F.count("*").alias("line_count"), F.max("line_no").cast("bigint").alias("last_line")
    )
    held = slices.filter(F.col("end_line") >= F.col("start_line"))
    ends = held.select(*KEYS, (F.col("end_line") + 1).alias("start_line"), F.lit(1).alias("_chained"))
    linked = held.join(ends, [*KEYS, "start_line"], "left")
    broken = F.col("_chained").isNull() & (F.col("start_line") != 1)
    sums = linked.groupBy(*KEYS).agg(
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines_in_slices"),
        F.count_if(broken).alias("breaks"),
        F.count_if(F.col("start_line") == 1).alias("firsts"),
        F.max("end_line").alias("last_in_slices"),
    )
    return counts.join(sums, KEYS, "full").select(
        *KEYS,
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("lines_in_slices", F.lit(0)).alias("lines_in_slices"),
        F.coalesce("breaks", F.lit(0)).alias("breaks"),
        (
            F.coalesce(F.col("line_count") == F.col("lines_in_slices"), F.lit(False))
            & (F.col("breaks") == 0) & (F.col("firsts") == 1) & (F.col("last_line") == F.col("last_in_slices"))
        ).alias("covered"),
    )


def budget_audit(lines: DataFrame, slices: DataFrame, *, budget: int,
                 chars_per_token: float = L.DEFAULT_CHARS_PER_TOKEN) -> DataFrame:
    """Characters and estimated tokens per slice with its header; over budget only when a single line is."""
    sized = locate(
        lines.select(*KEYS, "line_no", F.length("text").alias("chars")), slices, budget=budget, columns=("slice_id",)
    )
    per_slice = sized.groupBy(*KEYS, "slice_id").agg(
        F.count("*").alias("line_count"), F.sum("chars").cast("bigint").alias("chars"), F.min("line_no").alias("_start")
    )
    sizes = lines.groupBy(*KEYS).agg(F.count("*").alias("line_count"))
    headers = per_chunk(sizes.join(format_headers(lines).select(*KEYS, "header_chars"), KEYS)).drop("line_count")
    header_chars = F.coalesce("header_chars", F.lit(0))
    tokens = (F.col("chars") + header_chars) / F.lit(float(chars_per_token)) + F.col("line_count") * F.lit(
        float(L.REF_OVERHEAD_TOKENS)
    )
    # A header longer than the budget still leaves the packing minimum.
    allowed = F.greatest(
        F.lit(float(budget)),
        packing_budget(header_chars, budget, chars_per_token) + header_chars / F.lit(float(chars_per_token)),
    )
    return (
        per_slice.withColumn("_chunk", chunk(F.col("_start")))
        .join(headers, [*KEYS, "_chunk"], "left")
        .withColumn("estimated_tokens", tokens)
        .select(
            *KEYS, "slice_id", "line_count", "chars", "estimated_tokens",
            ((F.col("line_count") == 1) | (F.col("estimated_tokens") <= allowed + 1e-6)).alias("within_budget"),
        )
    )
