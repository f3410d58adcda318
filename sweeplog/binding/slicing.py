"""Lines, headers, timestamps, packing, slices, inventory and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplog.binding import sql as S
from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.functions import lines as L
from sweeplog.operators import slices as SL
from sweeplog.plans import jobs

DOC_BUDGET = 500
EVENT_BUDGET = 900



def raw_stamp(column: str) -> str:
    parts = ", ".join(f"nullif(regexp_extract({column}, '{p}'), '')" for p in (L.ISO_TS, L.SYSLOG_TS, L.EPOCH_TS))
    return f"coalesce({parts})"


FILE_TIMES = f"""
file_times AS (
  SELECT case_id, file, count(*) AS line_count, min(raw) AS raw_min, max(raw) AS raw_max,
         coalesce(min(raw) || '/' || max(raw), 'unknown (no timestamps recognised)') AS time_range
  FROM (SELECT case_id, file, {raw_stamp('text')} AS raw FROM event_lines) GROUP BY ALL
)"""


@register("line_refs", f"""WITH {S.DOC_LINES}
SELECT case_id, file, line_no, file || ':L' || line_no AS ref, length(text) AS chars FROM doc_lines""")
def line_refs(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir)
    return lines.select(
        "case_id", "file", "line_no", L.line_ref(F.col("file"), F.col("line_no")).alias("ref"),
        F.length("text").cast("bigint").alias("chars"),
    )


@register("event_log_lines", f"WITH {S.EVENT_LINES} SELECT case_id, file, line_no, text FROM event_lines")
def event_log_lines(spark, sf_dir):
    return V.event_lines(spark, sf_dir)


@register("format_header", f"""WITH {S.EVENT_LINES},
h AS (SELECT case_id, file, text, line_no,
             coalesce(min(CASE WHEN NOT starts_with(text, '#') THEN line_no END) OVER (PARTITION BY case_id, file), 13) AS stop
      FROM event_lines WHERE line_no <= 12)
SELECT case_id, file, count(*) AS header_lines, string_agg(text, '|' ORDER BY line_no) AS header,
       CAST(sum(length(text)) AS BIGINT) AS header_chars
FROM h WHERE line_no < stop GROUP BY ALL""")
def format_header(spark, sf_dir):
    headers = SL.format_headers(V.event_lines(spark, sf_dir))
    return headers.select("case_id", "file", "header_lines", F.array_join("format_header", "|").alias("header"), "header_chars")


@register("line_timestamps", f"""WITH {S.EVENT_LINES}
SELECT case_id, file, line_no, {raw_stamp('text')} AS raw_ts,
       epoch_us(CAST(replace({raw_stamp('text')}, 'Z', '') AS TIMESTAMP)) AS ts_micros FROM event_lines""")
def line_timestamps(spark, sf_dir):
    raw = L.first_timestamp(F.col("text"))
    return V.event_lines(spark, sf_dir).select("case_id", "file", "line_no", raw.alias("raw_ts")).withColumn(
        "ts_micros", F.unix_micros(L.typed_timestamp(F.col("raw_ts")))
    )


@register("file_time_range", f"""WITH {S.EVENT_LINES}, {FILE_TIMES}
SELECT case_id, file, line_count, raw_min, raw_max, time_range FROM file_times""")
def file_time_range(spark, sf_dir):
    return SL.file_times(V.event_lines(spark, sf_dir)).select(
        "case_id", "file", "line_count", "raw_min", "raw_max", "time_range"
    )


@register("line_cost", f"""WITH {S.DOC_LINES}
SELECT case_id, file, line_no, length(text) / 1.4::DOUBLE + 12::DOUBLE AS tokens FROM doc_lines""")
def line_cost(spark, sf_dir):
    return V.doc_lines(spark, sf_dir).select(
        "case_id", "file", "line_no", L.token_cost(F.length("text")).alias("tokens")
    )


@register("token_density", f"""WITH {S.DOC_LINES},
d AS (SELECT case_id, file, greatest(1.0::DOUBLE, CAST(sum(length(text)) AS DOUBLE) / count(*) / 1.4::DOUBLE) AS tokens_per_line
      FROM doc_lines GROUP BY ALL)
SELECT case_id, file, tokens_per_line,
       greatest(10, CAST(floor(10000::DOUBLE / (tokens_per_line + 12)) AS BIGINT)) AS lines_per_slice FROM d""")
def token_density(spark, sf_dir):
    return SL.line_sizes(V.doc_lines(spark, sf_dir))


@register("pack_windows_docs", f"""WITH RECURSIVE {S.DOC_LINES}, {S.packed('doc_lines', DOC_BUDGET, False)}
SELECT * FROM windows""")
def pack_windows_docs(spark, sf_dir):
    return SL.pack_windows(V.doc_lines(spark, sf_dir), SL.KEYS, budget=DOC_BUDGET)


@register("pack_windows_events", f"""WITH RECURSIVE {S.EVENT_LINES}, {S.packed('event_lines', EVENT_BUDGET, True)}
SELECT * FROM windows""")
def pack_windows_events(spark, sf_dir):
    return SL.pack_windows(V.event_lines(spark, sf_dir), SL.KEYS, budget=EVENT_BUDGET, charge_header=True)


@register("slices", f"""WITH RECURSIVE {S.EVENT_LINES}, {S.packed('event_lines', EVENT_BUDGET, True)}, {FILE_TIMES}
SELECT case_id, printf('%s-%04d', file, window_index) AS slice_id, file, regexp_replace(file, '\\.[^.]*$', '') AS source,
       '' AS host, time_range,
       printf('systematic sweep, window %d of %d: lines %d-%d of %d in %s', window_index, window_count, start_line, end_line,
              windows.line_count, file) AS reason,
       start_line, end_line, window_index, window_count,
       CASE WHEN CAST(replace(replace(file, 'user-', ''), '.log', '') AS BIGINT) % 3 = 0 THEN 2 ELSE 0 END AS header_lines
FROM windows JOIN file_times USING (case_id, file)""")
def slices(spark, sf_dir):
    built = SL.build_slices(V.event_lines(spark, sf_dir), budget=EVENT_BUDGET)
    return built.withColumn("header_lines", F.size("format_header")).drop("format_header")


@register("slice_order", f"""WITH RECURSIVE {S.DOC_LINES}, {S.packed('doc_lines', DOC_BUDGET, False)}
SELECT case_id, printf('%s-%04d', file, window_index) AS slice_id, row_number() OVER (PARTITION BY case_id ORDER BY file, window_index) AS position FROM windows""")
def slice_order(spark, sf_dir):
    return SL.in_order(V.doc_slices(spark, sf_dir, DOC_BUDGET)).select("case_id", "slice_id", "position")


@register("file_inventory", f"""WITH RECURSIVE {S.EVENT_LINES}, {S.packed('event_lines', EVENT_BUDGET, True)}, {FILE_TIMES}
SELECT case_id, file, t.line_count, time_range, w.slice_count
FROM file_times t JOIN (SELECT case_id, file, count(*) AS slice_count FROM windows GROUP BY ALL) w USING (case_id, file)""")
def file_inventory(spark, sf_dir):
    lines = V.event_lines(spark, sf_dir)
    return SL.file_inventory(lines, SL.slice_places(lines, budget=EVENT_BUDGET))


@register("slice_contents", f"""WITH RECURSIVE {S.DOC_LINES}, {S.packed('doc_lines', DOC_BUDGET, False)}
SELECT case_id, file, printf('%s-%04d', file, window_index) AS slice_id, start_line, end_line, count(*) AS line_count,
       string_agg(file || ':L' || line_no || chr(9) || text, chr(10) ORDER BY line_no) AS body
FROM windows JOIN doc_lines USING (case_id, file) WHERE line_no BETWEEN start_line AND end_line GROUP BY ALL""")
def slice_contents(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    contents = SL.slice_lines(lines, SL.slice_places(lines, budget=DOC_BUDGET), budget=DOC_BUDGET)
    body = F.array_join(F.transform("lines", lambda r: F.concat(r["ref"], F.lit("\t"), r["text"])), "\n")
    return contents.select(
        "case_id", "file", "slice_id", "start_line", "end_line",
        F.size("lines").cast("bigint").alias("line_count"), body.alias("body"),
    )


@register("coverage_audit", f"""WITH {S.DOC_LINES}
SELECT case_id, file, count(*) AS line_count, count(*) AS lines_in_slices, CAST(0 AS BIGINT) AS breaks, true AS covered
FROM doc_lines GROUP BY ALL""")
def coverage_audit(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    return SL.coverage_audit(lines, SL.slice_places(lines, budget=DOC_BUDGET))


@register("budget_audit", f"""WITH RECURSIVE {S.DOC_LINES}, {S.packed('doc_lines', DOC_BUDGET, False)},
s AS (SELECT case_id, file, printf('%s-%04d', file, window_index) AS slice_id, count(*) AS line_count, CAST(sum(length(text)) AS BIGINT) AS chars
      FROM windows JOIN doc_lines USING (case_id, file) WHERE line_no BETWEEN start_line AND end_line GROUP BY ALL)
SELECT *, chars / 1.4::DOUBLE + line_count * 12::DOUBLE AS estimated_tokens,
       (line_count = 1 OR chars / 1.4::DOUBLE + line_count * 12::DOUBLE <= {DOC_BUDGET} + 1e-6) AS within_budget FROM s""")
def budget_audit(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    return SL.budget_audit(lines, SL.slice_places(lines, budget=DOC_BUDGET), budget=DOC_BUDGET)


@register("case_preview", f"""WITH RECURSIVE {S.DOC_LINES}, {S.packed('doc_lines', DOC_BUDGET, False)},
w AS (SELECT case_id, count(*) AS slices FROM windows GROUP BY ALL),
n AS (SELECT case_id, count(DISTINCT file) AS files, count(*) AS total_lines FROM doc_lines GROUP BY ALL)
SELECT case_id, files, total_lines, slices, greatest(1, total_lines // greatest(slices, 1)) AS lines_per_slice
FROM n JOIN w USING (case_id)""")
def case_preview(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    return jobs.case_preview(SL.file_inventory(lines, SL.slice_places(lines, budget=DOC_BUDGET)))
