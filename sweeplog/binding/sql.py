"""The same views in SQL, for comparing every query with an independent engine."""

from __future__ import annotations

from sweeplog.binding.views import EVENT_HEADER, PLANTED


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DOC_LINES = """
doc_lines AS (
  SELECT case_id, file, doc_id, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no, unnest(parts) AS text
  FROM (
    SELECT source AS case_id, 'doc-' || doc_id || '.txt' AS file, doc_id,
           string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts
    FROM documents WHERE text <> ''
  )
)
"""

_EVENT_TEXT = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || event_type || ' value=' || "
    "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' ' || props"
)

EVENT_ROWS = f"""
event_rows AS (
  SELECT 'events' AS case_id, 'user-' || user_id || '.log' AS file,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
              + CASE WHEN user_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS line_no,
         {_EVENT_TEXT} AS text, event_id, user_id, ts, event_type, value, props
  FROM events
)
"""

_HEADER_TEXT = [" || chr(9) || ".join(text(part) for part in line.split("\t")) for line in EVENT_HEADER]

EVENT_LINES = EVENT_ROWS + f""",
event_lines AS (
  SELECT case_id, file, line_no, text FROM event_rows
  UNION ALL
  SELECT DISTINCT 'events', 'user-' || user_id || '.log', CAST(1 AS BIGINT), {_HEADER_TEXT[0]} FROM events WHERE user_id % 3 = 0
  UNION ALL
  SELECT DISTINCT 'events', 'user-' || user_id || '.log', CAST(2 AS BIGINT), {_HEADER_TEXT[1]} FROM events WHERE user_id % 3 = 0
)
"""

PLANTED_LINES = DOC_LINES + f""",
planted_lines AS (
  SELECT case_id, file, doc_id, line_no,
         CASE WHEN (doc_id + line_no) % 97 = 0
              THEN text || ' ' || ([{", ".join(text(p) for p in PLANTED)}])[((doc_id + line_no) // 97) % {len(PLANTED)} + 1]
              ELSE text END AS text
  FROM doc_lines
)
"""


def packed(lines: str, budget: int, headers: bool, name: str = "windows") -> str:
    """Greedy packing as a recursive walk along each file, adding doubles in line order."""
    source = f"(SELECT *, {budget} AS budget FROM {lines})"
    before = ""
    if headers:
        before = f"""
headers AS (
  SELECT case_id, file, sum(length(text)) AS header_chars FROM (
    SELECT t.case_id, t.file, t.text, t.line_no,
           coalesce(min(CASE WHEN NOT starts_with(t.text, '#') THEN t.line_no END) OVER (PARTITION BY t.case_id, t.file), 13) AS stop
    FROM {lines} t WHERE t.line_no <= 12)
  WHERE line_no < stop GROUP BY ALL
),
"""
        source = f"""(SELECT l.*, greatest(500, CAST(trunc({budget} - coalesce(h.header_chars, 0) / 1.4::DOUBLE) AS BIGINT)) AS budget
          FROM {lines} l LEFT JOIN headers h USING (case_id, file))"""
    return f"""{before}
costs AS MATERIALIZED (
  SELECT case_id, file, line_no, length(text) / 1.4::DOUBLE + 12::DOUBLE AS cost, budget FROM {source}
),
packed AS (
  SELECT case_id, file, line_no, cost AS running, CAST(1 AS BIGINT) AS window_index FROM costs WHERE line_no = 1
  UNION ALL
  SELECT c.case_id, c.file, c.line_no,
         CASE WHEN p.running + c.cost > c.budget THEN c.cost ELSE p.running + c.cost END,
         CASE WHEN p.running + c.cost > c.budget THEN p.window_index + 1 ELSE p.window_index END
  FROM packed p JOIN costs c ON c.case_id = p.case_id AND c.file = p.file AND c.line_no = p.line_no + 1
),
{name} AS (
  SELECT case_id, file, window_index, min(line_no) AS start_line, max(line_no) AS end_line,
         CAST(count(*) OVER (PARTITION BY case_id, file) AS BIGINT) AS window_count,
         CAST(max(max(line_no)) OVER (PARTITION BY case_id, file) AS BIGINT) AS line_count
  FROM packed GROUP BY case_id, file, window_index
)"""
