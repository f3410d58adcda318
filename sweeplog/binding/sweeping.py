"""Indicators, hits, findings, filters, the sweep and its drill-down over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplog.binding import sql as S
from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.binding.slicing import DOC_BUDGET, EVENT_BUDGET, raw_stamp
from sweeplog.functions import injection as INJ
from sweeplog.functions import lines as L
from sweeplog.functions import render
from sweeplog.operators import brief as B
from sweeplog.operators import drilldown as D
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators import slices as SL
from sweeplog.plans import jobs
from sweeplog.session import materialize

DOMAIN, IPV4 = L.DOMAIN, L.IPV4

ALERTS = f"""
alerts AS (
  SELECT case_id, doc_id, 'ALERT-' || case_id AS alert_id, 'corpus-monitor' AS detector, 'Unusual vocabulary' AS rule_name,
         'open' AS status, (['low', 'medium', 'high'])[doc_id % 3 + 1] AS severity,
         'Seen: ' || ip || ' and ' || domain || ' in ' || case_id AS summary, ip, domain,
         coalesce(words[1], '') AS word_1, coalesce(words[3], '') AS word_2
  FROM (SELECT source AS case_id, min(doc_id) AS doc_id, max(regexp_extract(text, '{IPV4}')) AS ip,
               max(regexp_extract(text, '{DOMAIN}')) AS domain,
               regexp_extract_all(arg_min(text, doc_id), '[a-z]{{4,7}}') AS words
        FROM documents WHERE text <> '' GROUP BY source)
)"""

DIRECTIVE = ALERTS + """,
directive AS (
  SELECT case_id, summary, list_filter(raw, lambda x, i: x <> '' AND list_position(raw, x) = i) AS indicators
  FROM (SELECT case_id, summary, [domain, ip, word_1, word_2] AS raw FROM alerts)
)"""

HITS = f"""{S.DOC_LINES}, {DIRECTIVE},
hits AS (
  SELECT l.case_id, l.file, l.line_no, d.indicator FROM doc_lines l
  JOIN (SELECT case_id, unnest(indicators) AS indicator FROM directive) d ON l.case_id = d.case_id AND contains(l.text, d.indicator)
)"""

FINDINGS = f"""{HITS}, {S.packed('doc_lines', DOC_BUDGET, False)},
placed AS (
  SELECT h.*, printf('%s-%04d', h.file, w.window_index) AS slice_id, w.window_index,
         row_number() OVER (PARTITION BY h.case_id, h.file, w.window_index, h.indicator ORDER BY h.line_no) AS rn
  FROM hits h JOIN windows w ON w.case_id = h.case_id AND w.file = h.file AND h.line_no BETWEEN w.start_line AND w.end_line
),
findings AS (
  SELECT case_id, file, slice_id, window_index, indicator, 'lines that contain ''' || indicator || '''' AS description,
         count(*) AS match_count, file || ':L' || min(line_no) AS first_ref, file || ':L' || max(line_no) AS last_ref,
         string_agg(file || ':L' || line_no, ', ' ORDER BY line_no) FILTER (WHERE rn <= 5) AS refs
  FROM placed GROUP BY case_id, file, slice_id, window_index, indicator
)"""

EVENT_DIRECTIVE = """
event_directive AS (
  SELECT [' error ', ' purchase ', max(props)] AS indicators, [' view ', 'value=1'] AS irrelevant,
         TIMESTAMP '2024-01-05 00:00:00' AS t0, TIMESTAMP '2024-01-20 12:00:00' AS t1 FROM events
)"""


def doc_hits(spark, sf_dir):
    return I.indicator_hits(V.doc_lines(spark, sf_dir), I.directives(V.alerts(spark, sf_dir)))


def doc_findings(spark, sf_dir):
    return I.findings(doc_hits(spark, sf_dir), V.doc_slices(spark, sf_dir, DOC_BUDGET), budget=DOC_BUDGET)


def doc_outcomes(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    return jobs.sweep(lines, V.doc_slices(spark, sf_dir, DOC_BUDGET), I.directives(V.alerts(spark, sf_dir)), budget=DOC_BUDGET)


def event_findings(spark, sf_dir):
    lines = V.event_lines(spark, sf_dir)
    hits = I.indicator_hits(lines, V.event_alert(spark, sf_dir))
    return I.findings(hits, SL.slice_places(lines, budget=EVENT_BUDGET), budget=EVENT_BUDGET)


@register("text_indicators", f"""
SELECT doc_id, array_to_string(list_concat(
         list_slice(list_filter(d, lambda x, i: list_position(d, x) = i), 1, 4),
         list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 4)), ' ') AS indicators
FROM (SELECT doc_id, regexp_extract_all(text, '{DOMAIN}') AS d, regexp_extract_all(text, '{IPV4}') AS a FROM documents)""")
def text_indicators(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.array_join(L.text_indicators(F.col("text")), " ").alias("indicators"))


@register("alert_indicators", f"""WITH {DIRECTIVE}
SELECT case_id, summary AS alert_restatement, array_to_string(indicators, ' ') AS indicators FROM directive""")
def alert_indicators(spark, sf_dir):
    return I.directives(V.alerts(spark, sf_dir)).select(
        "case_id", "alert_restatement", F.array_join("indicators", " ").alias("indicators")
    )


@register("alert_copy", f"WITH {ALERTS} SELECT case_id, alert_id, detector, rule_name, status, severity FROM alerts")
def alert_copy(spark, sf_dir):
    return B.alert_copy(V.alerts(spark, sf_dir))


@register("fenced_alert", f"""WITH {ALERTS}
SELECT case_id, '<<<UNTRUSTED_DATA kind="external_alert" detector="' || detector || '" alert_id="' || alert_id
       || '" authority="external_detector_owns_status_and_severity"' || chr(10)
       || 'rule_name: ' || rule_name || chr(10)
       || 'status (READ-ONLY, owned by ' || detector || '): ' || status || chr(10)
       || 'severity (READ-ONLY, owned by ' || detector || '): ' || severity || chr(10)
       || 'first_seen: 2024-01-01T00:00:00Z' || chr(10) || 'last_seen: 2024-01-30T00:00:00Z' || chr(10)
       || 'summary: ' || summary || chr(10) || 'entities:' || chr(10)
       || '  word=' || word_1 || chr(10) || '  word=' || word_2 || chr(10)
       || 'detector_fields:' || chr(10) || '  first_document = ' || doc_id || chr(10) || '  version = 1' || chr(10)
       || '>>>END_UNTRUSTED_DATA' AS block
FROM alerts""")
def fenced_alert(spark, sf_dir):
    return V.alerts(spark, sf_dir).select("case_id", render.fence_alert().alias("block"))


@register("indicator_hits", f"WITH {HITS} SELECT case_id, file, line_no, indicator FROM hits")
def indicator_hits(spark, sf_dir):
    return doc_hits(spark, sf_dir).drop("raw_ts")


@register("token_hits", f"""WITH {S.DOC_LINES}, {DIRECTIVE},
tokens AS (SELECT DISTINCT case_id, file, line_no, unnest(list_concat(regexp_extract_all(text, '{DOMAIN}'), regexp_extract_all(text, '{IPV4}'))) AS token
           FROM doc_lines)
SELECT DISTINCT t.case_id, t.file, t.line_no, d.indicator
FROM tokens t JOIN (SELECT case_id, unnest(indicators) AS indicator FROM directive) d
  ON t.case_id = d.case_id AND (t.token = d.indicator OR (ends_with(t.token, '.' || d.indicator) AND contains(d.indicator, '.')
     AND NOT regexp_full_match(t.token, '{IPV4}')))""")
def token_hits(spark, sf_dir):
    listed = I.directives(V.alerts(spark, sf_dir)).select("case_id", F.explode("indicators").alias("indicator"))
    return I.token_hits(V.doc_lines(spark, sf_dir), listed)


@register("indicator_mentions", f"""WITH {HITS}
SELECT case_id, file, indicator, count(*) AS match_count, file || ':L' || min(line_no) AS first_ref,
       file || ':L' || max(line_no) AS last_ref,
       string_agg(file || ':L' || line_no, ', ' ORDER BY line_no) FILTER (WHERE rn <= 5) AS refs
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, file, indicator ORDER BY line_no) AS rn FROM hits) GROUP BY case_id, file, indicator""")
def indicator_mentions(spark, sf_dir):
    found = I.mentions(doc_hits(spark, sf_dir))
    return found.withColumn("refs", F.array_join("representative_refs", ", ")).drop("representative_refs")


@register("findings", f"""WITH RECURSIVE {FINDINGS}
SELECT case_id, file, slice_id, indicator, description, match_count, first_ref, last_ref, refs, 'high' AS confidence FROM findings""")
def findings(spark, sf_dir):
    return doc_findings(spark, sf_dir).select(
        "case_id", "file", "slice_id", "indicator", "description", "match_count", "first_ref", "last_ref",
        F.array_join("representative_refs", ", ").alias("refs"), "confidence",
    )


@register("line_totals", f"""WITH {HITS}
SELECT case_id, count(*) AS summed_matches, count(DISTINCT file || ':' || line_no) AS distinct_lines FROM hits GROUP BY ALL""")
def line_totals(spark, sf_dir):
    return I.line_totals(doc_hits(spark, sf_dir))


@register("cross_file_indicator", f"""WITH {HITS},
f AS (SELECT case_id, indicator, file, count(*) AS line_count, min(line_no) AS first_line, max(line_no) AS last_line FROM hits GROUP BY ALL)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY case_id, indicator) AS files FROM f) WHERE files > 1""")
def cross_file_indicator(spark, sf_dir):
    return I.cross_file(doc_hits(spark, sf_dir))


@register("time_window_filter", f"""WITH {S.EVENT_LINES}, {EVENT_DIRECTIVE}
SELECT case_id, file, line_no, text FROM event_lines, event_directive
WHERE starts_with(text, '#') OR CAST(replace({raw_stamp('text')}, 'Z', '') AS TIMESTAMP) BETWEEN t0 AND t1""")
def time_window_filter(spark, sf_dir):
    return I.within_window(V.event_lines(spark, sf_dir), V.event_alert(spark, sf_dir))


@register("exclusion_filter", f"""WITH {S.EVENT_LINES}, {EVENT_DIRECTIVE},
m AS (SELECT case_id, file, line_no, contains(text, irrelevant[1]) OR contains(text, irrelevant[2]) AS listed,
             contains(text, indicators[1]) OR contains(text, indicators[2]) OR contains(text, indicators[3]) AS hit
      FROM event_lines, event_directive)
SELECT case_id, file, line_no, listed AND NOT hit AS excluded, listed AND hit AS conflict FROM m""")
def exclusion_filter(spark, sf_dir):
    return I.apply_exclusions(V.event_lines(spark, sf_dir), V.event_alert(spark, sf_dir)).drop("text")


@register("sweep_taskings", f"""WITH RECURSIVE {S.DOC_LINES}, {DIRECTIVE}, {S.packed('doc_lines', DOC_BUDGET, False)}
SELECT case_id || '/sweep/' || printf('%s-%04d', file, window_index) AS task_id, case_id, CAST(0 AS BIGINT) AS iteration,
       printf('%s-%04d', file, window_index) AS slice_id, start_line, end_line, summary AS commander_intent
FROM windows JOIN directive USING (case_id)""")
def sweep_taskings(spark, sf_dir):
    tasks = I.taskings(V.doc_slices(spark, sf_dir, DOC_BUDGET), I.directives(V.alerts(spark, sf_dir)))
    return tasks.select("task_id", "case_id", "iteration", "slice_id", "start_line", "end_line", "commander_intent")


SWEPT = f"""{FINDINGS},
tasks AS (SELECT w.case_id, w.file, w.window_index, printf('%s-%04d', w.file, w.window_index) AS slice_id,
                 w.start_line, w.end_line, d.indicators FROM windows w JOIN directive d USING (case_id)),
swept AS (
  SELECT t.*, coalesce(f.findings, 0) AS findings, coalesce(f.matches, 0) AS matches, coalesce(f.seen, CAST([] AS VARCHAR[])) AS seen
  FROM tasks t LEFT JOIN (
    SELECT case_id, slice_id, count(*) AS findings, CAST(sum(match_count) AS BIGINT) AS matches, list(indicator) AS seen
    FROM findings GROUP BY ALL) f USING (case_id, slice_id)
)"""


@register("sweep", f"""WITH RECURSIVE {SWEPT}
SELECT case_id, slice_id, findings > 0 AS relevant, CAST(end_line - start_line + 1 AS BIGINT) AS lines_examined,
       CAST(findings AS BIGINT) AS findings, matches AS matching_lines,
       array_to_string(list_sort(list_filter(indicators, lambda x: NOT list_contains(seen, x))), ' ') AS not_seen
FROM swept""")
def sweep(spark, sf_dir):
    report = F.col("report")
    return I.with_absent(doc_outcomes(spark, sf_dir), I.directives(V.alerts(spark, sf_dir))).select(
        "case_id", "slice_id", report["relevant"].alias("relevant"),
        report["slice_metadata"]["lines_examined"].alias("lines_examined"),
        F.size(report["findings"]).cast("bigint").alias("findings"),
        O.matching_lines(report).alias("matching_lines"),
        F.array_join(F.array_sort(F.transform(report["checked_for"], lambda c: c["checked_for"])), " ").alias("not_seen"),
    )


@register("sweep_coverage", f"""WITH RECURSIVE {SWEPT}
SELECT case_id, count(*) AS tasks, count(*) FILTER (WHERE findings > 0) AS detailed, count(*) FILTER (WHERE findings = 0) AS empty,
       CAST(0 AS BIGINT) AS failed, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(matches) AS BIGINT) AS matching_lines
FROM swept GROUP BY ALL""")
def sweep_coverage(spark, sf_dir):
    return O.coverage(doc_outcomes(spark, sf_dir)).select(
        "case_id", "tasks", "detailed", "empty", "failed", "findings", "matching_lines"
    )


@register("sweep_negatives", f"""WITH RECURSIVE {SWEPT}
SELECT case_id, x AS checked_for, count(*) AS slices
FROM (SELECT case_id, unnest(list_filter(indicators, lambda x: NOT list_contains(seen, x))) AS x FROM swept) GROUP BY ALL""")
def sweep_negatives(spark, sf_dir):
    return O.negatives_by_difference(doc_outcomes(spark, sf_dir), I.directives(V.alerts(spark, sf_dir))).drop("first_seen")


@register("windowed_sweep", f"""WITH RECURSIVE {S.EVENT_LINES}, {EVENT_DIRECTIVE}, {S.packed('event_lines', EVENT_BUDGET, True)},
h AS (SELECT l.case_id, l.file, l.line_no, indicator,
             starts_with(text, '#') OR CAST(replace({raw_stamp('text')}, 'Z', '') AS TIMESTAMP) BETWEEN t0 AND t1 AS inside
      FROM event_lines l, (SELECT t0, t1, unnest(indicators) AS indicator FROM event_directive) WHERE contains(text, indicator)),
s AS (SELECT h.case_id, h.file, w.window_index, indicator, bool_or(inside) AS inside
      FROM h JOIN windows w ON w.file = h.file AND h.line_no BETWEEN w.start_line AND w.end_line GROUP BY ALL),
n AS (SELECT case_id, count(*) AS n FROM windows GROUP BY case_id)
SELECT n.case_id, i.indicator AS checked_for, count(*) FILTER (WHERE inside) AS found, count(*) FILTER (WHERE NOT inside) AS outside,
       any_value(n) - count(s.indicator) AS absent
FROM n, (SELECT unnest(indicators) AS indicator FROM event_directive) i LEFT JOIN s ON s.indicator = i.indicator GROUP BY ALL""")
def windowed_sweep(spark, sf_dir):
    """Of each indicator the slices that have it inside the directive's time window, only outside it, and not at all."""
    lines, directive = V.event_lines(spark, sf_dir), materialize(V.event_alert(spark, sf_dir), "directive")
    outcomes = materialize(jobs.sweep(lines, SL.slice_places(lines, budget=EVENT_BUDGET), directive, budget=EVENT_BUDGET), "outcomes")
    absent = O.negatives_by_difference(outcomes, directive).select("case_id", "checked_for", F.col("slices").alias("absent"))
    outside = O.seen_outside(outcomes).withColumnRenamed("slices", "outside")
    spoken = outcomes.select("case_id", F.explode("seen").alias("checked_for")).groupBy("case_id", "checked_for").agg(F.count("*").alias("_seen"))
    each = directive.select("case_id", F.explode("indicators").alias("checked_for"))
    keys, zero = ["case_id", "checked_for"], F.lit(0).cast("bigint")
    joined = each.join(absent, keys, "left").join(outside, keys, "left").join(spoken, keys, "left")
    out = F.coalesce("outside", zero)
    return joined.select(*keys, (F.coalesce("_seen", zero) - out).alias("found"), out.alias("outside"), F.coalesce("absent", zero).alias("absent"))


MANY = "(SELECT DISTINCT left(text, 20) AS indicator FROM benchmark WHERE text <> '' UNION SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{9}')) AS name FROM benchmark))"


@register("many_indicator_hits", f"""WITH {S.DOC_LINES}
SELECT l.case_id, l.file, l.line_no, i.indicator FROM doc_lines l JOIN {MANY} i ON contains(l.text, i.indicator)""")
def many_indicator_hits(spark, sf_dir):
    """Every case against the starts and the long words of all benchmark passages, by their seeds."""
    passages = V.table(spark, sf_dir, "benchmark").filter("text <> ''")
    listed = passages.agg(F.array_distinct(F.concat(F.collect_set(F.left("text", F.lit(20))), F.flatten(F.collect_set(
        F.regexp_extract_all("text", F.lit("[a-z]{9}"), F.lit(0)))))).alias("indicators"))
    cases = V.table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")).distinct()
    return I.indicator_hits(V.doc_lines(spark, sf_dir), cases.crossJoin(F.broadcast(listed)), indexed=True).drop("raw_ts")


CHOSEN = f"""{SWEPT},
chosen AS (
  SELECT * FROM (SELECT case_id, slice_id, file, window_index, matches AS match_count,
                        row_number() OVER (PARTITION BY case_id ORDER BY matches DESC, file, window_index) AS rank
                 FROM swept WHERE findings > 0) WHERE rank <= 8
)"""


@register("drilldown_targets", f"""WITH RECURSIVE {CHOSEN}
SELECT case_id, slice_id, match_count, rank, CAST(ceil(rank / 4.0) AS BIGINT) AS iteration FROM chosen""")
def drilldown_targets(spark, sf_dir):
    return D.choose(doc_outcomes(spark, sf_dir)).select("case_id", "slice_id", "match_count", "rank", "iteration")


@register("drilldown_taskings", f"""WITH RECURSIVE {CHOSEN}
SELECT printf('%s/i%d-t%d', case_id, CAST(ceil(rank / 4.0) AS BIGINT), (rank - 1) % 4) AS task_id, case_id,
       CAST(ceil(rank / 4.0) AS BIGINT) AS iteration, slice_id, start_line, end_line
FROM chosen JOIN (SELECT case_id, slice_id, start_line, end_line FROM tasks) USING (case_id, slice_id)""")
def drilldown_taskings(spark, sf_dir):
    tasks = D.taskings(D.choose(doc_outcomes(spark, sf_dir)), V.doc_slices(spark, sf_dir, DOC_BUDGET))
    return tasks.select("task_id", "case_id", "iteration", "slice_id", "start_line", "end_line")


@register("all_rounds", f"""WITH RECURSIVE {SWEPT},
runs AS (SELECT case_id, slice_id, count(*) AS findings FROM (SELECT DISTINCT case_id, slice_id, indicator, line_no - rn AS run FROM (
           SELECT *, row_number() OVER (PARTITION BY case_id, slice_id, indicator ORDER BY line_no) AS rn FROM placed)) GROUP BY ALL),
flagged AS (SELECT case_id, file, slice_id, window_index, matches FROM swept WHERE findings > 0),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY matches DESC, file, window_index) AS rank FROM flagged) WHERE rank <= 6),
rest AS (SELECT f.*, EXISTS (SELECT 1 FROM first o WHERE o.case_id = f.case_id AND o.file = f.file AND abs(o.window_index - f.window_index) = 1) AS near
         FROM flagged f ANTI JOIN first USING (case_id, slice_id)),
second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY near DESC, matches DESC, file, window_index) AS rank FROM rest) WHERE rank <= 6)
SELECT case_id, CAST(0 AS BIGINT) AS iteration, case_id || '/sweep/' || slice_id AS task_id, slice_id, 'report' AS outcome, CAST(findings AS BIGINT) AS findings, matches AS matching_lines FROM swept
UNION ALL SELECT case_id, 1, printf('%s/i1-t%d', case_id, rank - 1), slice_id, 'report', r.findings, matches FROM first JOIN runs r USING (case_id, slice_id)
UNION ALL SELECT case_id, 2, printf('%s/i2-t%d', case_id, rank - 1), slice_id, 'report', r.findings, matches FROM second JOIN runs r USING (case_id, slice_id)""")
def all_rounds(spark, sf_dir):
    """The sweep and two rounds of six closer reads a case, the second chosen from what the first one brought."""
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    read = jobs.investigate(lines, V.doc_slices(spark, sf_dir, DOC_BUDGET), I.directives(V.alerts(spark, sf_dir)), budget=DOC_BUDGET, rounds=2, max_tasks=6)
    return read.select(
        "case_id", "iteration", "task_id", "slice_id", "outcome", F.size("report.findings").cast("bigint").alias("findings"),
        O.matching_lines(F.col("report")).alias("matching_lines"),
    )


@register("neighbour_slices", f"""WITH RECURSIVE {CHOSEN}
SELECT c.case_id, c.file, c.slice_id AS flagged_slice, t.slice_id, t.window_index, t.start_line, t.end_line
FROM chosen c JOIN tasks t ON t.case_id = c.case_id AND t.file = c.file AND abs(t.window_index - c.window_index) = 1""")
def neighbour_slices(spark, sf_dir):
    slices = V.doc_slices(spark, sf_dir, DOC_BUDGET)
    return D.neighbours(D.choose(doc_outcomes(spark, sf_dir)), slices).select(
        "case_id", "file", "flagged_slice", "slice_id", "window_index", "start_line", "end_line"
    )


@register("plan_problems", f"""WITH RECURSIVE {CHOSEN},
plan AS (SELECT case_id, rank - 1 AS position, CASE WHEN rank % 3 = 0 THEN slice_id || 'x' ELSE slice_id END AS slice_id,
                CASE WHEN rank % 4 = 0 THEN ' ' ELSE 'confirm' END AS intent FROM chosen)
SELECT case_id, CAST(-1 AS BIGINT) AS position, count(*) || ' tasks are planned; a round takes 4 at most.' AS problem
FROM plan GROUP BY case_id HAVING count(*) > 4
UNION ALL
SELECT case_id, position, 'tasks[' || position || '].slice_id ''' || slice_id || ''' is not a slice in this case.' FROM plan WHERE ends_with(slice_id, 'x')
UNION ALL
SELECT case_id, position, 'tasks[' || position || '].commander_intent is blank: name what the read is to settle.' FROM plan WHERE intent = ' '""")
def plan_problems(spark, sf_dir):
    chosen = D.choose(doc_outcomes(spark, sf_dir))
    wrong = F.col("rank") % 3 == 0
    plan = chosen.select(
        "case_id", (F.col("rank") - 1).alias("position"),
        F.when(wrong, F.concat("slice_id", F.lit("x"))).otherwise(F.col("slice_id")).alias("slice_id"),
        F.when(F.col("rank") % 4 == 0, F.lit(" ")).otherwise(F.lit("confirm")).alias("commander_intent"),
    )
    return D.plan_problems(plan, V.doc_slices(spark, sf_dir, DOC_BUDGET))


@register("evidence_timeline", f"""WITH RECURSIVE {S.EVENT_LINES}, {EVENT_DIRECTIVE}, {S.packed('event_lines', EVENT_BUDGET, True)},
hits AS (SELECT case_id, file, line_no, unnest(indicators) AS indicator, text FROM event_lines, event_directive),
f AS (SELECT h.case_id, h.file, w.window_index, indicator, count(*) AS match_count, min(line_no) AS lo, max(line_no) AS hi
      FROM hits h JOIN windows w ON w.file = h.file AND h.line_no BETWEEN w.start_line AND w.end_line
      WHERE contains(text, indicator) GROUP BY ALL),
e AS (SELECT *, 'first' AS endpoint, lo AS line_no FROM f UNION ALL SELECT *, 'last', hi FROM f)
SELECT e.case_id, printf('%s-%04d', e.file, e.window_index) AS slice_id, indicator, match_count, endpoint,
       e.file || ':L' || e.line_no AS ref, {raw_stamp('l.text')} AS raw_ts,
       epoch_us(CAST(replace({raw_stamp('l.text')}, 'Z', '') AS TIMESTAMP)) AS ts_micros
FROM e JOIN event_lines l ON l.file = e.file AND l.line_no = e.line_no""")
def evidence_timeline(spark, sf_dir):
    rows = B.timeline(event_findings(spark, sf_dir))
    return rows.withColumn("ts_micros", F.unix_micros("ts")).drop("ts", "description")


@register("fenced_slice", f"""WITH RECURSIVE {S.EVENT_LINES}, {S.packed('event_lines', EVENT_BUDGET, True)},
t AS (SELECT case_id, file, min(raw) || '/' || max(raw) AS time_range FROM (SELECT case_id, file, {raw_stamp('text')} AS raw FROM event_lines) GROUP BY ALL),
h AS (SELECT file, string_agg('  ' || text, chr(10) ORDER BY line_no) AS header FROM event_lines WHERE starts_with(text, '#') GROUP BY ALL),
b AS (SELECT w.case_id, w.file, w.window_index, w.window_count, w.start_line, w.end_line, w.line_count,
             string_agg(w.file || ':L' || l.line_no || chr(9) || l.text, chr(10) ORDER BY l.line_no) AS body
      FROM windows w JOIN event_lines l ON l.file = w.file AND l.line_no BETWEEN w.start_line AND w.end_line GROUP BY ALL)
SELECT case_id, printf('%s-%04d', file, window_index) AS slice_id,
  '<<<UNTRUSTED_DATA kind="raw_log_slice" slice_id="' || printf('%s-%04d', file, window_index) || '" source="' || replace(file, '.log', '')
  || '" host="" file="' || file || '" time_range="' || time_range || '" lines="' || start_line || '-' || end_line
  || '" cite_as="' || file || ':L<line-number>" shown_because="systematic sweep, window ' || window_index || ' of ' || window_count
  || ': lines ' || start_line || '-' || end_line || ' of ' || line_count || ' in ' || file || '"' || chr(10)
  || CASE WHEN header IS NULL THEN '' ELSE '[format header for ' || file
       || ', reproduced from the top of the file -- context only, NOT part of this slice and NOT citable]' || chr(10) || header || chr(10)
       || '[end format header; the citable lines of this slice follow]' || chr(10) END
  || body || chr(10) || '>>>END_UNTRUSTED_DATA' AS block
FROM b JOIN t USING (case_id, file) LEFT JOIN h USING (file)""")
def fenced_slice(spark, sf_dir):
    lines = V.event_lines(spark, sf_dir)
    built = SL.build_slices(lines, budget=EVENT_BUDGET)
    contents = SL.slice_lines(lines, built, budget=EVENT_BUDGET).select("case_id", "slice_id", "lines")
    return built.join(contents, ["case_id", "slice_id"]).select("case_id", "slice_id", render.fence_slice().alias("block"))


def _signal_sql() -> str:
    parts = []
    for name, pattern, why in INJ.SIGNALS:
        flagged = S.text("(?i)" + pattern)
        before = S.text("(?is)^(.*?)(?:" + pattern + ")")
        parts.append(f"""
  SELECT case_id, file, line_no, {S.text(name)} AS signal, {S.text(why)} AS why, text,
         length(regexp_extract(text, {before}, 1)) AS before, length(regexp_extract(text, {flagged})) AS width
  FROM planted_lines WHERE regexp_matches(text, {flagged})""")
    return " UNION ALL ".join(parts)


SIGNALS = f"""{S.PLANTED_LINES}, found AS ({_signal_sql()}),
signals AS (SELECT case_id, file, line_no, signal, why,
  left(trim(substring(text, greatest(0, before - 40) + 1, before + width + 40 - greatest(0, before - 40))), 240) AS excerpt FROM found)"""


@register("injection_scan", f"WITH {SIGNALS} SELECT case_id, file || ':L' || line_no AS location, signal, why, excerpt FROM signals")
def injection_scan(spark, sf_dir):
    return jobs.scan_injection(V.planted_lines(spark, sf_dir))


@register("injection_by_signal", f"WITH {SIGNALS} SELECT signal, count(*) AS hits, count(DISTINCT file) AS files FROM signals GROUP BY ALL")
def injection_by_signal(spark, sf_dir):
    hits = INJ.scan(V.planted_lines(spark, sf_dir))
    return hits.groupBy("signal").agg(F.count("*").alias("hits"), F.countDistinct("file").alias("files"))


@register("briefs", f"""WITH RECURSIVE {SWEPT}, {SIGNALS.replace(S.DOC_LINES + ',', '', 1)},
c AS (SELECT case_id, count(*) AS slices_swept, CAST(1 AS BIGINT) AS iterations_used, count(*) FILTER (WHERE findings > 0) AS detailed, count(*) FILTER (WHERE findings = 0) AS empty,
             CAST(0 AS BIGINT) AS failed, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(matches) AS BIGINT) AS matching_lines
      FROM swept GROUP BY ALL)
SELECT case_id, alert_id, detector, rule_name, status, severity, slices_swept, iterations_used, detailed, empty, failed, findings, matching_lines,
       coalesce(n, 0) AS injection_signals
FROM alerts JOIN c USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM signals GROUP BY ALL) USING (case_id)""")
def briefs(spark, sf_dir):
    signals = INJ.scan(V.planted_lines(spark, sf_dir))
    return B.briefs(V.alerts(spark, sf_dir), O.coverage(doc_outcomes(spark, sf_dir)), signals)
