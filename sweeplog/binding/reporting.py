"""Citations, report rules, outcomes, coverage, negatives, ledger and brief audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplog.binding import sql as S
from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.binding.sweeping import ALERTS
from sweeplog.functions import lines as L
from sweeplog.functions import problems as P
from sweeplog.functions import render, replies
from sweeplog.operators import brief as B
from sweeplog.operators import citations as C
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators import runstats as R

# A budget that no document reaches, so that every document is one slice.
WHOLE_FILE = 1_000_000

REF = r"^[\w.\-/]+:L\d+$"

REPORTS = f"""
docs AS (
  SELECT doc_id AS d, source AS case_id, lang, 'doc-' || doc_id || '.txt' AS file, 'doc-' || doc_id || '.txt-0001' AS slice_id, text,
         CAST(len(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS BIGINT) AS n
  FROM documents WHERE text <> ''
),
rep AS (
  SELECT docs.*, quality, toxic, case_id || '/sweep/' || slice_id AS task_id, d % 7 AS k, d % 2 + 1 AS attempts,
         CASE WHEN quality = 0 AND d % 5 <> 0 THEN false ELSE d % 10 <> 9 END AS has_main
  FROM labels JOIN docs ON labels.doc_id = docs.d
),
rep_findings AS (
  SELECT *, CAST(0 AS BIGINT) AS fidx, 'main pattern' AS description, 'medium' AS confidence, k + d % 4 - 1 AS match_count,
         list_concat(list_transform(range(1, k + 1), lambda i: file || ':L' || i),
           CASE WHEN toxic = 1 AND d % 2 = 0 THEN [file || ':L' || (n + 1)] WHEN toxic = 1 THEN ['bad ref L1'] ELSE CAST([] AS VARCHAR[]) END,
           CASE WHEN d % 16 = 3 THEN [file || ':L01'] ELSE CAST([] AS VARCHAR[]) END) AS refs,
         file || ':L1' AS first_ref, CASE WHEN d % 4 = 0 THEN '' ELSE file || ':L' || n END AS last_ref
  FROM rep WHERE has_main
  UNION ALL
  SELECT *, 1, 'second pattern', 'low', 1, [file || ':L1'], file || ':L1', '' FROM rep WHERE has_main AND d % 3 = 0
),
rep_refs AS (
  SELECT r.*, 4 AS part, i AS pos, refs[i] AS ref, 'findings[' || fidx || ']' AS label
  FROM rep_findings r, unnest(range(1, len(refs) + 1)) AS u(i)
  UNION ALL
  SELECT *, 5, 1, first_ref, 'findings[' || fidx || '] endpoints' FROM rep_findings WHERE first_ref <> ''
  UNION ALL
  SELECT *, 5, 2, last_ref, 'findings[' || fidx || '] endpoints' FROM rep_findings WHERE last_ref <> ''
),
checked_refs AS (
  SELECT *, regexp_matches(ref, '{REF}') AS well_formed,
         coalesce(regexp_extract(ref, '^(.*):L([1-9][0-9]*)$', 1) = file
           AND TRY_CAST(nullif(regexp_extract(ref, ':L([1-9][0-9]*)$', 1), '') AS BIGINT) BETWEEN 1 AND n, false) AS inside
  FROM rep_refs
),
problems AS (
  SELECT task_id, 1 AS section, 0 AS fidx, 1 AS part, 0 AS pos, 'a slice called irrelevant comes with findings.' AS problem
  FROM rep WHERE quality = 0 AND has_main
  UNION ALL
  SELECT task_id, 1, 0, 2, 0, 'a check of a slice called irrelevant has a positive result for ''language ' || lang || '''.'
  FROM rep WHERE quality = 0 AND d % 13 = 0
  UNION ALL
  SELECT task_id, 2, fidx, 1, 0, 'findings[' || fidx || '] has no representative_refs; cite a line of slice ' || slice_id || '.'
  FROM rep_findings WHERE len(refs) = 0
  UNION ALL
  SELECT task_id, 2, fidx, 2, 0, 'findings[' || fidx || '] returned ' || len(refs) || ' representative_refs; the limit is 5.'
  FROM rep_findings WHERE len(refs) > 5
  UNION ALL
  SELECT task_id, 2, fidx, 3, 0, 'findings[' || fidx || '] has match_count ' || match_count || ' but cites ' || len(refs) || ' lines.'
  FROM rep_findings WHERE match_count < len(refs)
  UNION ALL
  SELECT task_id, 2, fidx, part, pos,
         CASE WHEN NOT well_formed THEN label || ' citation ''' || ref || ''' is malformed; the required form is ''' || file || ':L<line-number>''.'
              ELSE label || ' cites ''' || ref || ''', which is not in slice ' || slice_id || ' (lines 1-' || n || ' of ' || file || ').' END
  FROM checked_refs WHERE NOT well_formed OR NOT inside
  UNION ALL
  SELECT task_id, 3, 0, 0, 0, 'slice_metadata.slice_id is ''other-0001'' but this task''s slice is ''' || slice_id || '''.'
  FROM rep WHERE d % 11 = 0
),
judged AS (
  SELECT r.task_id, count(p.problem) AS problem_count, string_agg(p.problem, '|' ORDER BY section, p.fidx, part, pos) AS problems,
         list(p.problem ORDER BY section, p.fidx, part, pos) FILTER (WHERE p.problem IS NOT NULL) AS problem_list
  FROM rep r LEFT JOIN problems p USING (task_id) GROUP BY ALL
)"""

OUTCOMES = f"""{REPORTS}, {ALERTS},
outcomes AS (
  SELECT d.case_id || '/sweep/' || d.slice_id AS task_id, d.case_id, d.slice_id, d.file, d.d, d.lang, a.summary AS commander_intent,
         CASE WHEN j.problem_count = 0 THEN 'report' ELSE 'failure' END AS outcome, coalesce(r.attempts, 0) AS attempts,
         CASE WHEN j.problem_count IS NULL THEN 'timeout'
              WHEN j.problem_count > 0 THEN CASE WHEN contains(problems, 'cite') OR contains(problems, 'representative_refs')
                    OR contains(problems, 'citation') THEN 'citations' ELSE 'schema' END END AS reason,
         CASE WHEN j.problem_count IS NULL THEN 'no answer was collected'
              WHEN j.problem_count > 0 THEN 'report rejected after ' || attempts || ' attempt(s)' END AS detail,
         problem_count, problem_list, r.quality = 1 AS relevant, coalesce(r.has_main, false) AS has_main
  FROM docs d JOIN alerts a USING (case_id)
  LEFT JOIN rep r ON r.d = d.d LEFT JOIN judged j ON j.task_id = r.task_id
),
outcome_findings AS (
  SELECT o.case_id, o.file, o.slice_id, o.task_id, f.fidx, f.match_count, f.refs, f.first_ref, f.last_ref, f.description, f.confidence
  FROM outcomes o JOIN rep_findings f ON f.task_id = o.task_id WHERE o.outcome = 'report' AND o.relevant
),
marked AS (
  SELECT o.*, CASE WHEN outcome = 'failure' THEN 'failed' WHEN relevant AND has_main THEN 'detailed' ELSE 'empty' END AS bucket,
         CASE WHEN outcome = 'report' AND d % 13 = 0 THEN 1 ELSE 0 END AS stray,
         coalesce(f.n, 0) AS findings, coalesce(f.m, 0) AS matches
  FROM outcomes o LEFT JOIN (SELECT task_id, count(*) AS n, sum(match_count) AS m FROM outcome_findings GROUP BY ALL) f USING (task_id)
),
negative AS (
  SELECT case_id, file, 1 AS pos, 'language ' || lang AS checked_for FROM outcomes WHERE outcome = 'report' AND d % 13 <> 0
  UNION ALL
  SELECT case_id, file, 2, 'topic ' || (d % 40) FROM outcomes WHERE outcome = 'report'
)"""


def whole_slices(spark, sf_dir):
    return V.doc_slices(spark, sf_dir, WHOLE_FILE)


def judged(spark, sf_dir):
    return C.with_problems(V.report_answers(spark, sf_dir), whole_slices(spark, sf_dir))


def outcomes(spark, sf_dir):
    slices = whole_slices(spark, sf_dir)
    tasks = I.taskings(slices, I.directives(V.alerts(spark, sf_dir)))
    return O.settle(tasks, C.with_problems(V.report_answers(spark, sf_dir), slices))


def doc_inventory(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents").filter("text <> ''")
    return documents.select(
        F.col("source").alias("case_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("file"),
        F.size(V.text_lines(F.col("text"))).cast("bigint").alias("line_count"),
    )


@register("ref_wellformed", f"""WITH {REPORTS} SELECT task_id, fidx, label, pos, ref, well_formed FROM checked_refs""")
def ref_wellformed(spark, sf_dir):
    found = V.report_answers(spark, sf_dir).select("task_id", F.posexplode("report.findings").alias("fidx", "f"))
    label = F.concat(F.lit("findings["), "fidx", F.lit("]"))
    samples = found.select("task_id", "fidx", label.alias("label"), F.posexplode("f.representative_refs").alias("_p", "ref"))
    ends = found.select(
        "task_id", "fidx", F.concat(label, F.lit(" endpoints")).alias("label"),
        F.posexplode(F.array("f.first_ref", "f.last_ref")).alias("_p", "ref"),
    ).filter("ref <> ''")
    return samples.unionByName(ends).select(
        "task_id", F.col("fidx").cast("bigint").alias("fidx"), "label", (F.col("_p") + 1).cast("bigint").alias("pos"), "ref",
        L.is_well_formed_ref(F.col("ref")).alias("well_formed"),
    )


@register("fabricated_refs", f"""WITH {REPORTS}
SELECT DISTINCT case_id, slice_id, ref FROM checked_refs WHERE well_formed AND NOT inside""")
def fabricated_refs(spark, sf_dir):
    return C.fabricated_refs(V.report_answers(spark, sf_dir), whole_slices(spark, sf_dir))


@register("unresolved_refs", f"""WITH {REPORTS}, {S.DOC_LINES}
SELECT DISTINCT r.case_id, r.ref FROM rep_refs r
WHERE NOT EXISTS (SELECT 1 FROM doc_lines l WHERE l.case_id = r.case_id AND l.file || ':L' || l.line_no = r.ref)""")
def unresolved_refs(spark, sf_dir):
    return C.unresolved_refs(C.cited_refs(V.report_answers(spark, sf_dir)), doc_inventory(spark, sf_dir))


@register("known_refs", f"""WITH {S.EVENT_LINES} SELECT DISTINCT case_id, file || ':L' || line_no AS ref FROM event_lines""")
def known_refs(spark, sf_dir):
    return C.known_refs(V.event_lines(spark, sf_dir))


@register("uncitable_files", f"""
SELECT 'pages' AS case_id, file, line_count FROM (
  SELECT regexp_extract(url, '[^/]*$') AS file, CAST(len(string_split(html, chr(10))) AS BIGINT) AS line_count FROM pages)
WHERE NOT regexp_matches(file || ':L1', '{REF}')""")
def uncitable_files(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("case_id"), F.regexp_extract("url", "[^/]*$", 0).alias("file"),
        F.size(F.split("html", "\n", -1)).cast("bigint").alias("line_count"),
    )
    return C.uncitable_files(pages)


@register("report_problems", f"""WITH {REPORTS}
SELECT task_id, CAST(problem_count AS BIGINT) AS problem_count, coalesce(problems, '') AS problems FROM judged""")
def report_problems(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "task_id", F.size("problems").cast("bigint").alias("problem_count"), F.array_join("problems", "|").alias("problems")
    )


@register("failure_reason", f"""WITH {REPORTS}
SELECT task_id, CASE WHEN contains(problems, 'cite') OR contains(problems, 'representative_refs') THEN 'citations' ELSE 'schema' END AS compat_reason,
       CASE WHEN contains(problems, 'cite') OR contains(problems, 'representative_refs') OR contains(problems, 'citation')
            THEN 'citations' ELSE 'schema' END AS reason
FROM judged WHERE problem_count > 0""")
def failure_reason(spark, sf_dir):
    rejected = judged(spark, sf_dir).filter(F.size("problems") > 0)
    return rejected.select(
        "task_id", P.failure_reason(F.col("problems"), compat=True).alias("compat_reason"),
        P.failure_reason(F.col("problems")).alias("reason"),
    )


def reason_case(problem: str) -> str:
    tests = []
    for phrases, reason in P.REJECTION_PHRASES:
        test = " AND ".join(f"contains({problem}, {S.text(p)})" for p in phrases)
        tests.append(f"WHEN {test} THEN '{reason}'")
    return "CASE " + " ".join(tests) + " ELSE 'other' END"


@register("report_rejection_reasons", f"""WITH {REPORTS}
SELECT reason, count(*) AS reports FROM (SELECT DISTINCT task_id, {reason_case('problem')} AS reason FROM problems) GROUP BY ALL""")
def report_rejection_reasons(spark, sf_dir):
    rejected = judged(spark, sf_dir).filter(F.size("problems") > 0)
    return (
        rejected.select(F.explode(P.rejection_reasons(F.col("problems"))).alias("reason"))
        .groupBy("reason").agg(F.count("*").alias("reports"))
    )


@register("custom_rule", f"""WITH {REPORTS}
SELECT r.task_id, CAST(j.problem_count + CASE WHEN n > 20 THEN 1 ELSE 0 END AS BIGINT) AS problem_count
FROM rep r JOIN judged j USING (task_id)""")
def custom_rule(spark, sf_dir):
    long = F.when(F.col("report.slice_metadata.lines_examined") > 20, F.array(F.lit("more than 20 lines")))
    return C.with_problems(V.report_answers(spark, sf_dir), whole_slices(spark, sf_dir), long).select(
        "task_id", F.size("problems").cast("bigint").alias("problem_count")
    )


@register("outcomes", f"""WITH {OUTCOMES}
SELECT task_id, case_id, slice_id, outcome, CAST(attempts AS BIGINT) AS attempts, reason, detail,
       CASE WHEN outcome = 'failure' THEN coalesce(CAST(problem_count AS BIGINT), 0) ELSE 0 END AS validation_errors FROM outcomes""")
def outcomes_query(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "task_id", "case_id", "slice_id", "outcome", "attempts", "reason", "detail",
        F.size("validation_errors").cast("bigint").alias("validation_errors"),
    )


@register("collapse_buckets", f"""WITH {OUTCOMES}
SELECT case_id, count(*) AS tasks, count(*) AS slices_swept, CAST(1 AS BIGINT) AS iterations_used,
       count(*) FILTER (WHERE bucket = 'detailed') AS detailed, count(*) FILTER (WHERE bucket = 'empty') AS empty,
       count(*) FILTER (WHERE bucket = 'failed') AS failed, CAST(sum(stray) AS BIGINT) AS stray_hits,
       count(*) FILTER (WHERE outcome = 'report' AND relevant AND NOT has_main) AS relevant_without_findings,
       CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(matches) AS BIGINT) AS matching_lines
FROM marked GROUP BY ALL""")
def collapse_buckets(spark, sf_dir):
    return O.coverage(outcomes(spark, sf_dir))


@register("negative_checks", f"""WITH {OUTCOMES} SELECT case_id, checked_for, count(*) AS slices FROM negative GROUP BY ALL""")
def negative_checks(spark, sf_dir):
    return O.negative_checks(outcomes(spark, sf_dir)).drop("first_seen")


TOP_NEGATIVES = """
top_negative AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY slices DESC, file, pos) AS rank FROM (
    SELECT case_id, checked_for, count(*) AS slices, min(file) AS file, arg_min(pos, file || pos) AS pos FROM negative GROUP BY ALL))
  WHERE rank <= 25
)"""


@register("negative_checks_top25", f"""WITH {OUTCOMES}, {TOP_NEGATIVES.replace('GROUP BY ALL', 'GROUP BY case_id, checked_for')}
SELECT case_id, rank, checked_for, slices FROM top_negative""")
def negative_checks_top25(spark, sf_dir):
    return O.top_negatives(outcomes(spark, sf_dir))


EMPTY_40 = """
empty_40 AS (
  SELECT case_id, count(*) AS empty, string_agg(slice_id, ', ' ORDER BY rn) FILTER (WHERE rn <= 40) AS listed,
         greatest(0, count(*) - 40) AS more
  FROM (SELECT case_id, slice_id, row_number() OVER (PARTITION BY case_id ORDER BY file, slice_id) AS rn FROM marked WHERE bucket = 'empty')
  GROUP BY case_id
)"""


@register("empty_first40", f"WITH {OUTCOMES}, {EMPTY_40} SELECT case_id, empty, listed, more FROM empty_40")
def empty_first40(spark, sf_dir):
    return O.first_empty(outcomes(spark, sf_dir))


@register("collapse_text", f"""WITH {OUTCOMES}, {EMPTY_40}, {TOP_NEGATIVES.replace('GROUP BY ALL', 'GROUP BY case_id, checked_for')}
SELECT case_id, count(*) AS tasks,
  any_value(empty || ' slice(s) were read and hold nothing that bears on the alert: ' || listed
    || CASE WHEN more > 0 THEN ' … and ' || more || ' more' ELSE '' END) AS coverage, any_value(n.negatives) AS negatives
FROM marked LEFT JOIN empty_40 USING (case_id) LEFT JOIN (
  SELECT case_id, string_agg('  - ''' || checked_for || ''': absent from ' || slices || ' slice(s)', chr(10) ORDER BY rank) AS negatives
  FROM top_negative GROUP BY case_id) n USING (case_id) GROUP BY case_id""")
def collapse_text(spark, sf_dir):
    return O.coverage_text(outcomes(spark, sf_dir)).select("case_id", "tasks", "coverage", "negatives")


@register("stray_hits", f"""WITH {OUTCOMES}
SELECT case_id, slice_id, 'language ' || lang AS checked_for, 'by label' AS result FROM marked WHERE stray = 1""")
def stray_hits(spark, sf_dir):
    return O.stray_hits(outcomes(spark, sf_dir))


@register("finding_lines", f"""WITH {OUTCOMES}
SELECT case_id, slice_id, CAST(fidx AS BIGINT) AS position,
       '[' || confidence || '] ' || description || '  (' || match_count || ' matching line(s), ' || first_ref || '..' || last_ref || ') refs: '
       || array_to_string(refs, ', ') AS text
FROM outcome_findings""")
def finding_lines(spark, sf_dir):
    rows = O.finding_lines(outcomes(spark, sf_dir))
    return rows.select("case_id", "slice_id", F.col("position").cast("bigint").alias("position"), "text")


@register("failure_lines", f"""WITH {OUTCOMES}
SELECT case_id, slice_id, slice_id || ' was not examined, ' || reason || ': ' || detail AS text
FROM outcomes WHERE outcome = 'failure'""")
def failure_lines(spark, sf_dir):
    return O.failure_lines(outcomes(spark, sf_dir)).select("case_id", "slice_id", "text")


@register("failure_summary", f"""WITH {OUTCOMES}
SELECT case_id, count(*) AS failures, string_agg(DISTINCT reason, ', ' ORDER BY reason) AS failure_reasons
FROM outcomes WHERE outcome = 'failure' GROUP BY ALL""")
def failure_summary(spark, sf_dir):
    return O.failure_summary(outcomes(spark, sf_dir))


@register("ledger", f"""WITH {OUTCOMES}
SELECT task_id, case_id, CAST(0 AS BIGINT) AS iteration, slice_id, commander_intent, outcome,
       CASE WHEN outcome = 'failure' THEN reason || ': ' || detail
            ELSE CASE WHEN relevant THEN CAST(matches AS BIGINT) || ' matching line(s) in ' || findings || ' finding(s)' ELSE 'swept, nothing relevant' END
                 || ', ' || attempts || ' attempt(s)' END AS detail
FROM marked""")
def ledger(spark, sf_dir):
    return O.ledger(outcomes(spark, sf_dir)).drop("instruction")


def _states(at: str) -> str:
    return f"([{', '.join(S.text(v) for v in R.STATES)}])[{at} + 1]"


BODIES = f"""{REPORTS},
body_lines AS (SELECT rep.*, i, coalesce(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))[i],
                      'no such line') AS line
               FROM rep, unnest(range(1, d % 4 + 2)) AS u(i)),
claims AS (
  SELECT case_id, file AS investigation_id, 'timeline[' || (i - 1) || ']' AS locator, line AS description,
         CASE WHEN (d + i) % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [file || ':L' || i, file || ':L' || (i + 2)] END AS refs FROM body_lines
  UNION ALL
  SELECT case_id, file, 'hypotheses[0].supporting_evidence[0]', 'written in ' || lang, [file || ':L1'] FROM rep
  UNION ALL
  SELECT case_id, file, 'hypotheses[0].contradicting_evidence[0]', 'no second source',
         CASE WHEN d % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE [file || ':L50'] END FROM rep
)"""


@register("claims", f"""WITH {BODIES}
SELECT case_id, investigation_id, locator, description, array_to_string(refs, ' ') AS refs FROM claims""")
def claims(spark, sf_dir):
    return B.claims(V.brief_bodies(spark, sf_dir)).select(
        "case_id", "investigation_id", "locator", "description", F.array_join("raw_line_refs", " ").alias("refs")
    )


@register("uncited_claims", f"""WITH {BODIES}
SELECT case_id, investigation_id, locator || ': ' || left(description, 120) AS claim FROM claims WHERE len(refs) = 0""")
def uncited_claims(spark, sf_dir):
    return B.uncited_claims(B.claims(V.brief_bodies(spark, sf_dir)))


@register("quality_counts", f"""WITH {BODIES},
cited AS (SELECT DISTINCT case_id, investigation_id, unnest(refs) AS ref FROM claims),
bad AS (SELECT c.case_id, c.investigation_id, count(*) AS n FROM cited c JOIN docs d ON d.file = c.investigation_id
        WHERE CAST(regexp_extract(ref, ':L([0-9]+)$', 1) AS BIGINT) > d.n GROUP BY ALL),
uncited AS (SELECT case_id, investigation_id, count(*) AS n FROM claims WHERE len(refs) = 0 GROUP BY ALL)
SELECT r.case_id, r.file AS investigation_id, coalesce(bad.n, 0) AS unresolved_citations, coalesce(uncited.n, 0) AS uncited_claims,
       CAST(d % 4 + 1 AS BIGINT) AS timeline_events, CAST(1 AS BIGINT) AS hypotheses, length(text) AS narrative_chars
FROM rep r LEFT JOIN bad ON bad.investigation_id = r.file LEFT JOIN uncited ON uncited.investigation_id = r.file""")
def quality_counts(spark, sf_dir):
    return B.quality_counts(V.brief_bodies(spark, sf_dir), doc_inventory(spark, sf_dir))


@register("brief_records", f"""WITH {BODIES},
cited AS (SELECT DISTINCT case_id, investigation_id, unnest(refs) AS ref FROM claims),
bad AS (SELECT c.investigation_id, string_agg(ref, ' ' ORDER BY ref) AS refs FROM cited c JOIN docs d ON d.file = c.investigation_id
        WHERE CAST(regexp_extract(ref, ':L([0-9]+)$', 1) AS BIGINT) > d.n GROUP BY ALL),
uncited AS (SELECT investigation_id, string_agg(claim, chr(10) ORDER BY claim) AS listed FROM (
              SELECT investigation_id, locator || ': ' || left(description, 120) AS claim FROM claims WHERE len(refs) = 0) GROUP BY ALL),
steps AS (SELECT user_id, {_states('event_id % 14')} AS from_state, {_states("CAST(json_extract(props, '$.k') AS BIGINT) % 14")} AS to_state, event_id
          FROM events WHERE event_type IN ('signup', 'view') AND event_id % 50 <> 0),
ended AS (SELECT user_id, arg_max(to_state, event_id) AS state, bool_or(to_state IN ('ABORTING', 'ABORTED_BY_OPERATOR')) AS aborted FROM steps GROUP BY ALL)
SELECT r.case_id, r.file AS investigation_id, r.case_id || '-alert' AS alert_id, coalesce(state, '') AS terminal_state, coalesce(aborted, false) AS aborted_by_operator,
       coalesce(bad.refs, '') AS unresolved_citations, coalesce(uncited.listed, '') AS uncited_claims
FROM rep r LEFT JOIN bad ON bad.investigation_id = r.file LEFT JOIN uncited ON uncited.investigation_id = r.file LEFT JOIN ended ON ended.user_id = r.d""")
def brief_records(spark, sf_dir):
    bodies = V.brief_bodies(spark, sf_dir)
    cases = bodies.select("case_id").distinct().withColumn("alert_id", F.concat("case_id", F.lit("-alert")))
    states = R.final_states(V.run_log(spark, sf_dir)).withColumn(
        "investigation_id", F.concat(F.lit("doc-"), F.regexp_extract("investigation_id", r"(\d+)$", 1), F.lit(".txt"))
    )
    return B.records(cases, bodies, doc_inventory(spark, sf_dir), states).withColumns({
        "unresolved_citations": F.array_join("unresolved_citations", " "), "uncited_claims": F.array_join("uncited_claims", "\n"),
    })


REPLY = """
replies AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(body, length(body) - 1) ELSE body END AS body, event_id % 4 = 0 AS fenced FROM (
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '[' || props || ']' WHEN event_id % 5 = 0 THEN replace(props, '}', ', "extra": 1}')
                          WHEN event_id % 9 = 0 THEN '{"k": "' || event_type || '"}' WHEN event_id % 13 = 0 THEN '{}' ELSE props END AS body
    FROM events)
)"""


@register("reply_parse", f"""WITH {REPLY}
SELECT event_id, CASE WHEN NOT json_valid(body) THEN 'Response was not valid JSON. Return one JSON object and nothing else.'
  WHEN json_type(body) <> 'OBJECT' THEN 'Response must be a single JSON object, not a bare value or list.'
  ELSE concat_ws('|', CASE WHEN json_extract(body, '$.k') IS NULL THEN 'field k: Field required' END,
                 CASE WHEN json_type(body, '$.k') = 'VARCHAR' THEN 'field k: expected BIGINT' END,
                 CASE WHEN json_extract(body, '$.extra') IS NOT NULL THEN 'field extra: Extra inputs are not permitted' END) END AS problems
FROM replies""")
def reply_parse(spark, sf_dir):
    e, props = F.col("event_id"), F.col("props")
    body = (
        F.when(e % 11 == 0, F.concat(F.lit("["), props, F.lit("]")))
        .when(e % 5 == 0, F.replace(props, F.lit("}"), F.lit(', "extra": 1}')))
        .when(e % 9 == 0, F.concat(F.lit('{"k": "'), "event_type", F.lit('"}')))
        .when(e % 13 == 0, F.lit("{}"))
        .otherwise(props)
    )
    cut = F.when(e % 7 == 0, F.left(F.col("body"), F.length("body") - 1)).otherwise(F.col("body"))
    fenced = F.when(e % 4 == 0, F.concat(F.lit("\n```json\n"), "body", F.lit("\n```  \n"))).otherwise(F.col("body"))
    answers = V.table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    answers = answers.withColumn("body", cut).withColumn("body", fenced)
    return answers.select(
        "event_id", F.array_join(replies.parse_problems(F.col("body"), {"k": replies.INTEGER}), "|").alias("problems")
    )


@register("directive_problems", """
SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 5 = 0 THEN 'relevance_criteria is empty; without it workers can only match strings.' END,
       CASE WHEN doc_id % 5 = 0 AND NOT regexp_matches(text, '(?:[0-9]{1,3}\\.){3}[0-9]{1,3}') THEN 'give at least one indicator or a relevance rule.' END) AS problems
FROM documents""")
def directive_problems(spark, sf_dir):
    relevance = F.when(F.col("doc_id") % 5 == 0, F.lit(" \t ")).otherwise(F.lit("lines about it"))
    found = F.regexp_extract_all("text", F.lit(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), F.lit(0))
    problems = P.directive_problems(relevance, found)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(problems, "|").alias("problems"))


@register("split_multiline", """
SELECT doc_id, len(string_split(text, chr(10))) AS line_count, string_split(text, chr(10))[1] AS first_line,
       array_to_string(string_split(text, chr(10)), chr(10)) = text AS reversible FROM documents""")
def split_multiline(spark, sf_dir):
    parts = render.split_multiline(F.col("text"))
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(parts).cast("bigint").alias("line_count"), F.get(parts, F.lit(0)).alias("first_line"),
        (F.array_join(parts, "\n") == F.col("text")).alias("reversible"),
    )
