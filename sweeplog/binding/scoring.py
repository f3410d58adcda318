"""Replies of readers, judged, and a sweep by a reader of our own, over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.binding.reporting import REPORTS, whole_slices
from sweeplog.binding.slicing import DOC_BUDGET
from sweeplog.binding.sweeping import SWEPT
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators import scorer as SC


@register("judged_replies", f"""WITH {REPORTS}
SELECT r.task_id, CASE d % 8
    WHEN 1 THEN 'field relevant: expected BOOLEAN'
    WHEN 2 THEN 'field verdict: Extra inputs are not permitted'
    WHEN 3 THEN 'Your reply was cut off at the token limit (900 tokens); report an aggregate with few representative_refs.|'
                || 'Response was not valid JSON. Return one JSON object and nothing else.'
    ELSE coalesce(j.problems, '') END AS problems,
  d % 8 NOT IN (1, 2, 3) AS parsed, CASE WHEN d % 8 NOT IN (1, 2, 3) THEN coalesce(f.n, 0) END AS findings
FROM rep r JOIN judged j USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n FROM rep_findings GROUP BY ALL) f USING (task_id)""")
def judged_replies(spark, sf_dir):
    kind = F.col("doc_id") % 8
    plain = F.to_json("report")
    reply = (
        F.when(kind == 1, F.regexp_replace(plain, '"relevant":(true|false)', '"relevant":"yes"'))
        .when(kind == 2, F.concat(F.lit('{"verdict":"x",'), F.substring(plain, 2, 1 << 30)))
        .when(kind == 3, F.left(plain, F.length(plain) - 10))
        .when(kind == 4, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .otherwise(plain)
    )
    cut = kind == 3
    answers = V.report_answers(spark, sf_dir).select(
        "task_id", "case_id", "slice_id", reply.alias("reply"),
        F.when(cut, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
        F.when(cut, F.lit(900)).cast("bigint").alias("completion_tokens"),
    )
    judged = SC.judge(answers, whole_slices(spark, sf_dir))
    return judged.select(
        "task_id", F.array_join("problems", "|").alias("problems"), F.col("report").isNotNull().alias("parsed"),
        F.when(F.col("report").isNotNull(), F.size("report.findings")).cast("bigint").alias("findings"),
    )


def literal_reader(lines, task: dict, feedback: list[str]) -> str:
    """Reads a slice for the literal indicators. On every fifth window its first answer cites a line that is not there."""
    found, checks = [], []
    rows = lines.to_numpy().tolist()  # ref, text: one array is taken from a small frame in a third of the time of two columns
    for indicator in sorted(task["indicators"]):
        refs = [ref for ref, text in rows if indicator in text]
        if refs:
            cited = refs[:5] if feedback or task["window_index"] % 5 else ["nowhere.txt:L1"]
            found.append({"description": f"lines that contain '{indicator}'", "match_count": len(refs), "representative_refs": cited,
                          "first_ref": refs[0], "last_ref": refs[-1], "confidence": "high"})
        else:
            checks.append({"checked_for": indicator, "found": False, "result": "not seen"})
    return json.dumps({
        "slice_metadata": {"slice_id": task["slice_id"], "file": task["file"], "lines_examined": len(lines)},
        "relevant": bool(found), "findings": found, "checked_for": checks,
    })


@register("scored_sweep", f"""WITH RECURSIVE {SWEPT}
SELECT case_id, slice_id, 'report' AS outcome, CASE WHEN findings > 0 AND window_index % 5 = 0 THEN 2 ELSE 1 END AS attempts,
       CAST(findings AS BIGINT) AS findings, matches AS matching_lines, CAST(len(indicators) - findings AS BIGINT) AS not_seen FROM swept""")
def scored_sweep(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir).drop("doc_id")
    outcomes = SC.sweep_with_scorer(
        lines, V.doc_slices(spark, sf_dir, DOC_BUDGET), I.directives(V.alerts(spark, sf_dir)), literal_reader, budget=DOC_BUDGET
    )
    report = F.col("report")
    return outcomes.select(
        "case_id", "slice_id", "outcome", "attempts", F.size(report["findings"]).cast("bigint").alias("findings"),
        O.matching_lines(report).alias("matching_lines"), F.size(report["checked_for"]).cast("bigint").alias("not_seen"),
    )
