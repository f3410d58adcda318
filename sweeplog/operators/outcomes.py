"""Tasks to outcomes, outcomes to coverage, negatives, failures and the task ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.functions import problems as P
from sweeplog.operators.indicators import OUTSIDE

TOP_NEGATIVES = 25
LISTED_EMPTY = 40
FAILURE_REASONS = ("timeout", "transport", "schema", "citations", "internal", "aborted", "truncated")
_TASK = ["task_id", "case_id", "iteration", "slice_id", "file", "window_index", "instruction", "commander_intent"]


def settle(tasks: DataFrame, answers: DataFrame, *, missing: str = "timeout",
           missing_detail: str = "no answer was collected", compat: bool = False) -> DataFrame:
    """One outcome per task. `answers` has task_id, attempts, report, problems; finished work is always kept.

    An answer with problems is a failure with its reason; a task without an answer fails as `missing`. An answer row
    without attempts may carry a `reason` (timeout, internal, aborted, ...) that says why its task has none.
    """
    given = F.col("reason") if "reason" in answers.columns else F.lit(None).cast("string")
    answers = answers.select("task_id", "attempts", "report", "problems", given.alias("_reason"))
    joined = tasks.select(*_TASK).join(answers, "task_id", "left")
    answered = F.col("attempts").isNotNull()
    accepted = answered & (F.size("problems") == 0) & F.col("report").isNotNull()
    rejected = answered & ~accepted
    return joined.select(
        *_TASK,
        F.when(accepted, F.lit("report")).otherwise(F.lit("failure")).alias("outcome"),
        F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"),
        F.when(rejected, P.failure_reason(F.col("problems"), compat)).when(~answered, F.coalesce("_reason", F.lit(missing))).alias("reason"),
        F.when(rejected, F.format_string("report rejected after %d attempt(s)", "attempts"))
        .when(~answered, F.lit(missing_detail))
        .alias("detail"),
        F.when(rejected, F.col("problems")).otherwise(F.array().cast("array<string>")).alias("validation_errors"),
        F.when(accepted, F.col("report")).alias("report"),
    )


def all_rounds(*rounds: DataFrame) -> DataFrame:
    """Bag union of the outcomes of every round; a slice read twice stays twice."""
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def matching_lines(report: Column) -> Column:
    return F.aggregate(report["findings"], F.lit(0).cast("bigint"), lambda n, f: n + f["match_count"])


def _bucket() -> Column:
    detailed = F.col("report.relevant") & (F.size("report.findings") > 0)
    return (
        F.when(F.col("outcome") == "failure", F.lit("failed")).when(detailed, F.lit("detailed")).otherwise(F.lit("empty"))
    )


def with_bucket(outcomes: DataFrame) -> DataFrame:
    """detailed, empty or failed, plus the number of positive checks a report carries."""
    stray = F.size(F.filter(F.col("report.checked_for"), lambda c: c["found"]))
    return outcomes.withColumn("bucket", _bucket()).withColumn(
        "stray_hits", F.when(F.col("report").isNotNull(), stray).otherwise(F.lit(0)).cast("bigint")
    )


def coverage(outcomes: DataFrame) -> DataFrame:
    """Counts per case. Positives and negatives stay in separate columns."""
    marked = with_bucket(outcomes)
    hollow = F.col("report.relevant") & (F.size("report.findings") == 0)
    return marked.groupBy("case_id").agg(
        F.count("*").alias("tasks"),
        # Closer reads are later iterations; only the first pass counts as swept.
        F.count_if(F.col("iteration") == 0).alias("slices_swept"),
        (F.max("iteration") + 1).alias("iterations_used"),
        F.count_if(F.col("bucket") == "detailed").alias("detailed"),
        F.count_if(F.col("bucket") == "empty").alias("empty"),
        F.count_if(F.col("bucket") == "failed").alias("failed"),
        F.sum("stray_hits").alias("stray_hits"),
        F.count_if(F.coalesce(hollow, F.lit(False))).alias("relevant_without_findings"),
        F.coalesce(F.sum(F.size("report.findings")), F.lit(0)).alias("findings"),
        F.coalesce(F.sum(matching_lines(F.col("report"))), F.lit(0)).alias("matching_lines"),
    )


def negative_checks(outcomes: DataFrame) -> DataFrame:
    """Subjects looked for and not found: how often per case, and where the subject came up first."""
    checks = outcomes.filter(F.col("report").isNotNull()).select(
        "case_id", "file", "window_index", F.posexplode("report.checked_for").alias("_pos", "_check")
    )
    return (
        checks.filter(~F.col("_check.found") & ~_outside(F.col("_check")))
        .groupBy("case_id", F.col("_check.checked_for").alias("checked_for"))
        .agg(F.count("*").alias("slices"), F.min(F.struct("file", "window_index", "_pos")).alias("first_seen"))
    )


def _outside(check: Column) -> Column:
    return F.coalesce(F.startswith(check["result"], F.lit(OUTSIDE)), F.lit(False))


def negatives_by_difference(outcomes: DataFrame, directive: DataFrame) -> DataFrame:
    """Negative checks of a sweep: per case and indicator the slices that were read and do not have it in any of their lines.

    The slices of a case less those whose report speaks of the indicator, be it as found or as outside the time window. What is sent grows
    with slices and findings, not with their product with the indicators. Equal counts are in the directive's order.
    """
    read = outcomes.filter(F.col("report").isNotNull())
    slices = read.groupBy("case_id").agg(F.count("*").alias("_read"))
    seen = read.select("case_id", F.explode("seen").alias("checked_for")).groupBy("case_id", "checked_for").agg(F.count("*").alias("_seen"))
    listed = directive.select("case_id", F.posexplode(F.array_distinct("indicators")).alias("_pos", "checked_for")).filter("checked_for <> ''")
    left = (F.col("_read") - F.coalesce("_seen", F.lit(0))).alias("slices")
    position = F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("window_index"), F.col("_pos")).alias("first_seen")
    return listed.join(slices, "case_id").join(seen, ["case_id", "checked_for"], "left").select("case_id", "checked_for", left, position).filter("slices > 0")


def seen_outside(outcomes: DataFrame) -> DataFrame:
    """Per case and subject the slices that hold it only outside the time window: ground that is neither found nor clear."""
    checks = outcomes.filter(F.col("report").isNotNull()).select("case_id", F.explode("report.checked_for").alias("_check"))
    return checks.filter(_outside(F.col("_check"))).groupBy("case_id", F.col("_check.checked_for").alias("checked_for")).agg(F.count("*").alias("slices"))


def top_negatives(outcomes: DataFrame, limit: int = TOP_NEGATIVES, directive: DataFrame | None = None) -> DataFrame:
    """The most frequent negatives per case, ties by first occurrence. Other subjects stay in negative_checks.

    With a directive those of a sweep, whose reports leave them out.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc("slices"), F.asc("first_seen"))
    return (
        (negative_checks(outcomes) if directive is None else negatives_by_difference(outcomes, directive))
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= limit)
        .select("case_id", "rank", "checked_for", "slices")
    )


def first_empty(outcomes: DataFrame, limit: int = LISTED_EMPTY) -> DataFrame:
    """Per case: number of slices with nothing relevant, the first `limit` ids, and how many more there are."""
    empty = with_bucket(outcomes).filter(F.col("bucket") == "empty").select("case_id", "file", "window_index", "slice_id")
    order = Window.partitionBy("case_id").orderBy("file", "window_index", "slice_id")
    shown = empty.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    listed = shown.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "slice_id"))), lambda r: r["slice_id"]).alias("listed")
    )
    totals = empty.groupBy("case_id").agg(F.count("*").alias("empty"))
    return totals.join(listed, "case_id").select(
        "case_id", "empty", F.array_join("listed", ", ").alias("listed"),
        F.greatest(F.lit(0).cast("bigint"), F.col("empty") - limit).alias("more"),
    )


def stray_hits(outcomes: DataFrame) -> DataFrame:
    """Positive results that were written as checks, one row each."""
    return (
        outcomes.filter(F.col("report").isNotNull())
        .select("case_id", "slice_id", F.explode("report.checked_for").alias("_c"))
        .filter("_c.found")
        .select("case_id", "slice_id", F.col("_c.checked_for").alias("checked_for"), F.col("_c.result").alias("result"))
    )


def finding_lines(outcomes: DataFrame) -> DataFrame:
    """One row of text per finding of the detailed slices, in (file, window_index, position) order."""
    rows = with_bucket(outcomes).filter(F.col("bucket") == "detailed").select(
        "case_id", "file", "window_index", "slice_id", F.posexplode("report.findings").alias("position", "f")
    )
    text = F.format_string(
        "[%s] %s  (%d matching line(s), %s..%s) refs: %s",
        "f.confidence", "f.description", "f.match_count", "f.first_ref", "f.last_ref",
        F.array_join("f.representative_refs", ", "),
    )
    return rows.select("case_id", "file", "window_index", "slice_id", "position", text.alias("text"))


def failure_lines(outcomes: DataFrame) -> DataFrame:
    text = F.format_string("%s was not examined, %s: %s", "slice_id", "reason", "detail")
    return outcomes.filter(F.col("outcome") == "failure").select("case_id", "file", "window_index", "slice_id", text.alias("text"))


def coverage_text(outcomes: DataFrame, directive: DataFrame | None = None) -> DataFrame:
    """The bounded part of a case summary as text: coverage line and counted negatives.

    Findings, failures and stray hits keep one row each (finding_lines, failure_lines, stray_hits), so a case with
    millions of them is never joined into one string.
    """
    empty = first_empty(outcomes)
    more = F.when(F.col("more") > 0, F.format_string(" … and %d more", "more")).otherwise(F.lit(""))
    cover = empty.select(
        "case_id",
        F.concat(
            F.format_string("%d slice(s) were read and hold nothing that bears on the alert: ", "empty"),
            F.col("listed"), more,
        ).alias("coverage"),
    )
    line = F.concat(F.lit("  - "), L.quoted(F.col("checked_for")),
                    F.format_string(": absent from %d slice(s)", "slices"))
    negatives = (
        top_negatives(outcomes, directive=directive).withColumn("_line", line).groupBy("case_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda r: r["_line"]).alias("_lines"))
        .select("case_id", F.array_join("_lines", "\n").alias("negatives"))
    )
    return coverage(outcomes).join(cover, "case_id", "left").join(negatives, "case_id", "left")


def ledger(outcomes: DataFrame) -> DataFrame:
    """Audit row per task, failed ones included."""
    seen = F.format_string(
        "%d matching line(s) in %d finding(s)", matching_lines(F.col("report")), F.size("report.findings")
    )
    swept = F.when(F.col("report.relevant"), seen).otherwise(F.lit("swept, nothing relevant"))
    detail = F.when(
        F.col("outcome") == "failure", F.concat("reason", F.lit(": "), "detail")
    ).otherwise(F.concat(swept, F.format_string(", %d attempt(s)", "attempts")))
    return outcomes.select(
        "task_id", "case_id", "iteration", "slice_id", "instruction", "commander_intent", "outcome", detail.alias("detail")
    )


def failure_summary(outcomes: DataFrame) -> DataFrame:
    """Failures per case and their distinct reasons (a closed list of seven), sorted."""
    return outcomes.filter(F.col("outcome") == "failure").groupBy("case_id").agg(
        F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("failure_reasons")
    )
