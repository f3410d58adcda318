"""User-level jobs made of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.functions import injection as INJ
from sweeplog.functions import lines as L
from sweeplog.operators import brief as B
from sweeplog.operators import citations as C
from sweeplog.operators import drilldown as D
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators import slices as S
from sweeplog.session import materialize


def case_preview(inventory: DataFrame) -> DataFrame:
    """What a sweep will cost, per case: files, lines, slices, average lines per slice."""
    per_case = inventory.groupBy("case_id").agg(
        F.count("*").alias("files"),
        F.sum("line_count").alias("total_lines"),
        F.sum("slice_count").alias("slices"),
    )
    average = F.floor(F.col("total_lines") / F.greatest(F.col("slices"), F.lit(1))).cast("bigint")
    return per_case.withColumn("lines_per_slice", F.greatest(F.lit(1).cast("bigint"), average))


def slice_case_logs(lines: DataFrame, files: DataFrame | None = None, **sizing) -> dict[str, DataFrame]:
    """Slices, inventory and both audits of a set of log lines."""
    built = S.build_slices(lines, files, **sizing)
    budget = sizing.get("budget", L.DEFAULT_SLICE_TOKEN_BUDGET)
    return {
        "slices": built,
        "inventory": S.file_inventory(lines, built),
        "coverage_audit": S.coverage_audit(lines, built),
        "budget_audit": S.budget_audit(lines, built, budget=budget),
    }


def sweep(lines: DataFrame, slices: DataFrame, directive: DataFrame, *, budget: int) -> DataFrame:
    """Outcome of every task: each slice of every case is read against its directive by literal match.

    Matching runs on the lines where they lie; only hits meet the slices. Directives and slices are written once, as
    several steps read them. Hits whose stamp lies outside the directive's time window are no findings, but a check that says
    where they are. `seen` has the indicators that a report speaks of; the others are absent (see `reports`). Phrases that are
    explicitly irrelevant never hide a line with an indicator, so they leave literal matches as they are (see apply_exclusions).
    """
    directive, slices = materialize(directive, "directives"), materialize(slices, "slices")
    hits = I.indicator_hits(lines, directive)
    if not directive.filter("time_window <> ''").isEmpty():
        hits = I.mark_window(hits, directive)
    found = I.findings(hits, slices, budget=budget)
    answered = I.reports(I.taskings(slices, directive), found)
    return answered.select(
        "task_id", "case_id", "iteration", "slice_id", "file", "window_index", "instruction", "commander_intent",
        F.lit("report").alias("outcome"),
        F.lit(1).cast("bigint").alias("attempts"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("detail"),
        F.array().cast("array<string>").alias("validation_errors"),
        "report", "seen",
    )


def validate_reports(answers: DataFrame, slices: DataFrame, tasks: DataFrame, *rules, compat: bool = False) -> DataFrame:
    """Outcomes of given answers: each report is held against its slice, rejected ones become failures."""
    return O.settle(tasks, C.with_problems(answers, slices, *rules), compat=compat)


def collapse(outcomes: DataFrame, directive: DataFrame | None = None) -> DataFrame:
    """One bounded row per case: counts, coverage text and counted negatives. Those of a sweep need its directive."""
    return O.coverage_text(outcomes, directive)


def drilldown(outcomes: DataFrame, slices: DataFrame, *, max_drilldowns: int = 2, max_tasks: int = D.MAX_TASKS) -> DataFrame:
    """Tasks of the next closer reads."""
    return D.taskings(D.choose(outcomes, max_drilldowns=max_drilldowns, max_tasks=max_tasks), slices, max_tasks)


def investigate(lines: DataFrame, slices: DataFrame, directive: DataFrame, *, budget: int, rounds: int = 2, max_tasks: int = D.MAX_TASKS,
                reader: Callable[..., DataFrame] = D.close_reports) -> DataFrame:
    """Outcomes of the sweep and of up to `rounds` rounds of closer reads, each chosen from the stored outcomes of those before.

    `reader(lines, tasks, directive, budget=...)` gives task_id, case_id, slice_id and a report for each task; reports are held
    against their slices like any others. The loop ends when no flagged slice is left to be read. Each round reads at most
    `max_tasks` slices of a case.
    """
    directive, slices = materialize(directive, "directives"), materialize(slices, "slices")
    outcomes = materialize(sweep(lines, slices, directive, budget=budget), "outcomes")
    for iteration in range(1, rounds + 1):
        chosen = materialize(D.choose_round(outcomes, iteration, max_tasks=max_tasks), "chosen")
        if chosen.isEmpty():
            break
        tasks = materialize(D.taskings(chosen, slices, max_tasks), "tasks")
        answers = reader(lines, tasks, directive, budget=budget).withColumn("attempts", F.lit(1).cast("bigint"))
        read = materialize(validate_reports(answers, slices, tasks), "outcomes")
        outcomes = O.all_rounds(outcomes, read)
    return outcomes


def scan_injection(lines: DataFrame) -> DataFrame:
    """Text that addresses an AI system, with the ref of its line."""
    return INJ.scan(lines.select("case_id", "file", "line_no", "text")).select(
        "case_id", L.line_ref(F.col("file"), F.col("line_no")).alias("location"), "signal", "why", "excerpt"
    )


def assemble_brief(alerts: DataFrame, outcomes: DataFrame, bodies: DataFrame, inventory: DataFrame,
                   lines: DataFrame, states: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the evidence brief: one row per case, one record per investigation, plus ledger, claims without support and flagged text.

    `states`: investigation_id, final_state, aborted_by_operator (`runstats.final_states`).
    """
    signals = scan_injection(lines)
    found = B.claims(bodies)
    briefs = materialize(B.briefs(alerts, O.coverage(outcomes), signals), "briefs")
    return {
        "briefs": briefs,
        "records": B.records(briefs, bodies, inventory, states),
        "ledger": O.ledger(outcomes),
        "uncited_claims": B.uncited_claims(found),
        "unresolved_citations": C.unresolved_refs(B.claim_refs(found), inventory),
        "quality": B.quality_counts(bodies, inventory),
        "injection_signals": signals,
    }
