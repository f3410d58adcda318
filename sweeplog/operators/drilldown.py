"""Closer reads of flagged slices: choosing them, checking a plan, and the windows around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.functions import problems as P
from sweeplog.operators import indicators as I
from sweeplog.operators import outcomes as O
from sweeplog.operators.slices import KEYS, locate
from sweeplog.schemas import CHECK_DDL, FINDING_DDL

MAX_TASKS = 4


def flagged(outcomes: DataFrame) -> DataFrame:
    """Slices with findings and their matching lines; a slice read again counts with its best round."""
    return (
        O.with_bucket(outcomes).filter(F.col("bucket") == "detailed")
        .groupBy("case_id", "slice_id", "file", "window_index")
        .agg(F.max(O.matching_lines(F.col("report"))).alias("match_count"))
    )


def choose(outcomes: DataFrame, *, max_drilldowns: int = 2, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Densest flagged slices per case, `max_tasks` per round, for `max_drilldowns` rounds."""
    order = Window.partitionBy("case_id").orderBy(F.desc("match_count"), "file", "window_index")
    ranked = flagged(outcomes).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= max_drilldowns * max_tasks).withColumn(
        "iteration", F.ceil(F.col("rank") / max_tasks).cast("bigint")
    )


def choose_round(outcomes: DataFrame, iteration: int, *, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Slices to read closely in a round, from the stored outcomes of all rounds before it.

    A flagged slice is read closely once. Neighbours of slices that the last round's closer reads confirmed come first, then the
    densest; ties by file and window.
    """
    done = outcomes.filter("iteration > 0").select("case_id", "slice_id").distinct()
    confirmed = O.with_bucket(outcomes.filter((F.col("iteration") == iteration - 1) & (F.col("iteration") > 0))).filter("bucket = 'detailed'")
    beside = F.explode(F.array(F.col("window_index") - 1, F.col("window_index") + 1)).alias("window_index")
    near = confirmed.select("case_id", "file", beside).distinct().withColumn("near", F.lit(True))
    candidates = flagged(outcomes).join(done, ["case_id", "slice_id"], "left_anti").join(near, ["case_id", "file", "window_index"], "left")
    candidates = candidates.withColumn("near", F.coalesce("near", F.lit(False)))
    order = Window.partitionBy("case_id").orderBy(F.desc("near"), F.desc("match_count"), "file", "window_index")
    ranked = candidates.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= max_tasks)
    return ranked.withColumn("iteration", F.lit(iteration).cast("bigint"))


def taskings(chosen: DataFrame, slices: DataFrame, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Plan rows joined to the slices they name; rows that name no slice drop out (see plan_problems).

    `max_tasks` is that of `choose`: tasks of a round are numbered from 0.
    """
    place = slices.select("case_id", "slice_id", "start_line", "end_line")
    return chosen.join(place, ["case_id", "slice_id"]).select(
        F.format_string("%s/i%d-t%d", "case_id", "iteration", (F.col("rank") - 1) % max_tasks).alias("task_id"),
        "case_id", "iteration", "slice_id", "file", "window_index", "start_line", "end_line",
        F.format_string("Re-read %s closely and report the detail behind the aggregate.", "slice_id").alias("instruction"),
        F.lit("Confirm the pattern that the sweep flagged.").alias("commander_intent"),
    )


def plan_problems(plan: DataFrame, slices: DataFrame, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Problems of a plan (case_id, position, slice_id, commander_intent), one row per problem text."""
    known = slices.select("case_id", "slice_id").distinct().withColumn("_known", F.lit(True))
    checked = plan.join(known, ["case_id", "slice_id"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    per_task = checked.select(
        "case_id", "position",
        F.explode(P.task_problems(F.col("position"), F.col("slice_id"), F.col("_known"), F.col("commander_intent"))).alias("problem"),
    )
    size = plan.groupBy("case_id").agg(F.count("*").alias("_n")).select(
        "case_id", F.lit(-1).cast("bigint").alias("position"), P.plan_size_problem(F.col("_n"), max_tasks).alias("problem")
    ).filter(F.col("problem").isNotNull())
    return size.unionByName(per_task)


def neighbours(chosen: DataFrame, slices: DataFrame) -> DataFrame:
    """Windows directly before and after each chosen slice in its file, by equi-join on the window number."""
    around = chosen.select(
        "case_id", "file", F.col("slice_id").alias("flagged_slice"),
        F.explode(F.array(F.col("window_index") - 1, F.col("window_index") + 1)).alias("window_index"),
    )
    return around.join(
        slices.select("case_id", "file", "window_index", "slice_id", "start_line", "end_line"),
        ["case_id", "file", "window_index"],
    )


def close_reports(lines: DataFrame, tasks: DataFrame, directive: DataFrame, *, budget: int) -> DataFrame:
    """(task_id, case_id, slice_id, report) of closer reads by literal match: a finding for each run of consecutive lines with an indicator.

    Only lines of the tasks' slices are matched. A hit outside the directive's time window ends a run and is no finding.
    """
    place = tasks.select(*KEYS, "start_line", "end_line", "task_id", "slice_id", "window_index")
    read = locate(lines.select(*KEYS, "line_no", "text"), place, budget=budget, columns=("slice_id",)).drop("slice_id")
    hits = I.mark_window(I.indicator_hits(read, directive), directive)
    placed = locate(hits, place, budget=budget, columns=("task_id",))
    inside = placed.filter("in_window")
    order = Window.partitionBy("task_id", "indicator").orderBy("line_no")  # at most the lines of a slice
    runs = inside.withColumn("_run", F.col("line_no") - F.row_number().over(order)).groupBy("task_id", *KEYS, "indicator", "_run").agg(
        F.count("*").alias("match_count"), F.min("line_no").alias("_first"), F.max("line_no").alias("_last")
    )
    ref = lambda c: L.line_ref(F.col("file"), c)
    cited = F.sequence(F.col("_first"), F.least(F.col("_last"), F.col("_first") + (P.MAX_REPRESENTATIVE_REFS - 1)))
    finding = F.struct(
        F.concat(F.lit("consecutive lines that contain "), L.quoted(F.col("indicator"))).alias("description"), "match_count",
        F.transform(cited, ref).alias("representative_refs"), ref(F.col("_first")).alias("first_ref"), ref(F.col("_last")).alias("last_ref"),
        F.lit("high").alias("confidence"),
    )
    listed = runs.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("_first", "indicator", finding.alias("finding")))).alias("_runs"))
    check = F.struct(
        F.col("indicator").alias("checked_for"), F.lit(False).alias("found"),
        F.concat(F.lit(I.OUTSIDE), F.col("_n").cast("string"), F.lit(" line(s)")).alias("result"),
    )
    beyond = placed.groupBy("task_id", "indicator").agg(F.count("*").alias("_n"), F.bool_or("in_window").alias("_in")).filter("NOT _in")
    checks = beyond.groupBy("task_id").agg(F.array_sort(F.collect_list(check)).alias("_checks"))
    joined = tasks.join(listed, "task_id", "left").join(checks, "task_id", "left")
    found = F.coalesce(F.transform("_runs", lambda r: r["finding"]), F.array().cast(f"array<{FINDING_DDL}>"))
    report = F.struct(
        F.struct("slice_id", "file", (F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("lines_examined")).alias("slice_metadata"),
        (F.size(found) > 0).alias("relevant"), found.alias("findings"),
        F.coalesce("_checks", F.array().cast(f"array<{CHECK_DDL}>")).alias("checked_for"),
    )
    return joined.select("task_id", "case_id", "slice_id", report.alias("report"))
