"""A user's own reader in place of literal matching, with validation, one retry and failure rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog import schemas
from sweeplog.functions import problems as P
from sweeplog.functions import replies
from sweeplog.operators import citations as C
from sweeplog.operators import outcomes as O
from sweeplog.operators.indicators import taskings
from sweeplog.operators.slices import KEYS, slice_lines
from sweeplog.session import BROADCAST_LIMIT_BYTES, estimated_bytes, materialize

# (lines with ref and text, task fields, problems of the attempt before) -> reply text, or a dict with reply,
# finish_reason and completion_tokens.
Scorer = Callable[[pd.DataFrame, dict, list[str]], "str | dict"]

_ANSWER = "case_id string, slice_id string, reply string, finish_reason string, completion_tokens bigint, error string"
# What goes with an answer from its task, so that nobody has to join it again.
_PLACE = "task_id string, file string, start_line bigint, end_line bigint"


def score(shown: DataFrame, scorer: Scorer, concurrency: int | None = None) -> DataFrame:
    """One answer per task, with the task's id, file and lines. `shown` has one row per task: its fields, `refs` and `texts` of its lines,
    and `feedback`.

    A slice is bounded by its token budget, so a row is small. An exception of the scorer, or an answer of another form,
    becomes an answer with `error`.
    `concurrency` bounds the tasks that run at once.
    """

    def answer(lines: pd.DataFrame, fields: dict, feedback: list[str]) -> tuple:
        try:
            given = scorer(lines, fields, feedback)
            if isinstance(given, str):
                return given, "stop", None, None
            tokens = given.get("completion_tokens")
            return given["reply"], given.get("finish_reason"), None if tokens is None else int(tokens), None
        except Exception as exc:  # noqa: BLE001 - a failing reader is a row, not a failed job
            return None, None, None, f"{type(exc).__name__}: {exc}"

    def shown_lines(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Each task's lines as a frame of its own, over its rows of one array of the batch: making one from lists costs five times as much."""
        whole = np.empty((int(batch["refs"].map(len).sum()), 2), object)
        for k, column in enumerate(("refs", "texts")):
            whole[:, k] = np.concatenate([np.empty(0, object), *batch[column]])
        names = pd.Index(["ref", "text"])
        ends = batch["refs"].map(len).cumsum()
        for start, end in zip([0, *ends], ends):
            yield pd.DataFrame(whole[start:end], columns=names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = batch.drop(columns=["refs", "texts", "feedback"]).to_dict("records")
            rows = [
                (task["case_id"], task["slice_id"], *answer(lines, task, list(feedback)))
                for task, lines, feedback in zip(plain, shown_lines(batch), batch["feedback"])
            ]
            answers = pd.DataFrame(
                rows, columns=["case_id", "slice_id", "reply", "finish_reason", "completion_tokens", "error"]
            ).astype({"completion_tokens": "Int64"})
            yield answers.assign(**{name: batch[name] for name in ("task_id", "file", "start_line", "end_line")})

    placed = shown.repartition(concurrency, "case_id", "slice_id") if concurrency else shown
    return placed.mapInPandas(run, f"{_ANSWER}, {_PLACE}")


def judge(answers: DataFrame, slices: DataFrame | None, *rules) -> DataFrame:
    """Parse replies and hold them against their slices (None: the answers hold file and lines, as those of `score` do): adds report
    (null when unusable) and problems."""
    cut = P.truncation_problems(F.col("finish_reason"), F.col("completion_tokens"))
    read = answers.withColumn("_read", replies.read_report(F.col("reply"), schemas.REPORT_DDL))
    none = F.array(F.lit("Response was not valid JSON. No reply."))
    broken = read.withColumns({"_parse": F.coalesce("_read.problems", none), "report": F.col("_read.report")}).drop("_read")
    checked = C.with_problems(broken, slices, *rules)
    unparsed = F.size("_parse") > 0
    cut_texts = F.coalesce(cut, F.array().cast("array<string>"))
    return checked.withColumn(
        "problems", F.when(unparsed, F.concat(cut_texts, "_parse")).otherwise(F.col("problems"))
    ).drop("_parse")


def sweep_with_scorer(lines: DataFrame, slices: DataFrame, directive: DataFrame, scorer: Scorer, *, budget: int,
                      max_retries: int = 1, concurrency: int | None = None, rules: tuple = (), compat: bool = False) -> DataFrame:
    """Outcomes of a sweep by a user's reader.

    Each round scores the open tasks and writes the answers. Rejected ones go to the next round with their problems;
    a reader that raises is not asked again. The number of rounds is fixed by `max_retries`.
    """
    keys = ["case_id", "slice_id"]

    def of_open_files(open_tasks: DataFrame) -> DataFrame:
        # What was rejected lies in few files mostly; lines of others are left out where they are read.
        files = materialize(open_tasks.select(*KEYS).distinct(), "open-files")
        return lines.join(F.broadcast(files), KEYS, "left_semi") if estimated_bytes(files) <= BROADCAST_LIMIT_BYTES else lines

    def with_lines(open_tasks: DataFrame, lines: DataFrame) -> DataFrame:
        # Only slices that are still open meet the lines; a task holds the place of its slice.
        contents = slice_lines(lines, open_tasks, budget=budget).select(
            *keys,
            F.transform("lines", lambda r: r["ref"]).alias("refs"),
            F.transform("lines", lambda r: r["text"]).alias("texts"),
        )
        none = F.array().cast("array<string>")
        return open_tasks.join(contents, keys, "left").withColumn("refs", F.coalesce("refs", none)).withColumn(
            "texts", F.coalesce("texts", none)
        )

    tasks = materialize(taskings(slices, directive, 0, "indicators"), "taskings")
    open_tasks = tasks.withColumn("feedback", F.array().cast("array<string>"))
    settled = []
    for attempt in range(1, max_retries + 2):
        answers = materialize(
            judge(score(with_lines(open_tasks, lines if attempt == 1 else of_open_files(open_tasks)), scorer, concurrency), None, *rules).withColumn(
                "attempts", F.lit(attempt).cast("bigint")
            ),
            f"answers-{attempt}",
        )
        done = (F.size("problems") == 0) | F.col("error").isNotNull()
        final = answers if attempt == max_retries + 1 else answers.filter(done)
        settled.append(final.select("task_id", "attempts", "report", "problems", "error"))
        if attempt <= max_retries:
            again = answers.filter(~done).select("case_id", "slice_id", F.col("problems").alias("feedback"))
            open_tasks = tasks.join(again, ["case_id", "slice_id"])
    answered = settled[0]
    for more in settled[1:]:
        answered = answered.unionByName(more)
    outcomes = O.settle(tasks, answered, compat=compat)
    errors = answered.filter("error IS NOT NULL").select("task_id", F.col("error").alias("_error"))
    failed = F.col("_error").isNotNull()
    return outcomes.join(errors, "task_id", "left").select(
        *[c for c in outcomes.columns if c not in ("reason", "detail", "validation_errors")],
        F.when(failed, F.lit("transport")).otherwise(F.col("reason")).alias("reason"),
        F.when(failed, F.col("_error")).otherwise(F.col("detail")).alias("detail"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.col("validation_errors")).alias("validation_errors"),
    )
