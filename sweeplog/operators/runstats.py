"""Statistics of runs from their event logs, metric counters and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.functions import problems as P
from sweeplog.operators.ordered import with_previous
from sweeplog.operators.quantiles import exact_total, latency_spread
from sweeplog.session import materialize

RUN = "investigation_id"
EVENTS_PER_BUCKET = 1_000_000
WORKER = "grunt"
SWEEP_STATE = "COLLECTING"
REAL_BACKEND = "vllm"
DEFAULT_SECONDS_PER_SLICE = 180.0

# States of a run and the transitions it may make.
STATES = (
    "RECEIVED", "TASKING", "SWEEPING", "PLANNING", "DISPATCHED", "COLLECTING", "ABORTED_ITERATION_CAP", "ABORTING",
    "SYNTHESIZING", "DONE", "FAILED_PREFLIGHT", "FAILED_PLANNING", "FAILED_SYNTHESIS", "ABORTED_BY_OPERATOR",
)
LEGAL_TRANSITIONS = {
    "RECEIVED": ("TASKING", "FAILED_PREFLIGHT", "ABORTED_BY_OPERATOR"),
    "TASKING": ("SWEEPING", "FAILED_PLANNING", "ABORTING", "ABORTED_BY_OPERATOR"),
    "SWEEPING": ("COLLECTING",),
    "PLANNING": ("DISPATCHED", "SYNTHESIZING", "FAILED_PLANNING", "ABORTING", "ABORTED_BY_OPERATOR"),
    "DISPATCHED": ("COLLECTING",),
    "COLLECTING": ("PLANNING", "SYNTHESIZING", "ABORTED_ITERATION_CAP", "ABORTING", "ABORTED_BY_OPERATOR"),
    "ABORTED_ITERATION_CAP": ("SYNTHESIZING",),
    "ABORTING": ("SYNTHESIZING",),
    "SYNTHESIZING": ("DONE", "FAILED_SYNTHESIS"),
}
TERMINAL_STATES = ("DONE", "FAILED_PREFLIGHT", "FAILED_PLANNING", "FAILED_SYNTHESIS", "ABORTED_BY_OPERATOR")


STATS_FIELDS = (
    RUN, "event_id", "ts", "kind", "from_state", "to_state", "role", "task_id", "attempt", "finish_reason", "usage",
    "latency_ms", "error", "payload",
)


QUALITY_FIELDS = ("slices_swept", "unresolved_citations", "uncited_claims", "timeline_events", "hypotheses", "narrative_chars")


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join of two sides that have a row for each run, role or task. Both grow with the runs, so none is broadcast."""
    return left.join(right.hint("merge"), on, "left")


def instant(ts: str = "ts"):
    return F.try_to_timestamp(F.col(ts))


def calls(log: DataFrame) -> DataFrame:
    """Model calls with role and latency in seconds; an absent role is `unknown`, an absent latency 0."""
    return log.filter("kind = 'llm_call'").withColumn("role", F.coalesce("role", F.lit("unknown"))).withColumn(
        "latency_s", F.coalesce("latency_ms", F.lit(0.0)) / 1000
    )


def role_counts(log: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    failed = F.coalesce("error", F.lit("")) != ""
    return calls(log).groupBy(RUN, "role").agg(
        F.count("*").alias("calls"),
        F.count_if(F.coalesce("attempt", F.lit(1)) > 1).alias("retries"),
        F.count_if(failed).alias("errors"),
        F.sum(F.coalesce("usage.prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("usage.completion_tokens", zero)).alias("completion_tokens"),
    )


def role_latency(log: DataFrame) -> DataFrame:
    return latency_spread(calls(log).select(RUN, "role", "latency_s"), [RUN, "role"], "latency_s")


def truncation_split(log: DataFrame) -> DataFrame:
    """Latency of calls cut at the token limit against the rest, per role over all runs."""
    marked = calls(log).withColumn("truncated", F.coalesce(F.col("finish_reason") == "length", F.lit(False)))
    return latency_spread(marked.select("role", "truncated", "latency_s"), ["role", "truncated"], "latency_s")


def final_attempts(log: DataFrame) -> DataFrame:
    """Last attempt of every task: how many, and whether it ended in an error."""
    tried = calls(log).filter(F.col("task_id").isNotNull()).withColumn("attempt", F.coalesce("attempt", F.lit(1)))
    order = F.struct("attempt", "event_id")
    return tried.groupBy(RUN, "task_id").agg(
        F.max("attempt").alias("attempts"),
        F.max_by("event_id", order).alias("last_event_id"),
        (F.max_by(F.coalesce("error", F.lit("")), order) == "").alias("succeeded"),
    )


def validations(log: DataFrame) -> DataFrame:
    """Checked reports per run; one without a verdict counts as rejected."""
    checked = log.filter("kind = 'grunt_validation'")
    counts = checked.groupBy(RUN).agg(
        F.count("*").alias("validations"), F.count_if(~F.coalesce("payload.ok", F.lit(False))).alias("rejections")
    )
    return counts.withColumn("rejection_rate", F.try_divide(F.col("rejections"), F.col("validations")))


def rejection_reasons(log: DataFrame) -> DataFrame:
    """Rejected reports per reason; a report counts once per distinct reason."""
    rejected = log.filter("kind = 'grunt_validation' AND NOT coalesce(payload.ok, false)")
    return (
        rejected.select(RUN, F.explode(P.rejection_reasons(F.col("payload.problems"))).alias("reason"))
        .groupBy(RUN, "reason").agg(F.count("*").alias("reports"))
    )


def transitions(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'state_transition'")


def phase_gaps(log: DataFrame) -> DataFrame:
    """Microseconds between consecutive transitions of a run, charged to the state entered by the earlier one."""
    timed = transitions(log).withColumn("_at", F.unix_micros(instant())).filter("_at IS NOT NULL")
    timed = materialize(timed.select(RUN, "event_id", "to_state", "_at"), "transitions").withColumn(
        "_bucket", F.floor(F.col("event_id") / EVENTS_PER_BUCKET).cast("bigint")
    )
    linked = with_previous(timed, [RUN], ["event_id"], ["to_state", "_at"])
    return linked.filter(F.col("previous__at").isNotNull()).select(
        RUN, F.col("previous_to_state").alias("state"), (F.col("_at") - F.col("previous__at")).alias("micros")
    )


def phase_durations(log: DataFrame) -> DataFrame:
    return phase_gaps(log).groupBy(RUN, "state").agg((F.sum("micros") / F.lit(1e6)).alias("seconds"))


def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Phases or reasons of each run with their rank, the largest first, ties by name. A run has at most 14 or 8 of them."""
    order = Window.partitionBy(RUN).orderBy(F.desc(value), F.asc(name))
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Transitions outside the legal table, counted per run and pair; one with a missing state is outside."""
    legal = [f"{a}>{b}" for a, targets in LEGAL_TRANSITIONS.items() for b in targets]
    pair = F.concat_ws(">", F.coalesce("from_state", F.lit("")), F.coalesce("to_state", F.lit("")))
    return (
        transitions(log).filter(~pair.isin(*legal))
        .groupBy(RUN, "from_state", "to_state").agg(F.count("*").alias("occurrences"))
    )


def final_states(log: DataFrame) -> DataFrame:
    """Last state entered by each run, whether it is terminal, and whether an operator aborted the run."""
    steps = transitions(log)
    return steps.groupBy(RUN).agg(
        F.max_by("to_state", "event_id").alias("final_state"),
        F.bool_or(F.col("to_state").isin("ABORTING", "ABORTED_BY_OPERATOR")).alias("aborted_by_operator"),
        F.count("*").alias("transitions"),
    ).withColumn("terminal", F.col("final_state").isin(*TERMINAL_STATES))


def truncated_calls(log: DataFrame) -> DataFrame:
    """Calls whose reply was cut at the token limit, with the problem that names the cause."""
    texts = P.truncation_problems(F.col("finish_reason"), F.col("usage.completion_tokens"))
    return calls(log).select(RUN, "event_id", "task_id", F.explode(texts).alias("problem"))


def parallelism(log: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """Worker seconds over seconds spent collecting; null when nothing was collected. `phases`: phase_durations of the log, where known."""
    worked = calls(log).filter(F.col("role") == WORKER).groupBy(RUN).agg(
        exact_total("latency_s").alias("worker_s")
    )
    phases = phase_durations(log) if phases is None else phases
    collecting = phases.filter(F.col("state") == SWEEP_STATE).select(RUN, F.col("seconds").alias("collecting_s"))
    return joined(worked, collecting, [RUN]).withColumn(
        "effective_parallelism", F.try_divide(F.col("worker_s"), F.col("collecting_s"))
    )


def wall_clock(log: DataFrame) -> DataFrame:
    """Seconds between the first and the last event of a run that has a time."""
    micros = F.unix_micros(instant())
    return log.groupBy(RUN).agg(((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("wall_clock_s"))


def work_totals(log: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files, lines, slices and calls per run. `inventory` has investigation_id, line_count, slice_count."""
    read = inventory.groupBy(RUN).agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines_swept"), F.sum("slice_count").alias("slices")
    )
    called = calls(log).groupBy(RUN).agg(F.count("*").alias("llm_calls"))
    zero = F.lit(0).cast("bigint")
    return joined(read, called, [RUN]).withColumn("llm_calls", F.coalesce("llm_calls", zero))


def metric_delta(samples: DataFrame) -> DataFrame:
    """Counters of a run as end minus start, with ratios that are null on a zero denominator.

    `samples`: investigation_id, role, snapshot (before/after), metric, value. A missing start counts as 0, a role
    without an end is left out.
    """
    by = [RUN, "role", "metric"]
    after = samples.filter("snapshot = 'after'").select(*by, "value")
    before = samples.filter("snapshot = 'before'").select(*by, F.col("value").alias("_start"))
    delta = joined(after, before, by).withColumn("_delta", F.col("value") - F.coalesce("_start", F.lit(0.0)))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == f"vllm:{name}", F.col("_delta"))), F.lit(0.0))
    totals = delta.groupBy(RUN, "role").agg(
        of("request_success_total").cast("bigint").alias("requests"),
        of("prompt_tokens_total").cast("bigint").alias("prompt_tokens"),
        of("generation_tokens_total").cast("bigint").alias("generation_tokens"),
        of("prefix_cache_hits_total").alias("_hits"),
        of("prefix_cache_queries_total").alias("_queries"),
        of("e2e_request_latency_seconds_sum").alias("_e2e_s"),
        of("e2e_request_latency_seconds_count").alias("_e2e_n"),
        of("time_to_first_token_seconds_sum").alias("_first_s"),
        of("time_to_first_token_seconds_count").alias("_first_n"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return totals.select(
        RUN, "role", "requests", "prompt_tokens", "generation_tokens",
        ratio("_hits", "_queries").alias("prefix_cache_hit_rate"),
        ratio("_e2e_s", "_e2e_n").alias("mean_e2e_latency_s"),
        ratio("_first_s", "_first_n").alias("mean_time_to_first_token_s"),
    )


def sample_spread(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, peak and minimum; keys without a value do not appear."""
    total = exact_total(value)
    return samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("samples"), (total / F.count("*")).alias("mean"), F.max(value).alias("peak"), F.min(value).alias("min")
    )


def history_rows(stats: DataFrame) -> DataFrame:
    """What the estimate needs from stored run statistics."""
    return stats.select(
        RUN, "backend",
        F.try_element_at("roles", F.lit(WORKER))["calls"].alias("worker_calls"),
        F.col("work.slices").alias("slices"),
        F.try_element_at("time.by_phase_s", F.lit(SWEEP_STATE)).alias("collecting_s"),
        F.col("concurrency_configured").cast("double").alias("concurrency_configured"),
    )


def latest_run(history: DataFrame) -> DataFrame:
    """Newest run on a real backend that called its workers: one row, or none."""
    real = history.filter((F.col("backend") == REAL_BACKEND) & (F.col("worker_calls") > 0))
    row = F.struct(RUN, "slices", "collecting_s", "concurrency_configured")
    return real.agg(F.max_by(row, RUN).alias("_r")).filter("_r IS NOT NULL").select("_r.*")


def estimate(workload: DataFrame, history: DataFrame, concurrency: int) -> DataFrame:
    """Minutes to sweep each row's `slices`, from collecting seconds per slice of the latest real run.

    Without usable history: 180 s per slice over the concurrency. The history side is one row.
    """
    latest = latest_run(history)
    was = F.when(F.coalesce("concurrency_configured", F.lit(0.0)) != 0, F.col("concurrency_configured")).otherwise(
        F.lit(float(concurrency))
    )
    observed = latest.select(
        F.lit(True).alias("_one"),
        F.col(RUN).alias("basis_run"),
        F.try_divide(F.col("collecting_s"), F.col("slices")).alias("seconds_per_slice"),
        (was / F.lit(float(concurrency)) if concurrency else F.lit(1.0)).alias("scale"),
    )
    fallback = F.col("slices") * F.lit(DEFAULT_SECONDS_PER_SLICE) / F.lit(concurrency) / 60
    learned = F.col("slices") * F.col("seconds_per_slice") * F.col("scale") / 60
    joined = workload.withColumn("_one", F.lit(True)).join(F.broadcast(observed), "_one", "left").drop("_one")
    usable = F.col("seconds_per_slice").isNotNull()
    return (
        joined.withColumn("minutes", F.coalesce(learned, fallback))
        .withColumn("basis_run", F.when(usable, F.col("basis_run")))
        .drop("seconds_per_slice", "scale")
    )


def run_stats(log: DataFrame, *, inventory: DataFrame | None = None, metrics: DataFrame | None = None,
              samples: DataFrame | None = None, runs: DataFrame | None = None, failures: DataFrame | None = None,
              quality: DataFrame | None = None) -> DataFrame:
    """One row per run with nested structs for times, roles, phases, work and rejections.

    Optional parts: `inventory` (see work_totals), `metrics` (see metric_delta), `samples` (investigation_id, name,
    value), `runs` (investigation_id with backend, concurrency_configured, case: what the estimate of later runs needs), `failures`
    (investigation_id, failures, failure_reasons as in `outcomes.failure_summary`) and `quality` (investigation_id and counts as in
    `brief.quality_counts`, and slices_swept). The maps are bounded: roles of a run, 14 states, 8 reasons, the kinds of sample.
    The log is parsed once and written with the fields that count.
    """
    log = materialize(log.select(*STATS_FIELDS), "run-log")

    def as_map(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return df.groupBy(RUN).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    phases = materialize(phase_durations(log), "phases")  # two parts read them
    by_role = joined(role_counts(log), role_latency(log), [RUN, "role"])
    role = F.struct(
        "calls", "retries", "errors",
        F.struct(F.col("count"), "median", "p95", "max", "total").alias("latency_s"),
        "prompt_tokens", "completion_tokens",
    )
    parts = [
        as_map(by_role, "role", role, "roles"),
        as_map(phases, "state", F.col("seconds"), "by_phase_s"),
        parallelism(log, phases), validations(log), final_states(log), wall_clock(log),
        as_map(rejection_reasons(log), "reason", F.col("reports"), "rejection_reasons"),
    ]
    work = ["validations", "rejections", "rejection_rate", "rejection_reasons"]
    extra = []
    if inventory is not None:
        parts.append(work_totals(log, inventory))
        work = ["files", "lines_swept", "slices", "llm_calls", *work]
    if metrics is not None:
        fields = ("requests", "prompt_tokens", "generation_tokens", "prefix_cache_hit_rate", "mean_e2e_latency_s",
                  "mean_time_to_first_token_s")
        parts.append(as_map(metric_delta(metrics), "role", F.struct(*fields), "server"))
        extra.append("server")
    if samples is not None:
        parts.append(as_map(sample_spread(samples, [RUN, "name"]), "name", F.struct("mean", "peak", "min"), "machine"))
        extra.append("machine")
    if runs is not None:
        parts.append(runs.select(RUN, *[c for c in ("backend", "concurrency_configured", "case") if c in runs.columns]))
        extra += parts[-1].columns[1:]
    if failures is not None:
        parts.append(failures.select(RUN, F.col("failures").alias("task_failures"), F.col("failure_reasons").alias("task_failure_reasons")))
        work += ["task_failures", "task_failure_reasons"]
    if quality is not None:
        counts = [c for c in QUALITY_FIELDS if c in quality.columns]
        parts.append(quality.select(RUN, F.struct(*counts).alias("quality")))
        extra.append("quality")
    out = log.select(RUN).distinct()
    for part in parts:
        out = joined(out, part, [RUN])
    return out.select(
        RUN,
        F.col("final_state").alias("terminal_state"),
        "aborted_by_operator",
        F.struct("wall_clock_s", "by_phase_s", "effective_parallelism").alias("time"),
        F.struct(*work).alias("work"),
        "roles",
        *extra,
    )
