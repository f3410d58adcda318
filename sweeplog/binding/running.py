"""Run-log statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplog.binding import sql as S
from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.binding.reporting import reason_case
from sweeplog.binding.slicing import EVENT_BUDGET
from sweeplog.operators import runstats as R
from sweeplog.operators import slices as SL
from sweeplog.sources import metrics, runlog


def _pick(values, at: str) -> str:
    return f"([{', '.join(S.text(v) for v in values)}])[{at} + 1]"


LOG = f"""
log AS (
  SELECT event_id, 'run-' || user_id AS investigation_id, user_id,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE date_trunc('milliseconds', ts) END AS moment,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'llm_call' WHEN event_type IN ('signup', 'view') THEN 'state_transition'
              ELSE 'grunt_validation' END AS kind,
         {_pick(R.STATES, 'event_id % 14')} AS from_state, {_pick(R.STATES, 'k % 14')} AS to_state,
         CASE WHEN event_type = 'click' THEN 'grunt' ELSE 'commander' END AS role, 'task-' || (event_id % 500) AS task_id,
         CASE WHEN event_id % 4 <> 0 THEN event_id % 3 + 1 ELSE 1 END AS attempt, event_id % 6 = 0 AS truncated,
         CASE WHEN event_id % 19 <> 0 THEN k ELSE 0 END AS prompt_tokens,
         CASE WHEN event_id % 19 <> 0 AND k % 10 <> 0 THEN k * 2 ELSE 0 END AS completion_tokens,
         value / 1000 AS latency_s, CAST(value AS DECIMAL(18,2)) AS latency_ms, event_id % 17 = 0 AS failed, k % 3 = 0 AS ok,
         [{_pick(V.REJECTIONS, 'event_id % 9')}, {_pick(V.REJECTIONS, '(event_id // 9) % 9')}] AS problems
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 50 <> 0
)"""

PHASES = f"""{LOG},
phases AS (
  SELECT investigation_id, state, CAST(sum(micros) AS DOUBLE) / 1e6 AS seconds FROM (
    SELECT investigation_id, lag(to_state) OVER w AS state, epoch_us(moment) - lag(epoch_us(moment)) OVER w AS micros
    FROM log WHERE kind = 'state_transition' AND moment IS NOT NULL WINDOW w AS (PARTITION BY investigation_id ORDER BY event_id))
  WHERE micros IS NOT NULL GROUP BY ALL
)"""


def spread(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, n AS count, (max(CASE WHEN i = (n - 1) // 2 THEN latency_s END) + max(CASE WHEN i = n // 2 THEN latency_s END)) / 2 AS median,
       max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) THEN latency_s END) AS p95, max(latency_s) AS max,
       CAST(sum(latency_ms) AS DOUBLE) / 1000 AS total
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY latency_s) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n
      FROM {source} WHERE kind = 'llm_call') GROUP BY {keys}, n"""


@register("run_log_tolerant", f"""WITH {LOG}
SELECT event_id, investigation_id, kind, epoch_us(moment) AS at_micros,
       CASE WHEN kind = 'state_transition' THEN to_state END AS to_state FROM log""")
def run_log_tolerant(spark, sf_dir):
    return V.run_log(spark, sf_dir).select(
        "event_id", "investigation_id", "kind", F.unix_micros(R.instant()).alias("at_micros"), "to_state"
    )


@register("unparseable_rows", """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'unparseable_line' WHEN event_type IN ('click', 'purchase') THEN 'llm_call'
       WHEN event_type IN ('signup', 'view') THEN 'state_transition' ELSE 'grunt_validation' END AS kind,
       CASE WHEN event_id % 50 = 0 THEN '{"event_id":' || event_id || ',"inv' END AS raw_start FROM events""")
def unparseable_rows(spark, sf_dir):
    rows = runlog.tolerant(V.run_log_text(spark, sf_dir).drop("user_id"))
    start = F.left("raw", F.length(F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"inv'))))
    return rows.select("event_id", "kind", start.alias("raw_start"))


@register("role_stats", f"""WITH {LOG}
SELECT investigation_id, role, count(*) AS calls, count(*) FILTER (WHERE attempt > 1) AS retries, count(*) FILTER (WHERE failed) AS errors,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM log WHERE kind = 'llm_call' GROUP BY ALL""")
def role_stats(spark, sf_dir):
    return R.role_counts(V.run_log(spark, sf_dir))


@register("latency_spread", f"WITH {LOG} {spread('log', 'investigation_id, role')}")
def latency_spread(spark, sf_dir):
    return R.role_latency(V.run_log(spark, sf_dir))


@register("truncation_split", f"WITH {LOG} {spread('log', 'role, truncated')}")
def truncation_split(spark, sf_dir):
    return R.truncation_split(V.run_log(spark, sf_dir))


@register("final_attempt", f"""WITH {LOG}
SELECT investigation_id, task_id, attempt AS attempts, event_id AS last_event_id, NOT failed AS succeeded FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id, task_id ORDER BY attempt DESC, event_id DESC) AS rn FROM log WHERE kind = 'llm_call')
WHERE rn = 1""")
def final_attempt(spark, sf_dir):
    return R.final_attempts(V.run_log(spark, sf_dir))


@register("final_turns", """
SELECT 'conversations' AS investigation_id, 'conv-' || conv_id AS task_id, turn + 1 AS attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def final_turns(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select(
        F.lit("llm_call").alias("kind"), F.lit("conversations").alias("investigation_id"), "role",
        F.concat(F.lit("conv-"), "conv_id").alias("task_id"), (F.col("turn") + 1).alias("attempt"), F.col("turn").alias("event_id"),
        F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("error"),
    )
    return R.final_attempts(turns).select("investigation_id", "task_id", "attempts")


@register("rejection_rate", f"""WITH {LOG}
SELECT investigation_id, count(*) AS validations, count(*) FILTER (WHERE NOT ok) AS rejections,
       CAST(count(*) FILTER (WHERE NOT ok) AS DOUBLE) / count(*) AS rejection_rate
FROM log WHERE kind = 'grunt_validation' GROUP BY ALL""")
def rejection_rate(spark, sf_dir):
    return R.validations(V.run_log(spark, sf_dir))


REASONS = f"""{LOG},
reasons AS (
  SELECT DISTINCT event_id, investigation_id,
         CASE WHEN contains(problems[1], 'cut off at the token limit') OR contains(problems[2], 'cut off at the token limit')
              THEN 'truncated_at_token_limit' ELSE {reason_case('p')} END AS reason
  FROM (SELECT *, unnest(problems) AS p FROM log WHERE kind = 'grunt_validation' AND NOT ok)
)"""


@register("rejection_reasons", f"WITH {REASONS} SELECT investigation_id, reason, count(*) AS reports FROM reasons GROUP BY ALL")
def rejection_reasons(spark, sf_dir):
    return R.rejection_reasons(V.run_log(spark, sf_dir))


@register("phase_durations", f"WITH {PHASES} SELECT * FROM phases")
def phase_durations(spark, sf_dir):
    return R.phase_durations(V.run_log(spark, sf_dir))


@register("phase_ranking", f"""WITH {PHASES}
SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY seconds DESC, state) AS rank FROM phases""")
def phase_ranking(spark, sf_dir):
    return R.ranked(R.phase_durations(V.run_log(spark, sf_dir)), "seconds", "state")


@register("reason_ranking", f"""WITH {REASONS}, r AS (SELECT investigation_id, reason, count(*) AS reports FROM reasons GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY reports DESC, reason) AS rank FROM r""")
def reason_ranking(spark, sf_dir):
    return R.ranked(R.rejection_reasons(V.run_log(spark, sf_dir)), "reports", "reason")


_LEGAL = ", ".join(f"'{a}>{b}'" for a, targets in R.LEGAL_TRANSITIONS.items() for b in targets)


@register("transition_audit", f"""WITH {LOG}
SELECT investigation_id, from_state, to_state, count(*) AS occurrences
FROM log WHERE kind = 'state_transition' AND from_state || '>' || to_state NOT IN ({_LEGAL}) GROUP BY ALL""")
def transition_audit(spark, sf_dir):
    return R.illegal_transitions(V.run_log(spark, sf_dir))


PARALLEL = f"""{PHASES},
parallel AS (
  SELECT investigation_id, worker_s, seconds AS collecting_s, worker_s / nullif(seconds, 0) AS effective_parallelism
  FROM (SELECT investigation_id, CAST(sum(latency_ms) AS DOUBLE) / 1000 AS worker_s FROM log WHERE kind = 'llm_call' AND role = 'grunt' GROUP BY ALL)
  LEFT JOIN (SELECT * FROM phases WHERE state = 'COLLECTING') USING (investigation_id)
)"""


@register("final_states", f"""WITH {LOG}
SELECT investigation_id, arg_max(to_state, event_id) AS final_state, bool_or(to_state IN ('ABORTING', 'ABORTED_BY_OPERATOR')) AS aborted_by_operator,
       count(*) AS transitions, arg_max(to_state, event_id) IN ({', '.join(S.text(t) for t in R.TERMINAL_STATES)}) AS terminal
FROM log WHERE kind = 'state_transition' GROUP BY investigation_id""")
def final_states(spark, sf_dir):
    return R.final_states(V.run_log(spark, sf_dir))


@register("truncated_calls", f"""WITH {LOG}
SELECT investigation_id, event_id, task_id, 'Your reply was cut off at the token limit ('
       || CASE WHEN event_id % 19 <> 0 AND prompt_tokens % 10 <> 0 THEN CAST(completion_tokens AS VARCHAR) ELSE 'max' END
       || ' tokens); report an aggregate with few representative_refs.' AS problem
FROM log WHERE kind = 'llm_call' AND truncated""")
def truncated_calls(spark, sf_dir):
    return R.truncated_calls(V.run_log(spark, sf_dir))


@register("parallelism", f"WITH {PARALLEL} SELECT * FROM parallel")
def parallelism(spark, sf_dir):
    return R.parallelism(V.run_log(spark, sf_dir))


@register("work_totals", f"""WITH RECURSIVE {S.EVENT_LINES}, {S.packed('event_lines', EVENT_BUDGET, True)}, {LOG},
c AS (SELECT investigation_id, count(*) AS llm_calls FROM log WHERE kind = 'llm_call' GROUP BY ALL)
SELECT replace(replace(file, 'user', 'run'), '.log', '') AS investigation_id, CAST(1 AS BIGINT) AS files, line_count AS lines_swept,
       any_value(window_count) AS slices, any_value(coalesce(llm_calls, 0)) AS llm_calls
FROM windows LEFT JOIN c ON c.investigation_id = replace(replace(file, 'user', 'run'), '.log', '') GROUP BY file, line_count""")
def work_totals(spark, sf_dir):
    lines = V.event_lines(spark, sf_dir)
    inventory = SL.file_inventory(lines, SL.slice_places(lines, budget=EVENT_BUDGET))
    run = F.regexp_replace(F.replace("file", F.lit("user"), F.lit("run")), r"\.log$", "")
    return R.work_totals(V.run_log(spark, sf_dir), inventory.withColumn("investigation_id", run))


SAMPLES = f"""
samples AS (
  SELECT 'run-' || (user_id % 10) AS investigation_id, CASE WHEN user_id % 2 = 0 THEN 'grunt' ELSE 'commander' END AS role,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS snapshot,
         {_pick([*metrics.COUNTERS, 'other', 'other'], 'event_id % 12')} AS metric, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM events WHERE event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 12 < 10 GROUP BY ALL
)"""


@register("metric_samples", f"WITH {SAMPLES} SELECT * FROM samples")
def metric_samples(spark, sf_dir):
    return metrics.parse_scrape(V.scrape_lines(spark, sf_dir), ["investigation_id", "role", "snapshot"])


def _delta(name: str) -> str:
    return f"coalesce(sum(CASE WHEN metric = 'vllm:{name}' THEN delta END), 0)"


@register("metric_delta", f"""WITH {SAMPLES},
d AS (SELECT a.investigation_id, a.role, a.metric, a.value - coalesce(b.value, 0) AS delta
      FROM (SELECT * FROM samples WHERE snapshot = 'after') a
      LEFT JOIN (SELECT * FROM samples WHERE snapshot = 'before') b USING (investigation_id, role, metric))
SELECT investigation_id, role, CAST(trunc({_delta('request_success_total')}) AS BIGINT) AS requests,
       CAST(trunc({_delta('prompt_tokens_total')}) AS BIGINT) AS prompt_tokens,
       CAST(trunc({_delta('generation_tokens_total')}) AS BIGINT) AS generation_tokens,
       {_delta('prefix_cache_hits_total')} / nullif({_delta('prefix_cache_queries_total')}, 0) AS prefix_cache_hit_rate,
       {_delta('e2e_request_latency_seconds_sum')} / nullif({_delta('e2e_request_latency_seconds_count')}, 0) AS mean_e2e_latency_s,
       {_delta('time_to_first_token_seconds_sum')} / nullif({_delta('time_to_first_token_seconds_count')}, 0) AS mean_time_to_first_token_s
FROM d GROUP BY ALL""")
def metric_delta(spark, sf_dir):
    return R.metric_delta(metric_samples(spark, sf_dir))


@register("sample_spread", """
SELECT 'run-' || user_id AS investigation_id, name, count(*) AS samples, CAST(sum(v) AS DOUBLE) / count(*) AS mean,
       CAST(max(v) AS DOUBLE) AS peak, CAST(min(v) AS DOUBLE) AS min
FROM (
  SELECT user_id, 'gpu_util' AS name, CAST(json_extract(props, '$.k') AS DECIMAL(38,6)) AS v FROM events WHERE event_id % 23 <> 0
  UNION ALL SELECT user_id, 'gpu_power_w', CAST(value AS DECIMAL(38,6)) FROM events WHERE event_id % 5 <> 0 AND event_id % 23 <> 0
  UNION ALL SELECT user_id, 'gpu_temp_c', NULL FROM events) WHERE v IS NOT NULL GROUP BY ALL""")
def sample_spread(spark, sf_dir):
    e = F.col("event_id")
    power = F.when(e % 5 == 0, F.lit("[N/A]")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    text = F.concat(V.event_k(), F.lit(", "), power, F.when(e % 23 == 0, F.lit("")).otherwise(F.lit(", [N/A]")))
    samples = V.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), "user_id").alias("investigation_id"), metrics.gpu_sample(text).alias("s")
    )
    long = samples.select("investigation_id", "s.*").unpivot(
        ["investigation_id"], ["gpu_util", "gpu_power_w", "gpu_temp_c"], "name", "value"
    )
    return R.sample_spread(long, ["investigation_id", "name"])


@register("host_memory", """
SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN (16777216 - CAST(json_extract(props, '$.k') AS BIGINT) * 1000) / 1024.0::DOUBLE / 1024.0::DOUBLE END AS used_gb
FROM events""")
def host_memory(spark, sf_dir):
    available = F.concat(F.lit("\nMemAvailable:   "), V.event_k() * 1000, F.lit(" kB"))
    text = F.concat(F.lit("MemTotal:       16777216 kB"), F.when(F.col("event_id") % 6 == 0, F.lit("")).otherwise(available))
    return V.table(spark, sf_dir, "events").select("event_id", metrics.host_memory_gb(text).alias("used_gb"))


HISTORY = f"""{PHASES},
history AS (
  SELECT investigation_id, worker_calls, slices, seconds AS collecting_s, CASE WHEN user_id % 2 = 0 THEN 'vllm' ELSE 'stub' END AS backend,
         CAST(user_id % 3 * 4 AS DOUBLE) AS concurrency_configured
  FROM (SELECT investigation_id, user_id, count(*) AS worker_calls FROM log WHERE kind = 'llm_call' AND role = 'grunt' GROUP BY ALL)
  JOIN (SELECT investigation_id, count(*) AS slices FROM log WHERE kind = 'grunt_validation' GROUP BY ALL) USING (investigation_id)
  JOIN (SELECT * FROM phases WHERE state = 'COLLECTING') USING (investigation_id)
)"""

LATEST = f"""{HISTORY},
latest AS (SELECT investigation_id, slices, collecting_s, concurrency_configured FROM history
           WHERE backend = 'vllm' AND worker_calls > 0 ORDER BY investigation_id DESC LIMIT 1)"""


@register("latest_run", f"WITH {LATEST} SELECT * FROM latest")
def latest_run(spark, sf_dir):
    return R.latest_run(V.history(spark, sf_dir))


@register("run_estimate", f"""WITH {LATEST},
w AS (SELECT source AS case_id, count(*) AS slices FROM documents GROUP BY ALL)
SELECT case_id, w.slices, coalesce(w.slices * (collecting_s / nullif(latest.slices, 0))
         * (CASE WHEN concurrency_configured <> 0 THEN concurrency_configured ELSE 8 END / 8.0::DOUBLE) / 60,
         w.slices * 180.0::DOUBLE / 8 / 60) AS minutes, investigation_id AS basis_run
FROM w LEFT JOIN latest ON true""")
def run_estimate(spark, sf_dir):
    workload = V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("case_id")).agg(F.count("*").alias("slices"))
    return R.estimate(workload, V.history(spark, sf_dir), 8)


@register("run_stats", f"""WITH {PARALLEL}, {REASONS.replace(LOG + ',', '', 1)},
v AS (SELECT investigation_id, count(*) AS validations, count(*) FILTER (WHERE NOT ok) AS rejections FROM log WHERE kind = 'grunt_validation' GROUP BY ALL),
r AS (SELECT investigation_id, string_agg(reason || '=' || n, ' ' ORDER BY reason) AS reasons
      FROM (SELECT investigation_id, reason, count(*) AS n FROM reasons GROUP BY ALL) GROUP BY ALL),
c AS (SELECT investigation_id, role, count(*) AS n FROM log WHERE kind = 'llm_call' GROUP BY ALL)
SELECT i.investigation_id, w.seconds AS wall_clock_s, p.effective_parallelism, v.validations, v.rejections, coalesce(r.reasons, '') AS reasons,
       ph.seconds AS collecting_s, g.n AS worker_calls
FROM (SELECT DISTINCT investigation_id FROM log) i LEFT JOIN parallel p USING (investigation_id) LEFT JOIN v USING (investigation_id)
LEFT JOIN r USING (investigation_id) LEFT JOIN (SELECT * FROM phases WHERE state = 'COLLECTING') ph USING (investigation_id)
LEFT JOIN (SELECT * FROM c WHERE role = 'grunt') g USING (investigation_id)
LEFT JOIN (SELECT investigation_id, (max(epoch_us(moment)) - min(epoch_us(moment))) / 1e6 AS seconds FROM log GROUP BY ALL) w USING (investigation_id)""")
def run_stats(spark, sf_dir):
    stats = R.run_stats(V.run_log(spark, sf_dir))
    reasons = F.transform(F.array_sort(F.map_entries("work.rejection_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return stats.select(
        "investigation_id", "time.wall_clock_s", "time.effective_parallelism", "work.validations", "work.rejections",
        F.coalesce(F.array_join(reasons, " "), F.lit("")).alias("reasons"),
        F.try_element_at("time.by_phase_s", F.lit("COLLECTING")).alias("collecting_s"),
        F.try_element_at("roles", F.lit("grunt"))["calls"].alias("worker_calls"),
    )
