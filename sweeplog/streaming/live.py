"""Live versions of the scan, the sweep, call counters, run states, burst sessions and the run-log tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sweeplog.functions import injection as INJ
from sweeplog.operators import indicators as I
from sweeplog.operators import runstats as R
from sweeplog.session import materialize, staging_path
from sweeplog.sources import runlog
from sweeplog.sources.casefiles import LOGS_DIR, _path_part, directly_in_logs
from sweeplog.sources.tail import tail
from sweeplog.streaming.states import FINDINGS, STATES, FileFindings, RunStates, use_state_store

CALL_WINDOW = "5 seconds"


def read_log_stream(spark: SparkSession, parent: str, max_files: int = 1000) -> DataFrame:
    """Lines of log files as they arrive under `<parent>/<case>/logs/`: (case_id, file, text).

    Files whose name starts with `_` or `.` are not seen by the stream; the batch reader has them.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(f"{parent.rstrip('/')}/*/{LOGS_DIR}/*")
    path = F.col("_metadata.file_path")
    return raw.filter(directly_in_logs(path, parent)).select(
        _path_part(path, rf"([^/]+)/{LOGS_DIR}/[^/]+$").alias("case_id"), _path_part(path, r"([^/]+)$").alias("file"),
        F.make_valid_utf8("value").alias("text"),
    )


def injection_signals(lines: DataFrame) -> DataFrame:
    """Text that addresses an AI system, as it arrives. Stateless."""
    return INJ.scan(lines)


def call_counters(records: DataFrame, delay: str = "1 minute", window: str = CALL_WINDOW) -> DataFrame:
    """Calls, retries, errors and tokens per role and window; rows behind the watermark are dropped."""
    zero = F.lit(0).cast("bigint")
    stamped = R.calls(records.withColumn("at", R.instant())).filter("at IS NOT NULL").withWatermark("at", delay)
    return stamped.groupBy(F.window("at", window).alias("w"), "role").agg(
        F.count("*").alias("calls"),
        F.count_if(F.coalesce("attempt", F.lit(1)) > 1).alias("retries"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.sum(F.coalesce("usage.prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("usage.completion_tokens", zero)).alias("completion_tokens"),
    ).select(F.col("w.start").alias("window_start"), "role", "calls", "retries", "errors", "prompt_tokens", "completion_tokens")


def burst_sessions(flows: DataFrame, gap: str, delay: str = "1 minute") -> DataFrame:
    """Sessions per (source, domain), emitted once no further query can join them."""
    return (
        flows.withWatermark("ts", delay)
        .groupBy("source", "domain", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
        .select("source", "domain", "first_ts", "last_ts", "events")
    )


def read_growing_logs(spark: SparkSession, parent: str) -> DataFrame:
    """Lines as they are appended under `<parent>/<case>/logs/`, in chunks: (case_id, file, part, lines)."""
    path = F.col("path")
    return tail(spark, f"{parent.rstrip('/')}/*/{LOGS_DIR}/*").select(
        F.regexp_extract(path, rf"([^/]+)/{LOGS_DIR}/[^/]+$", 1).alias("case_id"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), "part", "lines"
    )


def running_findings(chunks: DataFrame, directive: DataFrame, *, ttl_days: int | None = 7) -> DataFrame:
    """Stream-static join: matches so far per case, file and indicator, with the numbers of the first and the last line.

    `chunks` are lines as `read_growing_logs` gives them. Lines are matched where they are read; a file's state gets a row for each
    chunk, with the number of its lines and the hits, and holds how many lines the file had so far. A file's chunks of one batch are taken in
    order of `part`. Only files with new hits give rows. With `ttl_days`, a finding that gets no new line for that time is given up; a
    query that should end by itself (availableNow) needs None, as waiting for that keeps it running.
    """
    use_state_store(chunks.sparkSession)
    joined = I.with_directive(chunks.withColumn("line_no", F.col("part")), directive, "indicators").drop("line_no")
    found = F.filter(
        F.transform("lines", lambda t, n: F.struct(n.cast("bigint").alias("pos"), F.filter("indicators", lambda i: F.contains(t, i)).alias("named"))),
        lambda r: F.size(r["named"]) > 0,
    )
    rows = joined.select("case_id", "file", "part", F.size("lines").cast("bigint").alias("lines"), found.alias("found"))
    return rows.groupBy("case_id", "file").transformWithStateInPandas(
        FileFindings(ttl_days and ttl_days * 86_400_000), FINDINGS, "Update", "ProcessingTime" if ttl_days else "None"
    )


def run_states(records: DataFrame, *, delay: str = "1 hour", drop_finished: bool = True) -> DataFrame:
    """Per run and phase, after each batch that touched the run: current state, illegal transitions, time in the phase.

    Events wait until the watermark, `delay` behind the newest event, has passed them, and are then applied in order of their ids; so an event
    that arrives late by less than the delay takes its place. What is given counts the waiting events as if nothing else
    came, so it equals the batch result for what has arrived. Events behind the watermark are dropped; those that come after
    one with a higher id was applied are counted as `disordered`. A run's state goes when it has reached a terminal state and nothing waits
    (`drop_finished`).
    """
    use_state_store(records.sparkSession)
    steps = R.transitions(records).select("investigation_id", "event_id", "from_state", "to_state", R.instant().alias("at"))
    legal = {f"{a}>{b}" for a, targets in R.LEGAL_TRANSITIONS.items() for b in targets}
    follow = RunStates(legal, set(R.TERMINAL_STATES) if drop_finished else set())
    return steps.withWatermark("at", delay).groupBy("investigation_id").transformWithStateInPandas(follow, STATES, "Update", "EventTime")


def tail_run_log(lines: DataFrame, records_path: str, quarantine_path: str, checkpoint: str):
    """Start a tail of JSON lines (column value): records to one table, lines that are none to another.

    With `tail` as the source a line arrives when it is whole, however often its file grows in between.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(runlog.tolerant(batch.select("value")), "run-log")
        torn = F.col("kind") == "unparseable_line"
        rows.filter(~torn).select("kind", "record").write.mode("overwrite").parquet(f"{records_path}/batch_id={batch_id}")
        rows.filter(torn).select("raw").write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# Start of a record as the sink writes it.
_EVENT_KEY = r'^\{"event_id":\s*(\d+),\s*"investigation_id":\s*"([^"]+)"'


def _event_key(text: Column) -> list[Column]:
    return [F.regexp_extract(text, _EVENT_KEY, 1).alias("_event"), F.regexp_extract(text, _EVENT_KEY, 2).alias("_run")]


def open_quarantine(records: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Torn lines whose complete form has not arrived: no record starts with the same run and event."""
    complete = records.select(*_event_key(F.col("record"))).filter("_run <> ''").distinct()
    return quarantine.select("raw", *_event_key(F.col("raw"))).join(complete, ["_event", "_run"], "left_anti").select("raw")


class LiveTable:
    """A table of the shared folder to which a query's rows are added, one part per batch (`batch_id`), run by run."""

    def __init__(self, spark: SparkSession, name: str = "live"):
        self.spark = spark
        self.target, self.checkpoint = staging_path(spark, name), staging_path(spark, f"{name}-checkpoint")
        self.started = False

    def run(self, df: DataFrame, mode: str = "append") -> DataFrame:
        """Process what has come since the last run and stop; the table so far."""

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.target}/batch_id={batch_id}")

        if not self.started:  # an empty first part, so that the table exists when nothing arrives
            self.spark.createDataFrame([], df.schema).write.parquet(f"{self.target}/batch_id=-1")
            self.started = True
        query = (
            df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        schema = StructType([*df.schema.fields, StructField("batch_id", LongType())])
        return self.spark.read.schema(schema).option("basePath", self.target).parquet(self.target)


def run_available(df: DataFrame, mode: str = "append", name: str = "live") -> DataFrame:
    """Process what is there and stop."""
    return LiveTable(df.sparkSession, name).run(df, mode)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key."""
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    row = F.struct(*values)
    return updates.groupBy(*keys).agg(F.max_by(row, "batch_id").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in values])

