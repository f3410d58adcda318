"""Run logs: one JSON object per line, possibly torn; the append-only sink; history of run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sweeplog import schemas
from sweeplog.functions.lines import python_strip
from sweeplog.operators import ordered
from sweeplog.session import materialize

RAW_CHARS = 500
# Payload keys that never reach a file.
SECRET_FIELDS = ("api_key",)
# Folders of the sink, and events of a run in one file: neither folders nor files grow with the number of runs.
FOLDERS = 256
FILE_EVENTS = 1_000_000


def read_run_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed records of run logs; lines that are no JSON objects are skipped."""
    return records(spark.read.text(paths))


def _one_object(text: Column, ddl: str) -> Column:
    """The JSON object a line holds, as an array of one; null or another size when the line is not exactly one object.

    The reader ignores what follows a complete value, so the line is parsed as the only element of a list: anything
    behind the object then breaks the list.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{ddl}>>", {"allowSingleQuotes": "false"})
    return F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), listed)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.size(_one_object(text, "event_id:string")) == 1, F.lit(False))


def records(lines: DataFrame, text: str = "value") -> DataFrame:
    """Parse JSON lines, skipping malformed ones."""
    ddl = StructType.fromDDL(schemas.RUN_LOG_DDL).simpleString().removeprefix("struct<").removesuffix(">")
    return lines.filter(_is_object(F.col(text))).select(_one_object(F.col(text), ddl)[0].alias("r")).select("r.*")


def tolerant(lines: DataFrame, text: str = "value") -> DataFrame:
    """Every non-blank line: its kind and JSON text, or kind `unparseable_line` with the first 500 characters."""
    others = [c for c in lines.columns if c != text]
    body = lines.withColumn("_line", python_strip(F.col(text))).filter("_line <> ''")
    good = _is_object(F.col("_line"))
    return body.select(
        *others,
        F.when(good, F.get_json_object("_line", "$.kind")).otherwise(F.lit("unparseable_line")).alias("kind"),
        F.when(good, F.col("_line")).alias("record"),
        F.when(~good, F.substring("_line", 1, RAW_CHARS)).alias("raw"),
    )


def readable(log: DataFrame) -> DataFrame:
    """Multi-line texts of calls as arrays of lines: response and each message."""
    return log.withColumn("response_lines", F.split("response_text", "\n", -1)).withColumn(
        "message_lines",
        F.transform("request_messages", lambda m: F.struct(m["role"].alias("role"), F.split(m["content"], "\n", -1).alias("lines"))),
    )


def number_events(events: DataFrame, previous: DataFrame | None = None, order: tuple[str, ...] = ("ts", "sequence")) -> DataFrame:
    """Add event_id, rising by one within each run and continuing after `previous` (investigation_id, event_id)."""
    bucketed = ordered.with_bucket(events, ["investigation_id"], order[0])
    numbered = ordered.with_position(bucketed, ["investigation_id"], list(order), "event_id").drop("_bucket")
    if previous is None:
        return numbered
    last = previous.groupBy("investigation_id").agg(F.max("event_id").alias("_last"))
    return numbered.join(last, "investigation_id", "left").withColumn(
        "event_id", F.col("event_id") + F.coalesce("_last", F.lit(0))
    ).drop("_last")


def _folder(run: Column) -> Column:
    return F.pmod(F.crc32(run.cast("binary")), F.lit(FOLDERS))


def append_events(events: DataFrame, path: str) -> None:
    """Append numbered, stamped events (investigation_id, event_id, ts, kind, ...) as JSON lines, in `FOLDERS` folders of runs.

    The run's id is a field of each line, as the readers take it from there; a hash of it names the folder (`runs`). A folder per run
    would be created, renamed and listed one by one on the driver. The events of a run keep to one file for each `FILE_EVENTS` of them.
    """
    stamped = events.withColumn(
        "ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    )
    first = ["event_id", "investigation_id"]
    named = stamped.select(*first, *[c for c in stamped.columns if c not in first], _folder(F.col("investigation_id")).alias("runs"))
    dealt = named.repartition("runs", F.floor(F.col("event_id") / FILE_EVENTS))
    dealt.write.mode("append").partitionBy("runs").json(path)


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Typed records of one run from the sink; only its folder is read."""
    lines = spark.read.text(path).filter(F.col("runs") == _folder(F.lit(run)))
    return records(lines).filter(F.col("investigation_id") == run)


def write_json(df: DataFrame, path: str) -> None:
    """Write records as JSON without secret fields, at the top level or one struct below."""
    clean = df.drop(*SECRET_FIELDS)
    for field in clean.schema.fields:
        if field.dataType.typeName() == "struct":
            hidden = [n for n in SECRET_FIELDS if n in field.dataType.names]
            if hidden:
                clean = clean.withColumn(field.name, F.col(field.name).dropFields(*hidden))
    clean.write.mode("errorifexists").json(path)


def read_history(spark: SparkSession, pattern: str) -> DataFrame:
    """Run statistics written by earlier runs: one JSON document per line as `write_json` gives them, or one per file.

    Files are read by lines, so a file of any size is split. Only those without a line that is a document are read again as a
    whole. What cannot be read is left out.
    """
    ddl = StructType.fromDDL(schemas.STATS_DDL).simpleString().removeprefix("struct<").removesuffix(">")

    def documents(text: DataFrame) -> DataFrame:
        found = text.select("path", _one_object(F.col("value"), ddl).alias("_r")).filter(F.size("_r") == 1)
        return found.select("path", F.col("_r")[0].alias("r")).filter("r.investigation_id IS NOT NULL")

    path = F.col("_metadata.file_path").alias("path")
    lines = spark.read.text(pattern).select("value", path)
    by_line = materialize(documents(lines), "history")
    left = lines.select("path").distinct().join(by_line.select("path").distinct(), "path", "left_anti")
    names = [r["path"] for r in left.collect()]  # names of files that are one document each, or none
    if not names:
        return by_line.select("r.*")
    whole = documents(spark.read.text(names, wholetext=True).select("value", path))
    return by_line.unionByName(whole).select("r.*")
