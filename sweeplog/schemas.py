"""Closed schemas of the records that cross a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_seen", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("value", T.StringType()),
                        T.StructField("note", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("raw_detector_fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
ALERT_REQUIRED = [f.name for f in ALERT.fields if f.name not in ("entities", "raw_detector_fields")]

FINDING_DDL = (
    "struct<description:string,match_count:bigint,representative_refs:array<string>,"
    "first_ref:string,last_ref:string,confidence:string>"
)
CHECK_DDL = "struct<checked_for:string,found:boolean,result:string>"
REPORT_DDL = (
    "struct<slice_metadata:struct<slice_id:string,file:string,lines_examined:bigint>,"
    f"relevant:boolean,findings:array<{FINDING_DDL}>,checked_for:array<{CHECK_DDL}>>"
)

# Run-log record; payload keeps the fields that the statistics read.
RUN_LOG_DDL = (
    "event_id bigint, investigation_id string, ts string, kind string, "
    "from_state string, to_state string, iteration bigint, note string, "
    "role string, model string, endpoint string, task_id string, parent_task_id string, state string, "
    "attempt bigint, schema_name string, response_text string, finish_reason string, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint>, latency_ms double, error string, "
    "validation_errors array<string>, "
    "request_messages array<struct<role:string,content:string>>, "
    "payload struct<task_id:string,attempt:bigint,ok:boolean,problems:array<string>,"
    "failures:bigint,failure_reasons:array<string>>"
)

STATS_DDL = (
    "investigation_id string, concurrency_configured double, `case` string, backend string, terminal_state string, "
    "time struct<wall_clock_s:double,by_phase_s:map<string,double>,effective_parallelism:double>, "
    "work struct<files:bigint,lines_swept:bigint,slices:bigint,llm_calls:bigint,grunt_validations:bigint,"
    "grunt_rejections:bigint,grunt_rejection_rate:double,validations:bigint,rejections:bigint,rejection_rate:double,"
    "rejection_reasons:map<string,bigint>>, "
    "roles map<string,struct<calls:bigint,retries:bigint,errors:bigint,prompt_tokens:bigint,completion_tokens:bigint>>"
)
