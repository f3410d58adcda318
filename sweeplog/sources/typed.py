"""Typed tables from raw log lines: tab-separated logs that carry their own header, and lease lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.functions.lines import MAX_HEADER_LINES, utc_instant
from sweeplog.session import join_small

KEYS = ["case_id", "file"]

# The 24 columns of a DNS log and their types.
DNS_COLUMNS = (
    ("ts", "time"), ("uid", "string"), ("id.orig_h", "addr"), ("id.orig_p", "port"), ("id.resp_h", "addr"),
    ("id.resp_p", "port"), ("proto", "enum"), ("trans_id", "count"), ("rtt", "interval"), ("query", "string"),
    ("qclass", "count"), ("qclass_name", "string"), ("qtype", "count"), ("qtype_name", "string"), ("rcode", "count"),
    ("rcode_name", "string"), ("AA", "bool"), ("TC", "bool"), ("RD", "bool"), ("RA", "bool"), ("Z", "count"),
    ("answers", "vector[string]"), ("TTLs", "vector[interval]"), ("rejected", "bool"),
)
UNSET, EMPTY, SET_SEPARATOR = "-", "(empty)", ","


def _typed(raw: Column, kind: str, separator: Column) -> Column:
    if kind.startswith("vector["):
        inner = kind[len("vector["):-1]
        empty = F.array().cast("array<string>")
        items = F.when(raw == EMPTY, empty).otherwise(F.split(raw, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1))
        if inner in ("interval", "time"):
            return F.transform(items, lambda v: v.try_cast("double"))
        return items
    if kind in ("time", "interval"):
        return raw.try_cast("double")
    if kind in ("port", "count"):
        return raw.try_cast("bigint")
    if kind == "bool":
        return F.when(raw == "T", True).when(raw == "F", False)
    return F.when(raw == EMPTY, F.lit("")).otherwise(raw)


def headers(lines: DataFrame) -> DataFrame:
    """Field names and marks of each file from its leading `#` lines, at most 12."""
    top = lines.filter((F.col("line_no") <= MAX_HEADER_LINES) & F.startswith("text", F.lit("#")))
    value = lambda mark: F.max(
        F.when(F.startswith("text", F.lit(f"#{mark}\t")), F.substring("text", len(mark) + 3, 1 << 30))
    )
    return top.groupBy(*KEYS).agg(
        value("fields").alias("_fields"),
        F.coalesce(value("unset_field"), F.lit(UNSET)).alias("_unset"),
        F.coalesce(value("set_separator"), F.lit(SET_SEPARATOR)).alias("_separator"),
    ).withColumn("_fields", F.split("_fields", "\t"))


def tab_separated(lines: DataFrame, columns: tuple[tuple[str, str], ...] = DNS_COLUMNS) -> DataFrame:
    """Rows of header-carrying logs (case_id, file, line_no, text) as typed columns, in whatever order a file has them.

    Dots in names become underscores. Fields a file does not have, and unset values, are null; rows whose field count
    differs from the header are marked `malformed`.
    """
    data = lines.filter(~F.startswith("text", F.lit("#")) & (F.col("text") != "")).select(*KEYS, "line_no", "text")
    # Where each column sits is looked up once per file, not once per line.
    places = headers(lines).select(
        *KEYS, "_unset", "_separator", F.size("_fields").alias("_width"),
        F.array(*[F.array_position("_fields", F.lit(name)) - 1 for name, _ in columns]).cast("array<int>").alias("_at"),
    )
    joined = join_small(data, places, KEYS, spread=["line_no"])
    parts = joined.withColumn("_parts", F.split("text", "\t", -1))
    raw = parts.select(
        *KEYS, "line_no", "_separator", (F.size("_parts") != F.col("_width")).alias("malformed"),
        *[F.nullif(F.get("_parts", F.col("_at")[i]), F.col("_unset")).alias(f"_raw{i}") for i in range(len(columns))],
    )
    return raw.select(
        *KEYS, "line_no", "malformed",
        *[
            _typed(F.col(f"_raw{i}"), kind, F.col("_separator")).alias(name.replace(".", "_"))
            for i, (name, kind) in enumerate(columns)
        ],
    )


LEASE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\w+) (\S+) (\S+) (\S+) lease=(\d+)\s*$"


def leases(lines: DataFrame) -> DataFrame:
    """Lease lines `date time ACK|RENEW ip mac host lease=n`; other lines are left out."""
    part = lambda i: F.regexp_extract("text", LEASE, i)
    return lines.filter(F.col("text").rlike(LEASE)).select(
        *KEYS, "line_no",
        utc_instant(part(1)).alias("ts"), part(2).alias("action"), part(3).alias("ip"), part(4).alias("mac"),
        part(5).alias("host"), part(6).try_cast("bigint").alias("lease_s"),
    )
