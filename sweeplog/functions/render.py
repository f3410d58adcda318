"""Text blocks for a reader: a fenced slice, a fenced alert, multi-line strings as arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the blocks.
FENCE_OPEN = "<<<UNTRUSTED_DATA"
FENCE_CLOSE = ">>>END_UNTRUSTED_DATA"


def _attributes(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in pairs])


def _fence(attributes: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(FENCE_OPEN + " "), attributes), body, F.lit(FENCE_CLOSE))


def fence_slice() -> Column:
    """Block of one slice; expects the slice columns plus `lines array<struct<line_no,ref,text>>`."""
    c = F.col
    attributes = _attributes(
        [
            ("kind", F.lit("raw_log_slice")),
            ("slice_id", c("slice_id")),
            ("source", c("source")),
            ("host", c("host")),
            ("file", c("file")),
            ("time_range", c("time_range")),
            ("lines", F.concat_ws("-", c("start_line"), c("end_line"))),
            ("cite_as", F.concat(c("file"), F.lit(":L<line-number>"))),
            ("shown_because", c("reason")),
        ]
    )
    rows = F.array_join(F.transform("lines", lambda r: F.concat(r["ref"], F.lit("\t"), r["text"])), "\n")
    header = F.array_join(F.transform("format_header", lambda t: F.concat(F.lit("  "), t)), "\n")
    headed = F.concat_ws(
        "\n",
        F.concat(
            F.lit("[format header for "), c("file"),
            F.lit(", reproduced from the top of the file -- context only, NOT part of this slice and NOT citable]"),
        ),
        header,
        F.lit("[end format header; the citable lines of this slice follow]"),
        rows,
    )
    return _fence(attributes, F.when(F.size("format_header") > 0, headed).otherwise(rows))


def fence_alert() -> Column:
    """Block of one alert; detector fields sorted by key."""
    c = F.col
    attributes = _attributes(
        [
            ("kind", F.lit("external_alert")),
            ("detector", c("detector")),
            ("alert_id", c("alert_id")),
            ("authority", F.lit("external_detector_owns_status_and_severity")),
        ]
    )
    entities = F.transform(
        F.coalesce("entities", F.array()),
        lambda e: F.rtrim(
            F.concat(F.lit("  "), e["kind"], F.lit("="), e["value"], F.lit(" "), F.coalesce(e["note"], F.lit("")))
        ),
    )
    fields = F.transform(
        F.array_sort(F.map_entries(F.coalesce("raw_detector_fields", F.create_map()))),
        lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"]),
    )
    owned = F.concat(F.lit(" (READ-ONLY, owned by "), c("detector"), F.lit("): "))
    none = F.lit("  (none)")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("rule_name: "), c("rule_name")),
        F.concat(F.lit("status"), owned, c("status")),
        F.concat(F.lit("severity"), owned, c("severity")),
        F.concat(F.lit("first_seen: "), c("first_seen")),
        F.concat(F.lit("last_seen: "), c("last_seen")),
        F.concat(F.lit("summary: "), c("summary")),
        F.lit("entities:"),
        F.when(F.size(entities) > 0, F.array_join(entities, "\n")).otherwise(none),
        F.lit("detector_fields:"),
        F.when(F.size(fields) > 0, F.array_join(fields, "\n")).otherwise(none),
    )
    return _fence(attributes, body)


def split_multiline(text: Column) -> Column:
    """Lines of a text; join them with a newline to get the text back."""
    return F.split(text, "\n", -1)
