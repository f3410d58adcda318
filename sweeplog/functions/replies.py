"""Model replies as closed, typed records."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplog.functions.lines import python_strip

# Type names as the variant reader reports them.
INTEGER, TEXT, FLAG, LIST, OBJECT = "BIGINT", "STRING", "BOOLEAN", "ARRAY<", "OBJECT<"

SLICE_METADATA = {"slice_id": TEXT, "file": TEXT, "lines_examined": INTEGER}
FINDING = {
    "description": TEXT, "match_count": INTEGER, "representative_refs": LIST,
    "first_ref": TEXT, "last_ref": TEXT, "confidence": TEXT,
}
CHECK = {"checked_for": TEXT, "found": FLAG, "result": TEXT}
REPORT = {"slice_metadata": OBJECT, "relevant": FLAG, "findings": LIST, "checked_for": LIST}
CONFIDENCES = ("low", "medium", "high")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, however often `body` names it. Plain columns are worked out at each naming."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_fences(text: Column) -> Column:
    """Reply without a surrounding code fence."""

    def stripped(body: Column) -> Column:
        opened = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"(?s)^[^\n]*\n", "")).otherwise(body)
        closed = F.regexp_replace(opened, r"(?sU)```\s*$", "")
        return F.when(F.startswith(body, F.lit("```")), python_strip(closed)).otherwise(body)

    return once(python_strip(text), stripped)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def object_problems(value: Column, fields: dict[str, str], optional: tuple[str, ...] = (), prefix: Column | None = None) -> Column:
    """Missing, mistyped and unknown fields of a variant that is an object."""
    prefix = F.lit("") if prefix is None else prefix

    def problems(kinds: Column) -> Column:
        checks = []
        for name, wanted in fields.items():
            kind = F.try_element_at(kinds, F.lit(name))
            label = F.concat(F.lit("field "), prefix, F.lit(name))
            if name not in optional:
                checks.append(F.when(kind.isNull(), F.concat(label, F.lit(": Field required"))))
            checks.append(F.when(~F.startswith(kind, F.lit(wanted)), F.concat(label, F.lit(f": expected {wanted.rstrip('<')}"))))
        keys = F.coalesce(F.map_keys(kinds), F.array().cast("array<string>"))
        unknown = F.transform(
            F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in fields]))),
            lambda k: F.concat(F.lit("field "), prefix, k, F.lit(": Extra inputs are not permitted")),
        )
        return F.concat(F.array_compact(F.array(*checks)), unknown)

    held = F.try_variant_get(value, "$", "map<string,variant>")
    return once(F.transform_values(held, lambda k, v: _kind(v)), problems)


def parse_problems(text: Column, fields: dict[str, str], optional: tuple[str, ...] = (),
                   nested: Callable[[Column], Column] | None = None) -> Column:
    """Problems of a reply: not JSON, not an object, else its fields and what `nested` finds in the parsed reply."""
    return _body_problems(strip_fences(text), fields, optional, nested)


def _body_problems(body: Column, fields: dict[str, str], optional: tuple[str, ...] = (),
                   nested: Callable[[Column], Column] | None = None) -> Column:
    """parse_problems of a reply whose fence is off."""

    def problems(value: Column) -> Column:
        shaped = object_problems(value, fields, optional)
        if nested is not None:
            shaped = F.concat(shaped, nested(value))
        return (
            F.when(value.isNull(), F.array(F.lit("Response was not valid JSON. Return one JSON object and nothing else.")))
            .when(~F.startswith(_kind(value), F.lit(OBJECT)),
                  F.array(F.lit("Response must be a single JSON object, not a bare value or list.")))
            .otherwise(shaped)
        )

    return once(F.try_parse_json(body), problems)


def _elements(value: Column, path: str, fields: dict[str, str], optional: tuple[str, ...] = ()) -> Column:
    items = F.coalesce(F.try_variant_get(value, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(
        F.transform(
            items,
            lambda item, i: object_problems(
                item, fields, optional, F.concat(F.lit(f"{path}."), i.cast("string"), F.lit("."))
            ),
        )
    )


def _report_parts(value: Column) -> Column:
    metadata = F.variant_get(value, "$.slice_metadata", "variant")
    confidence = F.transform(
        F.coalesce(F.try_variant_get(value, "$.findings", "array<variant>"), F.array().cast("array<variant>")),
        lambda f, i: F.when(
            ~F.coalesce(F.try_variant_get(f, "$.confidence", "string"), F.lit("low")).isin(*CONFIDENCES),
            F.concat(F.lit("field findings."), i.cast("string"), F.lit(".confidence: Input should be 'low', 'medium' or 'high'")),
        ),
    )
    return F.concat(
        F.when(F.startswith(_kind(metadata), F.lit(OBJECT)),
               object_problems(metadata, SLICE_METADATA, prefix=F.lit("slice_metadata.")))
        .otherwise(F.array().cast("array<string>")),
        _elements(value, "findings", FINDING, ("representative_refs",)),
        _elements(value, "checked_for", CHECK),
        F.array_compact(confidence),
    )


def report_reply_problems(text: Column) -> Column:
    """Field problems of a worker report, with its nested records."""
    return parse_problems(text, REPORT, ("findings", "checked_for"), _report_parts)


def _listed(fields: dict[str, str]) -> str:
    """Pattern of the kind of a list that is empty or holds objects with these fields only."""
    each = ", ".join(f"{name}: " + ("ARRAY<(?:STRING|VOID)>" if kind == LIST else kind) for name, kind in sorted(fields.items()))
    return f"ARRAY<(?:VOID|OBJECT<{each}>)>"


_METADATA = "OBJECT<" + ", ".join(f"{name}: {kind}" for name, kind in sorted(SLICE_METADATA.items())) + ">"
_PLAIN = f"^OBJECT<checked_for: {_listed(CHECK)}, findings: {_listed(FINDING)}, relevant: {FLAG}, slice_metadata: {_METADATA}>$"


def _plain(body: Column, report: Column) -> Column:
    """Whether a reply surely has no problem: one look at its kind and at the typed report.

    Kinds of a list's elements come as one, which hides a field that some of them lack or hold as null; typed, that is a null. False and
    null say nothing: such a reply goes through all rules.
    """
    lacking = lambda fields: lambda item: functools.reduce(lambda a, b: a | b, [item[name].isNull() for name in fields], item.isNull())
    filled = report["relevant"].isNotNull() & ~F.exists(F.array(report["slice_metadata"]), lacking(SLICE_METADATA))
    filled &= ~F.exists(report["findings"], lacking(FINDING)) & ~F.exists(report["checked_for"], lacking(CHECK))
    known = F.forall(report["findings"], lambda f: f["confidence"].isin(*CONFIDENCES))
    return _kind(F.try_parse_json(body)).rlike(_PLAIN) & filled & known


def read_report(text: Column, report_ddl: str) -> Column:
    """problems (as `report_reply_problems`; null without a reply) and report (as `parse_report`; null with problems) of a reply, whose
    text is stripped once and goes through the single rules only where its kind is not that of a plain report."""

    def read(body: Column) -> Column:
        def held(report: Column) -> Column:
            problems = F.when(_plain(body, report), F.array().cast("array<string>")).otherwise(_body_problems(body, REPORT, ("findings", "checked_for"), _report_parts))
            return once(problems, lambda p: F.struct(p.alias("problems"), F.when(F.size(p) == 0, report).alias("report")))

        return once(_typed(body, report_ddl), held)

    return once(strip_fences(text), read)


def parse_report(text: Column, report_ddl: str) -> Column:
    """Typed report, null where the reply has problems; absent lists become empty."""
    return _typed(strip_fences(text), report_ddl)


def _typed(body: Column, report_ddl: str) -> Column:
    whole = lambda parsed: F.when(
        parsed.isNotNull(),
        parsed.withField("findings", F.coalesce(parsed["findings"], F.from_json(F.lit("[]"), "array<" + _inner(report_ddl, "findings") + ">")))
        .withField("checked_for", F.coalesce(parsed["checked_for"], F.from_json(F.lit("[]"), "array<" + _inner(report_ddl, "checked_for") + ">"))),
    )
    return once(F.from_json(body, report_ddl), whole)


def _inner(ddl: str, field: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL("r " + ddl)["r"].dataType[field].dataType.elementType.simpleString()
