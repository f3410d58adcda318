"""Citations against the lines that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.functions import problems as P
from sweeplog.operators.slices import chunk, per_chunk


def _given(prefix: str = "") -> dict:
    return {name: F.col(prefix + name) for name in ("slice_id", "file", "start_line", "end_line")}


def with_problems(reports: DataFrame, slices: DataFrame | None, *rules) -> DataFrame:
    """Add `problems`: every rule a report breaks against the slice it was made from. Extra rules are columns.

    Without `slices` the reports hold the file, start_line and end_line of their slices themselves, and do not move.
    """
    checked = lambda given: P.with_rules(P.report_problems(F.col("report"), given), *rules)
    if slices is None:
        return reports.withColumn("problems", checked(_given()))
    known = slices.select("case_id", "slice_id", "file", "start_line", "end_line")
    shared = [c for c in ("file", "start_line", "end_line") if c in reports.columns]
    joined = reports.drop(*shared).join(known, ["case_id", "slice_id"])
    return joined.withColumn("problems", checked(_given()))


def cited_refs(reports: DataFrame) -> DataFrame:
    """Every ref of every report: samples and non-empty end points, one row each."""
    per_finding = F.transform(
        F.col("report.findings"),
        lambda f: F.concat(f["representative_refs"], F.filter(F.array(f["first_ref"], f["last_ref"]), lambda r: r != "")),
    )
    return reports.select("case_id", "slice_id", F.explode(F.flatten(per_finding)).alias("ref"))


def fabricated_refs(reports: DataFrame, slices: DataFrame) -> DataFrame:
    """Distinct well-formed refs that are not lines of the slice the worker was given."""
    refs = cited_refs(reports).filter(L.is_well_formed_ref(F.col("ref"))).distinct()
    known = slices.select("case_id", "slice_id", "file", "start_line", "end_line")
    inside = L.ref_within(F.col("ref"), F.col("file"), F.col("start_line"), F.col("end_line"))
    return refs.join(known, ["case_id", "slice_id"]).filter(~inside).select("case_id", "slice_id", "ref")


def unresolved_refs(cited: DataFrame, inventory: DataFrame) -> DataFrame:
    """Distinct cited refs (case_id, ref) that no line of the case carries, from the line count of each file."""
    refs = cited.select("case_id", "ref").distinct().select(
        "case_id", "ref", L.ref_file(F.col("ref")).alias("file"), L.ref_line(F.col("ref")).alias("_line")
    )
    known = per_chunk(inventory.select("case_id", "file", "line_count"))
    exists = F.col("_line").between(F.lit(1), F.col("line_count"))
    return (
        refs.withColumn("_chunk", chunk(F.col("_line")))
        .join(known, ["case_id", "file", "_chunk"], "left")
        .filter(~F.coalesce(exists, F.lit(False)))
        .select("case_id", "ref")
    )


def known_refs(lines: DataFrame) -> DataFrame:
    """Refs of a case. File and line number make them unique, so nothing is shuffled."""
    return lines.select("case_id", L.line_ref(F.col("file"), F.col("line_no")).alias("ref"))


def uncitable_files(inventory: DataFrame) -> DataFrame:
    """Files whose names fall outside the ref grammar, so that no line of them can be cited validly."""
    ref = L.line_ref(F.col("file"), F.lit(1))
    return inventory.filter(~L.is_well_formed_ref(ref)).select("case_id", "file", "line_count")
