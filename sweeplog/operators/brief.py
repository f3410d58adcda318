"""The parts of an evidence brief that are computed: alert copy, claims and their citations, timeline, quality counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.operators.citations import unresolved_refs
from sweeplog.session import materialize

EXCERPT = 120
ALERT_FIELDS = ("alert_id", "detector", "rule_name", "status", "severity")


def alert_copy(alerts: DataFrame) -> DataFrame:
    """Status and severity as the detector wrote them."""
    return alerts.select("case_id", *ALERT_FIELDS)


def claims(bodies: DataFrame) -> DataFrame:
    """Timeline events and both evidence lists of every hypothesis, each with its locator.

    `bodies`: case_id, investigation_id, timeline, hypotheses.
    """
    ids = ["case_id", "investigation_id"]
    events = bodies.select(*ids, F.posexplode("timeline").alias("_i", "_c")).select(
        *ids, F.format_string("timeline[%d]", "_i").alias("locator"), "_c.description", "_c.raw_line_refs"
    )
    hypotheses = bodies.select(*ids, F.posexplode("hypotheses").alias("_h", "_hypothesis"))
    out = events
    for field in ("supporting_evidence", "contradicting_evidence"):
        listed = hypotheses.select(*ids, "_h", F.posexplode(f"_hypothesis.{field}").alias("_e", "_c")).select(
            *ids, F.format_string(f"hypotheses[%d].{field}[%d]", "_h", "_e").alias("locator"),
            "_c.description", "_c.raw_line_refs",
        )
        out = out.unionByName(listed)
    return out


def uncited_claims(found: DataFrame) -> DataFrame:
    """Claims without any line reference: locator and the first 120 characters."""
    return found.filter(F.size("raw_line_refs") == 0).select(
        "case_id", "investigation_id",
        F.concat("locator", F.lit(": "), F.substring("description", 1, EXCERPT)).alias("claim"),
    )


def claim_refs(found: DataFrame) -> DataFrame:
    return found.select("case_id", "investigation_id", F.explode("raw_line_refs").alias("ref"))


def timeline(findings: DataFrame) -> DataFrame:
    """First and last line of each finding with the stamp on that line; typed instant where the stamp has one."""
    ends = F.array(
        F.struct(F.lit("first").alias("endpoint"), F.col("first_ref").alias("ref"), F.col("first_ts").alias("raw_ts")),
        F.struct(F.lit("last").alias("endpoint"), F.col("last_ref").alias("ref"), F.col("last_ts").alias("raw_ts")),
    )
    rows = findings.select("case_id", "slice_id", "indicator", "description", "match_count", F.explode(ends).alias("_e"))
    return rows.select(
        "case_id", "slice_id", "indicator", "description", "match_count", "_e.endpoint", "_e.ref", "_e.raw_ts",
        L.typed_timestamp(F.col("_e.raw_ts")).alias("ts"),
    )


def quality_counts(bodies: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per brief: unresolved citations, uncited claims, timeline events, hypotheses, narrative length."""
    ids = ["case_id", "investigation_id"]
    found = claims(bodies)
    refs = claim_refs(found)
    unresolved = refs.join(unresolved_refs(refs, inventory), ["case_id", "ref"]).groupBy(*ids).agg(
        F.countDistinct("ref").alias("unresolved_citations")
    )
    uncited = uncited_claims(found).groupBy(*ids).agg(F.count("*").alias("uncited_claims"))
    zero = F.lit(0).cast("bigint")
    length = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), zero).cast("bigint")
    return (
        bodies.join(unresolved, ids, "left").join(uncited, ids, "left")
        .select(
            *ids,
            F.coalesce("unresolved_citations", zero).alias("unresolved_citations"),
            F.coalesce("uncited_claims", zero).alias("uncited_claims"),
            length("timeline").alias("timeline_events"),
            length("hypotheses").alias("hypotheses"),
            F.coalesce(F.length("investigation_narrative"), zero).cast("bigint").alias("narrative_chars"),
        )
    )


def briefs(alerts: DataFrame, coverage: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per case: the alert as copied, what was swept, and how much text addressed an AI system."""
    flagged = signals.groupBy("case_id").agg(F.count("*").alias("injection_signals"))
    zero = F.lit(0).cast("bigint")
    return (
        alert_copy(alerts).join(coverage, "case_id", "left").join(flagged, "case_id", "left")
        .select(
            "case_id", *ALERT_FIELDS,
            *[F.coalesce(c, zero).alias(c) for c in ("slices_swept", "iterations_used", "detailed", "empty", "failed", "findings", "matching_lines")],
            F.coalesce("injection_signals", zero).alias("injection_signals"),
        )
    )


def records(briefs: DataFrame, bodies: DataFrame, inventory: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """One row per investigation: its case's brief with what is stamped on it whatever the body says.

    That is the state in which the run ended (empty where no log tells), whether an operator aborted it, the cited refs that no line
    carries, and the claims without any ref. Both lists are parts of the body, so no longer than it.
    """
    ids = ["case_id", "investigation_id"]
    found = materialize(claims(bodies), "claims")
    refs = claim_refs(found)
    bad = refs.distinct().join(unresolved_refs(refs, inventory), ["case_id", "ref"]).groupBy(*ids).agg(
        F.array_sort(F.collect_list("ref")).alias("unresolved_citations")
    )
    uncited = uncited_claims(found).groupBy(*ids).agg(F.array_sort(F.collect_list("claim")).alias("uncited_claims"))
    out = bodies.select(*ids).join(briefs, "case_id").join(bad, ids, "left").join(uncited, ids, "left")
    if states is None:
        ended = out.withColumn("_state", F.lit(None).cast("string")).withColumn("_aborted", F.lit(None).cast("boolean"))
    else:
        ended = out.join(states.select("investigation_id", F.col("final_state").alias("_state"), F.col("aborted_by_operator").alias("_aborted")), "investigation_id", "left")
    none = F.array().cast("array<string>")
    return ended.select(
        *ids, *[c for c in briefs.columns if c != "case_id"],
        F.coalesce("_state", F.lit("")).alias("terminal_state"), F.coalesce("_aborted", F.lit(False)).alias("aborted_by_operator"),
        F.coalesce("unresolved_citations", none).alias("unresolved_citations"), F.coalesce("uncited_claims", none).alias("uncited_claims"),
    )
