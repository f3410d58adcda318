"""Rules over reports, plans and directives. Each gives problem texts; none means valid.

The texts carry the phrases by which rejections are classified later, so both ends live here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplog.functions import lines as L

MAX_REPRESENTATIVE_REFS = 5

# Phrase tests in order of precedence, and the reason each one means.
REJECTION_PHRASES = (
    (("representative_refs", "limit is"), "refs_over_cap"),
    (("match_count",), "match_count_inconsistent"),
    (("not in slice",), "fabricated_reference"),
    (("positive result",), "hit_recorded_as_check"),
    (("no representative_refs",), "uncited_finding"),
    (("not valid JSON",), "invalid_json"),
)
TRUNCATION_PHRASE = "cut off at the token limit"
TRUNCATED_REASON = "truncated_at_token_limit"
OTHER_REASON = "other"

Rule = Callable[[], Column]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _keep(*candidates: Column) -> Column:
    return F.array_compact(F.array(*candidates))


def relevance_problems(report: Column) -> Column:
    """A report that calls its slice irrelevant may hold neither findings nor positive checks."""
    hits = F.transform(F.filter(report["checked_for"], lambda c: c["found"]), lambda c: L.quoted(c["checked_for"]))
    irrelevant = ~report["relevant"]
    return _keep(
        F.when(irrelevant & (F.size(report["findings"]) > 0), F.lit("a slice called irrelevant comes with findings.")),
        F.when(
            irrelevant & (F.size(hits) > 0),
            _text("a check of a slice called irrelevant has a positive result for ", F.array_join(hits, ", "), "."),
        ),
    )


def _ref_problems(refs: Column, label: Column, given: dict[str, Column]) -> Column:
    def check(ref: Column) -> Column:
        malformed = _text(label, " citation ", L.quoted(ref), " is malformed; the required form is '",
                          given["file"], ":L<line-number>'.")
        unknown = _text(label, " cites ", L.quoted(ref), ", which is not in slice ", given["slice_id"], " (lines ",
                        given["start_line"], "-", given["end_line"], " of ", given["file"], ").")
        inside = L.ref_within(ref, given["file"], given["start_line"], given["end_line"])
        return F.when(~L.is_well_formed_ref(ref), malformed).when(~inside, unknown)

    return F.array_compact(F.transform(refs, check))


def finding_problems(findings: Column, given: dict[str, Column]) -> Column:
    """Per finding: no refs, too many refs, count below refs, then every ref and both end points."""

    def check(finding: Column, index: Column) -> Column:
        label = _text("findings[", index, "]")
        refs = finding["representative_refs"]
        shape = _keep(
            F.when(F.size(refs) == 0, _text(label, " has no representative_refs; cite a line of slice ",
                                            given["slice_id"], ".")),
            F.when(F.size(refs) > MAX_REPRESENTATIVE_REFS,
                   _text(label, " returned ", F.size(refs), " representative_refs; the limit is ",
                         str(MAX_REPRESENTATIVE_REFS), ".")),
            F.when(finding["match_count"] < F.size(refs),
                   _text(label, " has match_count ", finding["match_count"], " but cites ", F.size(refs), " lines.")),
        )
        ends = F.filter(F.array(finding["first_ref"], finding["last_ref"]), lambda r: r != "")
        return F.concat(
            shape,
            _ref_problems(refs, label, given),
            _ref_problems(ends, _text(label, " endpoints"), given),
        )

    return F.flatten(F.transform(findings, check))


def report_problems(report: Column, given: dict[str, Column]) -> Column:
    """All problems of a report against the slice it was made from (slice_id, file, start_line, end_line)."""
    echoed = report["slice_metadata"]["slice_id"]
    mismatch = _keep(
        F.when(echoed != given["slice_id"],
               _text("slice_metadata.slice_id is ", L.quoted(echoed), " but this task's slice is ",
                     L.quoted(given["slice_id"]), "."))
    )
    return F.concat(relevance_problems(report), finding_problems(report["findings"], given), mismatch)


def truncation_problems(finish_reason: Column, completion_tokens: Column) -> Column:
    """Names the real cause when a reply hit the token limit."""
    told = _text("Your reply was ", TRUNCATION_PHRASE, " (", F.coalesce(completion_tokens.cast("string"), F.lit("max")),
                 " tokens); report an aggregate with few representative_refs.")
    return _keep(F.when(finish_reason == "length", told))


def failure_reason(problems: Column, compat: bool = False) -> Column:
    """Reason filed when the last attempt is rejected.

    With `compat` a truncated reply counts as `citations` and a malformed ref as `schema`; otherwise the first is
    `truncated` and the second `citations`.
    """
    cited = F.exists(problems, lambda p: F.contains(p, F.lit("cite")) | F.contains(p, F.lit("representative_refs")))
    if compat:
        return F.when(cited, F.lit("citations")).otherwise(F.lit("schema"))
    truncated = F.exists(problems, lambda p: F.contains(p, F.lit(TRUNCATION_PHRASE)))
    malformed = F.exists(problems, lambda p: F.contains(p, F.lit("citation")))
    return (
        F.when(truncated, F.lit("truncated")).when(cited | malformed, F.lit("citations")).otherwise(F.lit("schema"))
    )


def rejection_reasons(problems: Column) -> Column:
    """Distinct reasons of one rejected report; truncation hides the rest."""

    def classify(problem: Column) -> Column:
        chosen = None
        for phrases, reason in REJECTION_PHRASES:
            test = F.lit(True)
            for phrase in phrases:
                test = test & F.contains(problem, F.lit(phrase))
            chosen = F.when(test, F.lit(reason)) if chosen is None else chosen.when(test, F.lit(reason))
        return chosen.otherwise(F.lit(OTHER_REASON))

    truncated = F.exists(problems, lambda p: F.contains(p, F.lit(TRUNCATION_PHRASE)))
    return F.when(truncated, F.array(F.lit(TRUNCATED_REASON))).otherwise(
        F.array_distinct(F.transform(problems, classify))
    )


def directive_problems(relevance: Column, indicators: Column) -> Column:
    blank = L.python_strip(relevance) == ""
    return _keep(
        F.when(blank, F.lit("relevance_criteria is empty; without it workers can only match strings.")),
        F.when(blank & (F.size(indicators) == 0), F.lit("give at least one indicator or a relevance rule.")),
    )


def plan_size_problem(tasks: Column, limit: int) -> Column:
    return F.when(tasks > limit, _text(tasks, " tasks are planned; a round takes ", str(limit), " at most."))


def task_problems(index: Column, slice_id: Column, known: Column, intent: Column) -> Column:
    label = _text("tasks[", index, "]")
    return _keep(
        F.when(~known, _text(label, ".slice_id ", L.quoted(slice_id), " is not a slice in this case.")),
        F.when(L.python_strip(intent) == "", _text(label, ".commander_intent is blank: name what the read is to settle.")),
    )


def with_rules(base: Column, *rules: Column) -> Column:
    """Add user-written rules, each a column of problem texts, to the built-in ones."""
    return F.concat(base, *[F.coalesce(rule, F.array().cast("array<string>")) for rule in rules])
