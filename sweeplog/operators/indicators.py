"""Indicators of an alert, their matches in lines, and findings as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.functions import lines as L
from sweeplog.functions import render
from sweeplog.functions.problems import MAX_REPRESENTATIVE_REFS
from sweeplog.operators.slices import KEYS, locate
from sweeplog.session import join_small, materialize

# More indicators of a case than this are looked for by their seeds.
FEW = 64
# Characters of a seed, different seeds that are listed in a plan, and lines from which a seed's frequency is told.
SEED = 4
LISTED_SEEDS = 100_000
SAMPLE_LINES = 20_000
# Lines of a file whose hits are put together before its parts are.
PART_LINES = 1 << 20
# How the result of a check begins that found its subject only beyond the time window.
OUTSIDE = "outside the time window only: "


def directives(alerts: DataFrame, *, relevance: str = "any line that names one of the indicators",
               irrelevant: list[str] | None = None, time_window: str = "", per_kind: int | None = None) -> DataFrame:
    """One directive per case: indicators are the alert's domains, then addresses, then entity values, each once.

    `per_kind` limits the domains and addresses; by default all are taken.
    """
    named = F.filter(F.transform("entities", lambda e: e["value"]), lambda v: v != "")
    found = F.concat(L.text_indicators(render.fence_alert(), per_kind), F.coalesce(named, F.array().cast("array<string>")))
    return alerts.select(
        "case_id",
        F.col("summary").alias("alert_restatement"),
        F.array_distinct(found).alias("indicators"),
        F.lit(relevance).alias("relevance_criteria"),
        F.array(*[F.lit(t) for t in irrelevant or []]).cast("array<string>").alias("explicitly_irrelevant"),
        F.lit(time_window).alias("time_window"),
    )


def with_directive(lines: DataFrame, directive: DataFrame, *columns: str, stored: bool = False) -> DataFrame:
    """Attach directive columns to every row of a case; the directive side is broadcast only if its size allows."""
    return join_small(lines, directive.select("case_id", *columns), ["case_id"], spread=["file", "line_no"], stored=stored)


def indicator_hits(lines: DataFrame, directive: DataFrame, *, indexed: bool | None = None) -> DataFrame:
    """(case_id, file, line_no, indicator, raw_ts) for every indicator a line contains. Lines do not move.

    Up to `FEW` indicators of a case are looked for one by one, more of them by their seeds (`seeded_hits`), which gives the same rows;
    `indexed` decides otherwise. An empty indicator is in no line, a repeated one counts once.
    """
    directive = materialize(directive.select("case_id", F.array_distinct(F.filter("indicators", lambda i: i != "")).alias("indicators")), "indicators")
    lines = lines.select(*KEYS, "line_no", "text")
    if indexed is None:
        indexed = (directive.agg(F.max(F.size("indicators")).alias("n")).first()["n"] or 0) > FEW
    if indexed:
        return seeded_hits(lines, directive)
    joined = with_directive(lines, directive, "indicators", stored=True)
    named = F.filter("indicators", lambda i: F.contains(F.col("text"), i))
    return _stamped(joined.select(*KEYS, "line_no", "text", F.explode(named).alias("indicator")))


def _stamped(hits: DataFrame) -> DataFrame:
    return hits.select(*KEYS, "line_no", "indicator", L.first_timestamp(F.col("text")).alias("raw_ts"))


def _grams(text: Column, size: Column) -> Column:
    """Every run of `size` characters of a text; the match looks ahead, so that runs overlap."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))


def seed_index(directive: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, seed, indicators): each indicator under one run of `SEED` of its characters (all of a shorter one).

    The run is the one that the first `SAMPLE_LINES` lines hold least often. Which one is taken decides how many lines are looked at
    twice, not what is found.
    """
    each = directive.select("case_id", F.explode(F.array_distinct("indicators")).alias("indicator")).filter("indicator <> ''")
    size = F.least(F.length("indicator"), F.lit(SEED))
    runs = materialize(each.select("*", F.explode(F.array_distinct(_grams(F.col("indicator"), size))).alias("seed")), "seed-runs")
    seen = lines.limit(SAMPLE_LINES).select(F.explode(F.array_distinct(_grams(F.col("text"), F.lit(SEED)))).alias("seed"))
    rated = join_small(runs, seen.groupBy("seed").agg(F.count("*").alias("_n")), ["seed"], "left", spread=["indicator"])
    rarest = rated.groupBy("case_id", "indicator").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("seed"))).alias("_best"))
    return rarest.groupBy("case_id", F.col("_best.seed").alias("seed")).agg(F.collect_list("indicator").alias("indicators"))


def seeded_hits(lines: DataFrame, directive: DataFrame) -> DataFrame:
    """The rows of `indicator_hits` by an equi-join of the runs of characters of a line with the seeds of the indicators.

    What a line costs depends on its length and on the seeds it holds, not on the number of indicators. Runs that are no seed are
    left out where the line is read, up to `LISTED_SEEDS` different seeds; beyond, all runs of a line go to the join.
    """
    index = materialize(seed_index(directive, lines), "seed-index")
    known = index.select(F.crc32(F.col("seed").cast("binary")).alias("code"), F.length("seed").alias("size")).distinct()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most SEED of them
    if not sizes:
        return _stamped(lines.withColumn("indicator", F.lit(None).cast("string")).limit(0))
    runs = F.array_distinct(F.concat(*[_grams(F.col("text"), F.lit(k)) for k in sizes]))
    found = lines.withColumn("_runs", runs)
    codes = known.select("code").distinct().limit(LISTED_SEEDS + 1).collect()
    if len(codes) <= LISTED_SEEDS:
        listed = ", ".join(f"{r['code']}L" for r in codes)
        found = found.withColumn("_runs", F.expr(f"filter(_runs, g -> crc32(cast(g AS binary)) IN ({listed}))"))
    found = found.select(*KEYS, "line_no", "text", F.explode("_runs").alias("seed"))
    joined = join_small(found, index, ["case_id", "seed"], spread=["file", "line_no"], stored=True)
    named = F.filter("indicators", lambda i: F.contains(F.col("text"), i))
    return _stamped(joined.select(*KEYS, "line_no", "text", F.explode(named).alias("indicator")))


def mark_window(hits: DataFrame, directive: DataFrame) -> DataFrame:
    """Hits with `in_window`: whether their stamp lies in their directive's `start/end`. A hit without an instant is inside, and an
    empty window holds all."""
    joined = with_directive(hits, directive, "time_window")
    ends = F.split("time_window", "/")
    ts = L.typed_timestamp(F.col("raw_ts"))
    inside = (F.col("time_window") == "") | ts.between(L.utc_instant(F.get(ends, F.lit(0))), L.utc_instant(F.get(ends, F.lit(1))))
    return joined.withColumn("in_window", F.coalesce(inside, F.lit(True))).drop("time_window")


def hits_in_window(hits: DataFrame, directive: DataFrame) -> DataFrame:
    """Hits whose stamp lies in their directive's `start/end`; hits without an instant stay, an empty window keeps all."""
    return mark_window(hits, directive).filter("in_window").drop("in_window")


def token_hits(lines: DataFrame, indicators: DataFrame) -> DataFrame:
    """Whole-token matches for long indicator lists (case_id, indicator): tokens are extracted, then equi-joined.

    A domain also matches under each of its parent domains.
    """
    domains = F.regexp_extract_all("text", F.lit(L.UNICODE + L.DOMAIN), F.lit(0))
    addresses = F.regexp_extract_all("text", F.lit(L.UNICODE + L.IPV4), F.lit(0))

    def parents(domain: Column) -> Column:
        labels = F.split(domain, r"\.")
        starts = F.sequence(F.lit(1), F.size(labels) - 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    spelled = F.array_distinct(F.concat(F.flatten(F.transform(domains, parents)), addresses))
    found = lines.select(*KEYS, "line_no", F.explode(spelled).alias("indicator"))
    wanted = indicators.select("case_id", "indicator").distinct()
    return join_small(found, wanted, ["case_id", "indicator"], spread=["file", "line_no"])


def _refs(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: L.line_ref(F.col("file"), n))


def mentions(hits: DataFrame) -> DataFrame:
    """Per file and indicator: how often, first and last line, and the first five refs.

    Hits are read once: parts of `PART_LINES` lines of a file keep their count, ends and first five lines, and the parts are put
    together, so a hot file's hits are spread over its parts.
    """
    keys = [*KEYS, "indicator"]
    few = lambda numbers: F.slice(F.array_sort(numbers), 1, MAX_REPRESENTATIVE_REFS)
    part = F.floor(F.col("line_no") / PART_LINES).alias("_part")
    parts = hits.groupBy(*keys, part).agg(
        F.count("*").alias("_n"), F.min("line_no").alias("_from"), F.max("line_no").alias("_to"), few(F.collect_list("line_no")).alias("_few")
    )
    whole = parts.groupBy(*keys).agg(
        F.sum("_n").alias("match_count"), F.min("_from").alias("_first"), F.max("_to").alias("_last"), few(F.flatten(F.collect_list("_few"))).alias("_samples")
    )
    return whole.select(
        *keys,
        "match_count",
        L.line_ref(F.col("file"), F.col("_first")).alias("first_ref"),
        L.line_ref(F.col("file"), F.col("_last")).alias("last_ref"),
        _refs(F.col("_samples")).alias("representative_refs"),
    )


def findings(hits: DataFrame, slices: DataFrame, *, budget: int) -> DataFrame:
    """Per slice and indicator: count, end points with their stamps, at most five refs, and the lines outside the time window.

    Hits that `mark_window` puts outside the window are counted apart; a row with no others has a match_count of 0. A slice
    holds at most budget/12 lines, so its line numbers fit one small list.
    """
    inside = F.col("in_window") if "in_window" in hits.columns else F.lit(True)
    placed = locate(hits.withColumn("_line", F.when(inside, F.col("line_no"))), slices, budget=budget)
    keys = [*KEYS, "slice_id", "window_index", "indicator"]
    numbers = F.array_sort(F.collect_list("_line"))
    return placed.groupBy(*keys).agg(
        F.count("_line").alias("match_count"),
        F.count_if(F.col("_line").isNull()).alias("outside"),
        F.slice(numbers, 1, MAX_REPRESENTATIVE_REFS).alias("_samples"),
        F.min("_line").alias("first_line"),
        F.max("_line").alias("last_line"),
        F.min_by("raw_ts", "_line").alias("first_ts"),
        F.max_by("raw_ts", "_line").alias("last_ts"),
    ).select(
        *keys,
        F.concat(F.lit("lines that contain "), L.quoted(F.col("indicator"))).alias("description"),
        "match_count",
        _refs(F.col("_samples")).alias("representative_refs"),
        L.line_ref(F.col("file"), F.col("first_line")).alias("first_ref"),
        L.line_ref(F.col("file"), F.col("last_line")).alias("last_ref"),
        F.lit("high").alias("confidence"),
        "first_line", "last_line", "first_ts", "last_ts", "outside",
    )


def line_totals(hits: DataFrame) -> DataFrame:
    """Per case: matches summed over indicators, and matching lines counted once."""
    once = hits.groupBy(*KEYS, "line_no").agg(F.count("*").alias("_n"))
    return once.groupBy("case_id").agg(
        F.sum("_n").alias("summed_matches"), F.count("*").alias("distinct_lines")
    )


def cross_file(hits: DataFrame) -> DataFrame:
    """Indicators seen in more than one file of a case, one row per file. Grouped; no pairs of files are formed, hits are read once."""
    per_file = materialize(hits.groupBy("case_id", "indicator", "file").agg(
        F.count("*").alias("line_count"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    ), "hits-per-file")
    spread = per_file.groupBy("case_id", "indicator").agg(F.count("*").alias("files")).filter("files > 1")
    return join_small(per_file, spread, ["case_id", "indicator"], spread=["file"])


def within_window(lines: DataFrame, directive: DataFrame, *, keep_untimed: bool = True) -> DataFrame:
    """Lines inside the directive's `start/end`; an empty window keeps all, lines without an instant are kept by default."""
    joined = with_directive(lines, directive, "time_window")
    ends = F.split("time_window", "/")
    bound = lambda i: L.utc_instant(F.get(ends, F.lit(i)))
    ts = L.typed_timestamp(L.first_timestamp(F.col("text")))
    keep = (F.col("time_window") == "") | ts.between(bound(0), bound(1))
    return joined.filter(F.coalesce(keep, F.lit(keep_untimed))).drop("time_window")


def apply_exclusions(lines: DataFrame, directive: DataFrame) -> DataFrame:
    """Flag lines that match an 'explicitly irrelevant' phrase.

    A line that also holds an indicator is never excluded: it is marked as a conflict and stays.
    """
    joined = with_directive(lines, directive, "indicators", "explicitly_irrelevant")
    listed = F.exists("explicitly_irrelevant", lambda p: F.contains(F.col("text"), p))
    hit = F.exists("indicators", lambda i: F.contains(F.col("text"), i))
    return (
        joined.withColumn("excluded", listed & ~hit)
        .withColumn("conflict", listed & hit)
        .drop("indicators", "explicitly_irrelevant")
    )


def taskings(slices: DataFrame, directive: DataFrame, iteration: int = 0, *columns: str) -> DataFrame:
    """One task per slice of every case that has a directive; `columns` of the directive go with each task."""
    joined = join_small(slices, directive.select("case_id", "alert_restatement", *columns), ["case_id"], spread=["file", "window_index"])
    return joined.select(
        F.concat_ws("/", "case_id", F.lit("sweep"), "slice_id").alias("task_id"),
        "case_id",
        F.lit(iteration).cast("bigint").alias("iteration"),
        "slice_id", "file", "window_index", "start_line", "end_line",
        F.lit("Sweep this slice: read every line and report those that bear on the alert.").alias("instruction"),
        F.col("alert_restatement").alias("commander_intent"),
        *columns,
    )


def reports(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """A report per task from the literal matches, and `seen`: the indicators that it speaks of.

    An indicator is in one of three states for a slice: found; in its lines, but only outside the time window, which is a check
    that says so and no negative; or not in its lines. The last follows from the directive and is not written out, so that a report
    grows with what was seen (see `outcomes.negatives_by_difference` and `with_absent`).
    """
    fields = F.struct("description", "match_count", "representative_refs", "first_ref", "last_ref", "confidence")
    one = F.struct("indicator", fields.alias("finding"), "outside")
    per_slice = found.groupBy(*KEYS, "slice_id").agg(F.array_sort(F.collect_list(one)).alias("_found"))
    joined = tasks.join(per_slice, [*KEYS, "slice_id"], "left")
    listed = F.coalesce("_found", F.array().cast(per_slice.schema["_found"].dataType))
    inside = F.filter(listed, lambda f: f["finding"]["match_count"] > 0)
    beyond = F.filter(listed, lambda f: f["finding"]["match_count"] == 0)
    result = lambda f: F.concat(F.lit(OUTSIDE), f["outside"].cast("string"), F.lit(" line(s)"))
    check = lambda f: F.struct(f["indicator"].alias("checked_for"), F.lit(False).alias("found"), result(f).alias("result"))
    lines_examined = (F.col("end_line") - F.col("start_line") + 1).cast("bigint")
    report = F.struct(
        F.struct("slice_id", "file", lines_examined.alias("lines_examined")).alias("slice_metadata"),
        (F.size(inside) > 0).alias("relevant"),
        F.transform(inside, lambda f: f["finding"]).alias("findings"),
        F.transform(beyond, check).alias("checked_for"),
    )
    return joined.withColumn("report", report).withColumn("seen", F.transform(listed, lambda f: f["indicator"])).drop("_found")


def with_absent(outcomes: DataFrame, directive: DataFrame) -> DataFrame:
    """Swept outcomes whose reports also list each indicator that is not in their slice, a row of text for each slice and indicator.

    For reading single reports; counts over slices come without it (`outcomes.negatives_by_difference`).
    """
    joined = join_small(outcomes, directive.select("case_id", "indicators"), ["case_id"], spread=["slice_id"])
    absent = F.array_except(F.filter("indicators", lambda i: i != ""), "seen")
    check = lambda i: F.struct(i.alias("checked_for"), F.lit(False).alias("found"), F.lit("not seen in this slice").alias("result"))
    listed = F.concat("report.checked_for", F.transform(absent, check))
    return joined.withColumn("report", F.col("report").withField("checked_for", listed)).drop("indicators")
