"""What is written and read back: numbered pieces, alerts, the event sink, stored statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sweeplog.binding import sql as S
from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.binding.running import PHASES
from sweeplog.operators import runstats as R
from sweeplog.operators import slices as SL
from sweeplog.session import materialize, staging_path
from sweeplog.sources import casefiles, runlog

PIECE_LINES = 7


@register("numbered_pieces", f"WITH {S.DOC_LINES} SELECT case_id, file, line_no, text FROM doc_lines")
def numbered_pieces(spark, sf_dir):
    lines = V.doc_lines(spark, sf_dir)
    at = F.col("line_no") - 1
    pieces = lines.select(
        "case_id", F.concat("case_id", F.lit("/"), "file").alias("path"), "file", F.floor(at / PIECE_LINES).cast("bigint").alias("block"),
        (at % PIECE_LINES + 100).cast("bigint").alias("row"), "text", F.lit(False).alias("tail"),
    )
    return casefiles.number_lines(materialize(pieces, "pieces"))


def case_folder(spark, sf_dir) -> str:
    """The documents as case folders: a file for each document, an alert for most cases. Some names cannot be cited.

    A file is written under a name of its task's own and then renamed, so that a task that runs twice does no harm.
    """
    root = staging_path(spark, "cases")

    def written(batches):
        system, folder = casefiles._open_folder(root)  # the root alone may be a URI; names below it are not encoded
        made = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                place = f"{folder}/{path}"
                if (parent := place.rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                draft = f"{place.rsplit('/', 2)[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(text.encode())
                system.move(draft, place)
            yield batch.select(["path"])

    documents = V.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("doc ")).otherwise(F.lit("doc-"))
    files = documents.select(F.concat_ws("/", "source", F.lit("logs"), F.concat(name, "doc_id", F.lit(".txt"))).alias("path"), "text")
    fields = F.struct(
        F.concat(F.lit("A-"), "source").alias("alert_id"), *[F.lit("x").alias(c) for c in ("detector", "rule_name", "status")],
        F.when(~F.endswith("source", F.lit("3")), F.lit("low")).alias("severity"), *[F.lit("2031-01-01").alias(c) for c in ("first_seen", "last_seen", "summary")],
    )
    cases = documents.select("source").distinct().filter(~F.endswith("source", F.lit("7")))
    alerts = cases.select(F.concat("source", F.lit("/"), F.lit(casefiles.ALERT_FILE)).alias("path"), F.to_json(fields).alias("text"))
    files.unionByName(alerts).mapInArrow(written, "path string").agg(F.count("*")).first()
    return root


CASE_FILES = """
files AS (SELECT source AS case_id, CASE WHEN doc_id % 50 = 0 THEN 'doc ' ELSE 'doc-' END || doc_id || '.txt' AS file, text FROM documents WHERE text IS NOT NULL),
file_lines AS (SELECT case_id, file, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM files WHERE text <> '')"""


@register("case_lines", f"""WITH {CASE_FILES}
SELECT case_id, file, CAST(i AS BIGINT) AS line_no, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM file_lines)""")
def case_lines(spark, sf_dir):
    """Numbered lines of log files, in ranges of 10,000 bytes."""
    return casefiles.read_lines(spark, case_folder(spark, sf_dir), python_splitlines=False, piece_bytes=10_000)


@register("case_files", f"""WITH {CASE_FILES}
SELECT f.case_id, f.file, CAST(octet_length(encode(f.text)) AS BIGINT) AS size, coalesce(len(ls), 0) AS lines, coalesce(len(ls), 0) > 0 OR f.text = '' AS accounted
FROM files f LEFT JOIN file_lines USING (case_id, file)""")
def case_files(spark, sf_dir):
    """Every listed file, what was read of it, and whether slices account for all of it."""
    root = case_folder(spark, sf_dir)
    listing = materialize(casefiles.list_cases(casefiles.case_folders(spark, root)), "listing")
    lines = casefiles.read_lines(spark, root, listing, python_splitlines=False)
    audit = SL.coverage_audit(lines, SL.slice_places(lines)).select("case_id", "file", F.col("line_count").alias("lines"), "covered")
    zero, empty = F.lit(0).cast("bigint"), F.col("size") == 0
    joined = listing.filter("kind = 'log'").join(audit, ["case_id", "file"], "left")
    return joined.select("case_id", "file", "size", F.coalesce("lines", zero).alias("lines"), F.coalesce("covered", empty).alias("accounted"))


@register("case_problems", f"""WITH {CASE_FILES},
cases AS (SELECT DISTINCT case_id FROM files)
SELECT case_id, case_id AS subject, 'has no alert.json' AS problem FROM cases WHERE case_id LIKE '%7'
UNION ALL SELECT case_id, 'alert.json', 'field severity: Field required' FROM cases WHERE case_id LIKE '%3'
UNION ALL SELECT case_id, file, 'lines of this file cannot be cited: name outside the ref grammar' FROM files WHERE contains(file, ' ')""")
def case_problems(spark, sf_dir):
    root = case_folder(spark, sf_dir)
    listing = materialize(casefiles.list_cases(casefiles.case_folders(spark, root)), "listing")
    lines = casefiles.read_lines(spark, root, listing, python_splitlines=False)
    found = casefiles.case_audit(listing, casefiles.read_alerts(spark, root), lines)
    return found.withColumn("subject", F.regexp_extract("subject", r"([^/]+)/?$", 1))


@register("alert_records", """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'A-' || doc_id END AS alert_id, CASE WHEN doc_id % 7 <> 0 THEN source END AS detector,
       CASE WHEN doc_id % 7 <> 0 THEN text END AS summary, CASE WHEN doc_id % 7 = 0 THEN 'field severity: Field required' ELSE '' END AS problems
FROM documents""")
def alert_records(spark, sf_dir):
    fields = F.struct(
        F.concat(F.lit("A-"), "doc_id").alias("alert_id"), F.col("source").alias("detector"), F.col("lang").alias("rule_name"), F.lit("open").alias("status"),
        F.when(F.col("doc_id") % 7 != 0, F.lit("low")).alias("severity"), F.lit("2031-01-01T00:00:00Z").alias("first_seen"),
        F.lit("2031-01-02T00:00:00Z").alias("last_seen"), F.col("text").alias("summary"),
    )
    documents = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.to_json(fields).alias("value"))
    alerts = casefiles.parse_alerts(documents)
    return alerts.select(F.col("case_id").cast("bigint").alias("doc_id"), "alert_id", "detector", "summary", F.array_join("problems", "; ").alias("problems"))


@register("event_sink", """
SELECT 'run-' || user_id AS investigation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id, event_type AS kind,
       epoch_us(date_trunc('milliseconds', ts)) // 1000 AS at_ms FROM events""")
def event_sink(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), "user_id").alias("investigation_id"), "ts", F.col("event_id").alias("sequence"), F.col("event_type").alias("kind")
    )
    path = staging_path(spark, "event-sink")
    runlog.append_events(runlog.number_events(events), path)
    return runlog.read_run_log(spark, path).select("investigation_id", "event_id", "kind", F.unix_millis(R.instant()).alias("at_ms"))


@register("stats_history", f"""WITH {PHASES}
SELECT i.investigation_id, CASE WHEN user_id % 2 = 0 THEN 'vllm' ELSE 'stub' END AS backend, c.n AS worker_calls, s.n AS slices, p.seconds AS collecting_s,
       CAST(user_id % 3 * 4 AS DOUBLE) AS concurrency_configured
FROM (SELECT DISTINCT investigation_id, user_id FROM log) i
LEFT JOIN (SELECT investigation_id, count(*) AS n FROM log WHERE kind = 'llm_call' AND role = 'grunt' GROUP BY ALL) c USING (investigation_id)
LEFT JOIN (SELECT investigation_id, count(*) AS n FROM log WHERE kind = 'grunt_validation' GROUP BY ALL) s USING (investigation_id)
LEFT JOIN (SELECT * FROM phases WHERE state = 'COLLECTING') p USING (investigation_id)""")
def stats_history(spark, sf_dir):
    log = materialize(V.run_log(spark, sf_dir), "run-log")
    user = F.regexp_extract("investigation_id", r"(\d+)$", 1).cast("bigint")
    runs = log.select("investigation_id").distinct().select(
        "investigation_id", F.when(user % 2 == 0, F.lit(R.REAL_BACKEND)).otherwise(F.lit("stub")).alias("backend"),
        (user % 3 * 4).cast("double").alias("concurrency_configured"),
    )
    inventory = log.filter("kind = 'grunt_validation'").groupBy("investigation_id").agg(
        F.count("*").alias("slice_count"), F.count("*").alias("line_count")
    )
    path = staging_path(spark, "stats")
    runlog.write_json(R.run_stats(log, inventory=inventory, runs=runs), path)
    return R.history_rows(runlog.read_history(spark, path))
