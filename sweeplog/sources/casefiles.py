"""Case folders: `<case>/alert.json` and `<case>/logs/*`, many cases in one job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweeplog import schemas
from sweeplog.functions import lines as L
from sweeplog.functions import replies as R
from sweeplog.session import join_small, materialize

ALERT_FILE, LOGS_DIR = "alert.json", "logs"
PIECE_BYTES = 128 * 1024 * 1024
# Bytes that a task holds of a range at a time, or one line where that is longer.
READ_BYTES = 4 * 1024 * 1024
LISTING = "case_id string, kind string, path string, file string, size bigint"
_RANGE = "case_id string, path string, file string, size bigint, block bigint"


def _open_folder(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def list_cases(cases: DataFrame) -> DataFrame:
    """What each case folder (case_id, root) holds, listed by the tasks.

    kind is `log` or `alert` with path, file and size, or names what is missing: no_folder, no_alert, no_logs_dir, no_logs.
    Hidden files are skipped, sub-folders are not entered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def listed(system, folder):
            return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda info: info.base_name)

        for batch in batches:
            rows = []
            for case_id, root in zip(batch["case_id"], batch["root"]):
                system, folder = _open_folder(root)
                if system.get_file_info(folder).type != fs.FileType.Directory:
                    rows.append((case_id, "no_folder", root, None, None))
                    continue
                entries = {info.base_name: info for info in listed(system, folder)}
                alert = entries.get(ALERT_FILE)
                if alert is not None and alert.is_file:
                    rows.append((case_id, "alert", alert.path, ALERT_FILE, alert.size))
                else:
                    rows.append((case_id, "no_alert", root, None, None))
                logs = entries.get(LOGS_DIR)
                if logs is None or logs.is_file:
                    rows.append((case_id, "no_logs_dir", root, None, None))
                    continue
                found = [i for i in listed(system, logs.path) if i.is_file and not i.base_name.startswith(".")]
                rows.extend((case_id, "log", i.path, i.base_name, i.size) for i in found)
                if not found:
                    rows.append((case_id, "no_logs", root, None, None))
            yield pd.DataFrame(rows, columns=["case_id", "kind", "path", "file", "size"]).astype({"size": "Int64"})

    return cases.select("case_id", "root").mapInPandas(run, LISTING)


def case_folders(spark: SparkSession, parent: str) -> DataFrame:
    """(case_id, root) of every folder in `parent`; names only, listed on the driver."""
    from pyarrow import fs

    system, folder = _open_folder(parent.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(folder))
    rows = [(i.base_name, f"{parent.rstrip('/')}/{i.base_name}") for i in found if not i.is_file and not i.base_name.startswith((".", "_"))]
    return spark.createDataFrame(sorted(rows), "case_id string, root string")


def directly_in_logs(path: Column, parent: str) -> Column:
    """Whether a file lies in `<parent>/<case>/logs` itself; the text reader also enters folders that its pattern names."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    depth = len([p for p in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", parent).split("/") if p]) + 3
    return (F.size(F.filter(F.split(bare, "/"), lambda p: p != "")) == depth) & path.rlike(rf"/{LOGS_DIR}/[^/]+$")


def _path_part(path: Column, pattern: str) -> Column:
    """Decoded piece of a file path. `+` is a plain character in file names."""
    return F.url_decode(F.replace(F.regexp_extract(path, pattern, 1), F.lit("+"), F.lit("%2B")))


def file_ranges(listing: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each `piece_bytes` of each log file that has bytes: case_id, path, file, size, block (where the range starts)."""
    last = F.col("size") - 1
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(piece_bytes).cast("bigint"))).alias("block")
    return listing.filter((F.col("kind") == "log") & (F.col("size") > 0)).select("case_id", "path", "file", "size", blocks)


def _texts(path: str, start: int, size: int, piece_bytes: int) -> Iterator[str]:
    """The lines that begin in [start, start + piece_bytes), as texts of some whole lines each."""
    end = min(size, start + piece_bytes)
    system, name = _open_folder(path)
    with system.open_input_file(name) as handle:
        if start:  # the line that is open here belongs to the range before
            start -= 1
            handle.seek(start)
            while (step := handle.read(1 << 16)) and b"\n" not in step:
                start += len(step)
            start = start + step.find(b"\n") + 1 if step else size
            handle.seek(start)
        held: list[bytes] = []
        while start < end:
            step = handle.read(min(READ_BYTES, end - start))
            if not step:
                break
            start += len(step)
            cut = step.rfind(b"\n") + 1
            held.append(step[:cut] if cut else step)
            if cut:
                yield b"".join(held).decode("utf-8", errors="replace")
                held = [step[cut:]]
        while any(held) and (step := handle.read(1 << 16)):  # to the end of the last line
            cut = step.find(b"\n") + 1
            held.append(step[:cut] if cut else step)
            if cut:
                break
        if any(held):
            yield b"".join(held).decode("utf-8", errors="replace")


def _split(text: str, python_splitlines: bool) -> list[str]:
    if python_splitlines:
        return text.splitlines()
    found = re.split("\r\n|\r|\n", text)
    return found[:-1] if found[-1] == "" else found


def _dealt(ranges: DataFrame, piece_bytes: int, task_bytes: int = 64 * 1024 * 1024, task_ranges: int = 2_000, most: int = 50_000) -> DataFrame:
    """Ranges in tasks of about `task_bytes` of their files or `task_ranges` ranges, as small files cost their opening; without a number
    few bytes of names would be put into one task."""
    held = F.least(F.lit(piece_bytes).cast("bigint"), F.col("size") - F.col("block"))
    count, size = ranges.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    tasks = max(2 * ranges.sparkSession.sparkContext.defaultParallelism, size // task_bytes, count // task_ranges)
    return ranges.repartition(max(1, min(tasks, count, most)), "path", "block")


def line_counts(ranges: DataFrame, piece_bytes: int = PIECE_BYTES, *, python_splitlines: bool = True) -> DataFrame:
    """The ranges with the number of their lines (`lines`)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            n = [sum(len(_split(t, python_splitlines)) for t in _texts(r["path"], r["block"], r["size"], piece_bytes)) for r in rows]
            yield batch.append_column("lines", pa.array(n, pa.int64()))

    return _dealt(ranges, piece_bytes).mapInArrow(counted, f"{_RANGE}, lines bigint")


def lines_of_ranges(counts: DataFrame, piece_bytes: int = PIECE_BYTES, *, python_splitlines: bool = True) -> DataFrame:
    """Numbered lines: (case_id, file, line_no, text). `counts` is a stored table of `line_counts`, read with the same arguments."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    placed = counts.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).filter("lines > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row["before"]
                for text in _texts(row["path"], row["block"], row["size"], piece_bytes):
                    found = _split(text, python_splitlines)
                    n = len(found)
                    numbers = pa.array(range(number + 1, number + n + 1), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["case_id"]] * n), pa.array([row["file"]] * n), numbers, pa.array(found, pa.string())], ["case_id", "file", "line_no", "text"]
                    )
                    number += n

    return _dealt(placed.drop("lines"), piece_bytes).mapInArrow(read, "case_id string, file string, line_no bigint, text string")


def number_lines(pieces: DataFrame) -> DataFrame:
    """Line numbers from per-piece counts: no global sort, and lines do not move.

    `pieces` must be a written table, so that both passes see the same pieces. The offset table has one row per piece
    and a 64-bit key; it is broadcast only if its size allows.
    """
    keyed = pieces.withColumn("_piece", F.xxhash64("path", "block"))
    counts = keyed.groupBy("_piece", "path", "block").agg(F.count("*").alias("_n"), F.min("row").alias("_base"))
    if counts.count() != counts.select("_piece").distinct().count():
        raise ValueError("two file pieces share a key; number them by path and block instead")
    by_file = Window.partitionBy("path")
    earlier = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_piece", "_base",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_file).alias("_total"),
    )
    numbered = join_small(keyed, offsets, ["_piece"], spread=["row"]).withColumn(
        "line_no", (F.col("row") - F.col("_base") + F.col("_before") + 1).cast("bigint")
    )
    # The part after a separator that ends the file is not a line.
    return numbered.filter(~(F.col("tail") & (F.col("line_no") == F.col("_total")))).select(
        "case_id", "file", "line_no", "text"
    )


def read_lines(spark: SparkSession, parent: str, listing: DataFrame | None = None, *, python_splitlines: bool = True,
               piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Numbered lines of every `<parent>/<case>/logs/*`: (case_id, file, line_no, text).

    Files come from the listing, which is made here unless it is given; folders in `logs` are not entered. A first reading counts the
    lines of each range of a file, a second one numbers them: the counts are stored, the text is neither written nor moved.
    Undecodable bytes become the replacement character. Lines are those of `str.splitlines`, or end only with line feeds and
    carriage returns. Each use of the result reads the files again.
    """
    if listing is None:
        listing = list_cases(case_folders(spark, parent.rstrip("/")))
    ranges = materialize(file_ranges(listing, piece_bytes), "file-ranges")
    counts = materialize(line_counts(ranges, piece_bytes, python_splitlines=python_splitlines), "line-counts")
    return lines_of_ranges(counts, piece_bytes, python_splitlines=python_splitlines)


# Required text fields of an alert, and its closed nested records.
_ALERT_FIELDS = {name: R.TEXT for name in schemas.ALERT_REQUIRED} | {"entities": R.LIST, "raw_detector_fields": R.OBJECT}
_ENTITY = {"kind": R.TEXT, "value": R.TEXT, "note": R.TEXT}


def alert_problems(text: Column) -> Column:
    """Missing, mistyped and unknown fields of an alert document."""
    none = F.create_map().cast("map<string,variant>")

    def nested(value: Column) -> Column:
        fields = F.coalesce(F.try_variant_get(value, "$.raw_detector_fields", "map<string,variant>"), none)
        mistyped = F.transform(
            F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: ~F.startswith(F.schema_of_variant(v), F.lit(R.TEXT))))),
            lambda k: F.concat(F.lit("field raw_detector_fields."), k, F.lit(": expected STRING")),
        )
        return F.concat(R._elements(value, "entities", _ENTITY, ("note",)), mistyped)

    return R.parse_problems(text, _ALERT_FIELDS, ("entities", "raw_detector_fields"), nested)


def read_alerts(spark: SparkSession, parent: str) -> DataFrame:
    """One row per `<parent>/<case>/alert.json`: case_id, the alert's fields, and `problems` (empty when valid)."""
    documents = spark.read.text(f"{parent.rstrip('/')}/*/{ALERT_FILE}", wholetext=True).select(
        _path_part(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(ALERT_FILE)}$").alias("case_id"), "value"
    )
    return parse_alerts(documents)


def parse_alerts(documents: DataFrame) -> DataFrame:
    """Alerts from (case_id, value) JSON texts; fields are null where there are problems."""
    checked = documents.withColumn("problems", alert_problems(F.col("value")))
    alert = F.when(F.size("problems") == 0, F.from_json("value", schemas.ALERT))
    parsed = checked.withColumn("_a", alert)
    return parsed.select(
        "case_id",
        *[F.col(f"_a.{f.name}").alias(f.name) for f in schemas.ALERT.fields if f.name not in ("entities", "raw_detector_fields")],
        F.coalesce("_a.entities", F.array().cast(schemas.ALERT["entities"].dataType)).alias("entities"),
        F.coalesce("_a.raw_detector_fields", F.create_map().cast("map<string,string>")).alias("raw_detector_fields"),
        "problems",
    )


# What a missing part of a case is called.
MISSING = {
    "no_folder": "is not a directory",
    "no_alert": f"has no {ALERT_FILE}",
    "no_logs_dir": f"has no {LOGS_DIR}/ directory",
    "no_logs": f"{LOGS_DIR} contains no log files",
}


def case_audit(listing: DataFrame, alerts: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Problems per case as rows (case_id, subject, problem): missing parts, bad alerts, names that cannot be cited,
    and non-empty files that were listed but gave no line."""
    names = F.create_map(*[F.lit(x) for pair in MISSING.items() for x in pair])
    missing = listing.filter(F.col("kind").isin(*MISSING)).select(
        "case_id", F.col("path").alias("subject"), F.element_at(names, F.col("kind")).alias("problem")
    )
    invalid = alerts.select("case_id", F.lit(ALERT_FILE).alias("subject"), F.explode("problems").alias("problem"))
    logs = listing.filter("kind = 'log'")
    uncitable = logs.filter(~L.is_well_formed_ref(L.line_ref(F.col("file"), F.lit(1)))).select(
        "case_id", F.col("file").alias("subject"), F.lit("lines of this file cannot be cited: name outside the ref grammar").alias("problem")
    )
    out = missing.unionByName(invalid).unionByName(uncitable)
    if lines is None:
        return out
    read = lines.filter("line_no = 1").select("case_id", "file")
    unread = logs.filter("size > 0").join(read, ["case_id", "file"], "left_anti").select(
        "case_id", F.col("file").alias("subject"), F.lit("listed but not read").alias("problem")
    )
    return out.unionByName(unread)
