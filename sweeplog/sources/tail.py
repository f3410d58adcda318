"""A streaming source over log files that grow: what was appended since the last batch, in whole lines.

The offset of a stream is the size of each file. A line belongs to the range of bytes in which its line break lies, so a line
that is only partly written stays out until its end arrives, wherever a batch or a task begins; a task looks back from its range's start
for the beginning of the line that is open there. Executors read the ranges; the driver only lists sizes.

Rows are chunks of lines: path, part (where the chunk's first line starts, in bytes) and lines, about `CHUNK_BYTES` together. Ranges of more
than `RANGE_BYTES` are read by several tasks.

A file that became shorter was replaced and is read from its start. A file that is gone is forgotten. Lines end with a line
feed, and a carriage return before it is dropped; bytes that are no UTF-8 become replacement characters. The offsets hold an entry for each
file, so a folder should be emptied of old logs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 64 << 20
_SCHEMA = "path string, part bigint, lines array<string>"
_ARROW = pa.schema([("path", pa.string()), ("part", pa.int64()), ("lines", pa.list_(pa.string()))])


def opened(pattern: str) -> tuple[fs.FileSystem, list[str], list[str]]:
    """The file system of a path or URI, the names of its plain folder there, and the names or patterns below."""
    names = pattern.split("/")
    plain = next((i for i, n in enumerate(names) if any(c in n for c in "*?[")), len(names) - 1)
    folder = "/".join(names[:plain]) or "/"
    if ":" in names[0]:
        system, folder = fs.FileSystem.from_uri(folder)
    else:
        system = fs.LocalFileSystem()
    return system, folder.rstrip("/").split("/"), names[plain:]


def sizes(pattern: str) -> dict[str, int]:
    """Size of each file that the pattern names, by path. `*`, `?` and `[` stand for names or parts of names."""
    system, folder, below = opened(pattern)
    found = system.get_file_info(fs.FileSelector("/".join(folder) or "/", allow_not_found=True, recursive=len(below) > 1))
    wanted = [*folder, *below]
    fits = lambda names: len(names) == len(wanted) and all(map(fnmatchcase, names, wanted))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and fits(f.path.split("/"))}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def ranges(start: dict, end: dict) -> list[Range]:
    """The bytes that came between two offsets, cut to `RANGE_BYTES`."""
    out = []
    for path, size in sorted(end.items()):
        begin = start.get(path, 0)
        begin = begin if begin <= size else 0
        out += [Range(path, at, min(at + RANGE_BYTES, size)) for at in range(begin, size, RANGE_BYTES)]
    return out


def line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line begins that is open at a place."""
    while at > 0:
        step = min(at, CHUNK_BYTES)
        file.seek(at - step)
        found = file.read(step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


def chunks(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """Lines whose line break lies between two places, in chunks with the place of their first line."""
    part = at = line_start(file, start)
    file.seek(at)
    held: list[bytes] = []
    while at < end:
        block = file.read(min(CHUNK_BYTES, end - at))
        if not block:
            return  # the file became shorter since it was listed
        at += len(block)
        cut = block.rfind(b"\n") + 1
        held.append(block[:cut] if cut else block)
        if cut:
            whole = b"".join(held)
            yield part, [line.removesuffix(b"\r").decode("utf-8", "replace") for line in whole[:-1].split(b"\n")]
            part += len(whole)
            held = [block[cut:]]


def _read(system: fs.FileSystem, piece: Range) -> Iterator[pa.RecordBatch]:
    with system.open_input_file(piece.path) as file:
        for part, lines in chunks(file, piece.start, piece.end):
            yield pa.RecordBatch.from_pylist([{"path": piece.path, "part": part, "lines": lines}], _ARROW)


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.pattern)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(opened(self.pattern)[0], partition)


class WholeReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[Range]:
        return ranges({}, sizes(self.pattern))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(opened(self.pattern)[0], partition)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WholeReader:
        return WholeReader(self.options["path"])

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail(spark: SparkSession, pattern: str) -> DataFrame:
    """Stream of path, part, lines over the files that the pattern names."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").load(pattern)


def written(spark: SparkSession, pattern: str) -> DataFrame:
    """The same rows for what is written now."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").load(pattern)
