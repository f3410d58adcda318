"""The source over growing log files."""

from __future__ import annotations

import io

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweeplog.sources import tail as T
from sweeplog.streaming import live


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=20), st.lists(st.integers(0, 260), max_size=6), st.integers(1, 20))
def test_ranges_give_every_whole_line_once(parts, cuts, size):
    data = b"\n".join(p.replace(b"\n", b"") for p in parts)
    edges = sorted({0, len(data), *[min(c, len(data)) for c in cuts]})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "CHUNK_BYTES", size)
        got = []
        for a, b in zip(edges, edges[1:]):
            with pa.PythonFile(io.BytesIO(data), mode="r") as file:
                got += [x for _, lines in T.chunks(file, a, b) for x in lines]
    whole = data.split(b"\n")[:-1]
    assert got == [x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole]


def test_parts_are_the_places_of_their_first_lines():
    data = b"aa\nbbb\nc\ndd"
    with pa.PythonFile(io.BytesIO(data), mode="r") as file, pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "CHUNK_BYTES", 4)
        found = list(T.chunks(file, 0, len(data)))
    assert [x for _, lines in found for x in lines] == ["aa", "bbb", "c"]
    assert all(data[p:].startswith(lines[0].encode()) for p, lines in found)


def test_patterns_and_offsets(tmp_path):
    for name in ("c1/logs/a.log", "c1/logs/b.log", "c1/other/a.log", "c2/logs/_a.log", "c2/logs/deep/a.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    found = T.sizes(f"{tmp_path}/*/logs/*")
    assert sorted(f.removeprefix(f"{tmp_path}/") for f in found) == ["c1/logs/a.log", "c1/logs/b.log", "c2/logs/_a.log"]
    assert set(found.values()) == {2} and T.sizes(f"{tmp_path}/none/*") == {}
    assert T.sizes(f"file://{tmp_path}/c1/logs/a.log") == {f"{tmp_path}/c1/logs/a.log": 2}
    assert [(r.path, r.start, r.end) for r in T.ranges({"a": 5, "b": 9, "gone": 3}, {"a": 8, "b": 4, "new": 2})] == [("a", 5, 8), ("b", 0, 4), ("new", 0, 2)]
    big = T.ranges({}, {"a": 2 * T.RANGE_BYTES + 1})
    assert [(r.start, r.end) for r in big] == [(0, T.RANGE_BYTES), (T.RANGE_BYTES, 2 * T.RANGE_BYTES), (2 * T.RANGE_BYTES, 2 * T.RANGE_BYTES + 1)]


def test_a_file_that_grows_between_batches_equals_its_batch_reading(spark, tmp_path):
    log = tmp_path / "run.jsonl"
    table = live.LiveTable(spark, "tail")
    seen = []
    for more in (b"one\ntw", b"o\n", b"", "thrée\nfour".encode(), b"\nfive\n"):
        with log.open("ab") as file:
            file.write(more)
        rows = table.run(T.tail(spark, f"{tmp_path}/*.jsonl").select("path", F.explode("lines").alias("value")))
        seen.append(sorted(r.value for r in rows.collect()))
    assert seen == [["one"], ["one", "two"], ["one", "two"], ["one", "thrée", "two"], ["five", "four", "one", "thrée", "two"]]
    whole = T.written(spark, str(log)).select(F.explode("lines").alias("value"))
    assert sorted(r.value for r in whole.collect()) == seen[-1] == sorted(r.value for r in spark.read.text(str(log)).collect())
