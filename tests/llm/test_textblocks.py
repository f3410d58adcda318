"""Words, segments and remembered runs against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from sweeplog.llm import textblocks as tb

TEXTS = ["The cat  sat.\nOn the mat", None, "", "  ", "é café, naïve x  y", "a" * 5000, "don't stop!!\n\n\nNow.\r\nx", "one", "\nA\n b", "one one one"]


def test_words_are_runs_between_white_space():
    data, offsets = tb.text_bytes(pa.array(TEXTS))
    words = tb.words(data, offsets)
    names = words.vocabulary.to_pylist()
    for i, text in enumerate(TEXTS):
        got = [names[c].decode() for c in words.codes[words.offsets[i] : words.offsets[i + 1]]]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("cut", [tb.segments])
def test_segments_make_up_the_texts(cut):
    data, offsets = tb.text_bytes(pa.array(TEXTS))
    parts = cut(data, offsets)
    names = parts.vocabulary.to_pylist()
    for i, text in enumerate(TEXTS):
        assert b"".join(names[c] for c in parts.codes[parts.offsets[i] : parts.offsets[i + 1]]).decode() == (text or "")


def test_blocks_keep_all_rows_and_bound_their_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) for i in range(50)])], ["n", "text"])
    got = list(tb.blocks(iter([batch, batch.slice(3, 20)]), "text", limit=60))
    assert [x for b in got for x in b.column("n").to_pylist()] == [*range(50), *range(3, 23)]
    assert all(b.num_rows == 1 or sum(len(t) for t in b.column("text").to_pylist()) <= 60 for b in got)


def test_repeated_windows():
    text = "a b c d e a b c d x"
    words = tb.words(*tb.text_bytes(pa.array([text, "a b c d", None])))
    assert tb.repeated(words, 4).tolist() == [True] * 4 + [False] + [True] * 4 + [False] + [False] * 4


def test_remembered_runs_equal_made_ones_under_forgetting():
    made = []

    def make(values):
        made.extend(values.to_pylist())
        lists = [[len(v), *v] for v in values.to_pylist()]
        return np.array([x for one in lists for x in one], dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    kept = tb.Remembered(limit=20)
    rng = np.random.default_rng(1)
    for _ in range(30):
        values = sorted({bytes([int(x)]) * int(x % 5) for x in rng.integers(0, 60, 15)})
        flat, at = kept.runs(pa.array(values, pa.large_binary()), make)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[len(v), *v] for v in values]
        assert len(kept.high) <= 20
    assert len(made) < 30 * 15


def test_what_is_remembered_is_bounded_in_numbers_too():
    make = lambda values: (np.arange(1000 * len(values), dtype=np.int64), np.arange(len(values) + 1) * 1000)
    kept = tb.Remembered(numbers=50_000)
    for k in range(40):
        values = pa.array([b"%d-%d" % (k, i) * 300 for i in range(20)], pa.large_binary())
        flat, at = kept.runs(values, make)
        assert len(flat) == 20_000 and kept.runs(values, make)[0].tolist() == flat.tolist()
        assert len(kept.flat) <= 50_000 + 20_000 and kept.flat.nbytes < 300_000


def test_sums_of_empty_texts_are_zero():
    assert tb.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
    assert tb.sums(np.zeros(0), np.array([0, 0])).tolist() == [0]
