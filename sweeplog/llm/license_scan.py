"""License scan: exact phrases, and a fuzzy search for short notices.

A text becomes its words in lower case (runs of ASCII letters and digits and of non-ASCII characters) joined by single spaces. Each
notice may differ by up to k edits (`allowed_errors`). It is cut into k + 1 parts, of which one must stand unchanged in any such
copy; one Aho-Corasick pass over a block finds all parts, and only around those places the regex library's matching with bounded errors
looks for the notice, between word limits. Overlapping finds of different notices are settled by fewest errors, then by length.

Defined results: a null or empty text has no words, no labels and score 0; rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import id_and_text

# The phrases that are found word by word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices that are found with errors, as words in lower case.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("public-domain", "free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)


def allowed_errors(notice: str) -> int:
    """One edit for every ten characters, at most five."""
    return min(5, len(notice) // 10)


@dataclass
class Found:
    text: int
    label: str
    notice: str
    first_word: int
    last_word: int
    errors: int


class NoticeSearch:
    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES):
        self.notices = list(notices)
        self._ready = None

    def __getstate__(self):
        return {"notices": self.notices, "_ready": None}

    def _prepared(self):
        if self._ready is None:
            seeds: dict[str, list[tuple[int, int]]] = {}
            patterns = []
            for number, (_, notice) in enumerate(self.notices):
                k = allowed_errors(notice)
                cuts = np.linspace(0, len(notice), k + 2).astype(int).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    seeds.setdefault(notice[a:b], []).append((number, b))
                patterns.append((regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])"), k))
            finder = ahocorasick.Automaton()
            for seed, places in seeds.items():
                finder.add_word(seed, places)
            finder.make_automaton()
            self._ready = finder, patterns
        return self._ready

    def find(self, joined: np.ndarray, at: np.ndarray) -> list[Found]:
        """joined: words with a space before each; at: where each text's bytes begin (n + 1 values)."""
        finder, patterns = self._prepared()
        windows: dict[tuple[int, int], list[list[int]]] = {}
        ends = at[1:]
        # one character a byte: the parts are ASCII
        for place, hits in finder.iter(joined.tobytes().decode("latin-1")):
            text = int(np.searchsorted(ends, place, side="right"))
            for number, part_end in hits:
                k = patterns[number][1]
                size = len(self.notices[number][1])
                begin, end = place + 1 - part_end - 2 * k, place + 1 - part_end + size + 2 * k + 1
                begin, end = max(begin, int(at[text])), min(end, int(at[text + 1]))
                held = windows.setdefault((text, number), [])
                if held and begin <= held[-1][1]:
                    held[-1][1] = max(end, held[-1][1])
                else:
                    held.append([begin, end])
        found = [f for (text, number), spans in windows.items() for a, b in spans for f in self._verified(joined, int(at[text]), text, number, a, b)]
        return _settled(found)

    def _verified(self, joined: np.ndarray, start: int, text: int, number: int, a: int, b: int) -> Iterator[Found]:
        label, notice = self.notices[number]
        pattern, _ = self._prepared()[1][number]
        # whole words: from the space before the window's first word to the space after its last
        while a > start and joined[a] != 0x20:
            a -= 1
        before = int((joined[start:a] == 0x20).sum())
        window = joined[a:b].tobytes().decode("utf-8", "ignore")
        for match in pattern.finditer(window):
            begin, end = match.span()
            words = window[:begin].count(" ")
            yield Found(text, label, notice, before + words - 1, before + window[:end].count(" ") - 1, sum(match.fuzzy_counts))


def _settled(found: list[Found]) -> list[Found]:
    """Of finds that overlap in a text, the one with the fewest errors, then the longest."""
    out: list[Found] = []
    taken: dict[int, list[Found]] = {}
    for f in sorted(found, key=lambda f: (f.text, f.errors, -len(f.notice), f.first_word, f.notice)):
        if all(f.first_word > g.last_word or f.last_word < g.first_word for g in taken.get(f.text, ())):
            taken.setdefault(f.text, []).append(f)
            out.append(f)
    return sorted(out, key=lambda f: (f.text, f.first_word, f.last_word))


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Words, and the texts as words with a space before each, with the byte place where each text begins."""
    data = tb.lowered(data)
    words = tb.words(data, offsets, tb.ALNUM)
    mask = tb.ALNUM[data]
    starts, ends = tb.spans(mask, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    joined = np.insert(data[mask], at[:-1], np.uint8(0x20))
    return words, joined, (at + np.arange(len(at)))[words.offsets]


def phrase_places(words: tb.Words, phrase: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place where the phrase's words stand one after the other: its text and its first word there."""
    codes = [pc.index(words.vocabulary, pa.scalar(w.encode(), words.vocabulary.type)).as_py() for w in phrase.split()]
    n, size = len(words.codes), len(codes)
    if min(codes) < 0 or n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(words.codes[: n - size + 1] == codes[0])
    for k in range(1, size):
        hit = hit[words.codes[hit + k] == codes[k]]
    text = np.searchsorted(words.offsets, hit, side="right") - 1
    whole = hit + size <= words.offsets[text + 1]
    return text[whole], hit[whole] - words.offsets[text[whole]]


def notices(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", search: NoticeSearch | None = None) -> DataFrame:
    """doc_id, label, notice, first_word, last_word, errors: a row for each notice found."""
    rows = id_and_text(docs, id_col, text_col)
    search = search or NoticeSearch()

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            _, joined, at = _joined(*tb.text_bytes(block.column("text")))
            got = search.find(joined, at)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array([f.text for f in got], pa.int64())), pa.array([f.label for f in got], pa.string()),
                    pa.array([f.notice for f in got], pa.string()), pa.array([f.first_word for f in got], pa.int64()),
                    pa.array([f.last_word for f in got], pa.int64()), pa.array([f.errors for f in got], pa.int32()),
                ],
                ["doc_id", "label", "notice", "first_word", "last_word", "errors"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, label string, notice string, first_word long, last_word long, errors int")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", search: NoticeSearch | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score: 1 with an exact phrase, else the best notice's share of characters without an error, else 0.
    """
    rows = id_and_text(docs, id_col, text_col)
    search = search or NoticeSearch()

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            words, joined, at = _joined(*tb.text_bytes(block.column("text")))
            n = block.num_rows
            count, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
            base: dict[int, set[str]] = {}
            for phrase, label in PHRASES:
                text, place = phrase_places(words, phrase)
                count += np.bincount(text, minlength=n)
                np.minimum.at(first, text, place)
                np.maximum.at(last, text, place)
                for t in np.unique(text).tolist():
                    base.setdefault(t, set()).add(label)
            score = (count > 0).astype(float)
            labels = {t: set(x) for t, x in base.items()}
            for f in search.find(joined, at):
                labels.setdefault(f.text, set()).add(f.label)
                score[f.text] = max(score[f.text], 1 - f.errors / len(f.notice))
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(base.get(i, ()))) for i in range(n)], pa.string()),
                    pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)], pa.string()), pa.array(score),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scanned, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
