"""Phrase collocations against counting every phrase in plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from sweeplog.llm import collocations as op


def plain(rows, least, longest=4, top=2000):
    """lang, rank, phrase, a, l, r, n, score by counting all phrases of all texts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    covered = {
        (lang, p[i : i + k]) for (lang, p), a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
        if 100 * a >= 80 * f[lang, p[i : i + k]]
    }
    out = []
    for lang in {lang for lang, _ in frequent}:
        rows = []
        for (of, p), a in frequent.items():
            if of == lang and (lang, p) not in covered:
                score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(spark, rows, schema="lang string, text string", **sizes):
    found = op.collocations(spark.createDataFrame(rows, schema), **sizes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


TEXTS = [
    ("en", "A cold wind blew. A cold wind blew, a cold day; a\tcold  night"), ("en", "a cold wind blew over cold wind\na cold wind blew"),
    (None, "der kalte Wind der kalte Wind: der kalte wind"), ("und", "der kalte wind"), ("fr", "la la la la la la la"), ("fr", "la la! la la"),
    ("en", None), ("en", ""), (None, ""), ("xx", "one"), ("de", "Ärger ärger Ärger ärger, Ärger ärger"), ("en", " \t .. ,"), ("", "x y x y"),
]


@pytest.mark.parametrize("least", [2, 3])
def test_equal_to_counting_every_phrase(spark, least):
    assert mined(spark, TEXTS * 2, least=least) == plain(TEXTS * 2, least)


def test_many_chunks_and_buckets(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.randrange(120)))) for _ in range(300)]
    rows += [("en", "the very same long passage stands here " * 3)] * 60  # a third of all words
    monkeypatch.setattr(op, "BUCKET_WORDS", 1000)
    assert mined(spark, rows, least=5) == plain(rows, 5)


def test_top_ties_and_other_columns(spark):
    rows = [(1, "en", "b c. a b. c d", 5, "x"), (1, "en", "b c. a b. c d", 6, "y"), (None, "en", "b c. a b. c d", 7, "z")]
    schema = "doc_id long, lang string, text string, place int, code string"
    got = mined(spark, rows, schema, least=3, top=2)
    assert got == plain([(r[1], r[2]) for r in rows], 3, top=2)


def test_empty_and_wordless_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None), (None, " . ")], least=1) == []


def test_a_very_long_text_and_exact_scores(spark):
    rows = [("en", "alpha beta " * 200_000)]
    assert mined(spark, rows) == plain(rows, 30)
    levels = [None, spark.sql("SELECT 1L id, 'en' lang, 'a b' phrase, 5000000000000L a, array(5000000000001L) left, array(5000000000000L) right, 0L first, 0L last")]
    assert op.candidates(levels).first().score == 2_000_000 * 5_000_000_000_000 // 10_000_000_000_001
