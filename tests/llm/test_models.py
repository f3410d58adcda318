"""Rules, classifiers, language model and license scan against plain versions and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sweeplog.llm import language_id, license_scan, lm_score, quality_classifier, quality_rules
from sweeplog.llm.frames import fold

SCHEMA = "doc_id long, text string, lang string, score double, kept boolean, n_words int, block long, label string"
ODD = [None, "", "  \n ", "one", "ab\n\nab\nab \n\n x", "# $ a|b <c>\n#", "a b c d e f g h a b c d e f g h", "éé 世\n世\n", "x" * 20_000, "w " * 9000, "same", "same"]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, True, 7, 1, "z") for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return _frame(spark, [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, "no id here", "de")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


SYLLABLES = {"en": "the and ing er tion an re on at en".split(), "de": "der sch ung ein ver ge en ich heit be".split()}


def _prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(6)
    return [(i, _prose(rng, "de" if i % 3 == 0 else "en", rng.randint(25, 120)), "de" if i % 3 == 0 else "en") for i in range(240)]


def _rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(odd, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(odd).collect()}
    rows = [(i, *_rules(t)) for i, t in [*enumerate(ODD), (None, "no id here")]]
    assert got == {(*r, r[1] < 20 or 100 * r[5] > 30 * r[1]) for r in rows}
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).columns == empty.columns


def test_kneser_ney_sums_to_one():
    words = ["the", "then", "there", "a", "an", "Zz9!"] * 5 + ["once"]
    vocabulary = pa.array([w.encode() for w in words], pa.large_binary())
    codes, _ = quality_rules.word_trigrams(vocabulary)
    grams, counts = np.unique(codes, return_counts=True)
    model = quality_rules.smoothed(grams, counts)
    for context in (0, int(grams[3] // 96), 96 * 20 + 8):
        total = (10 ** model.log_probabilities(context * 96 + np.arange(96))).sum()
        assert abs(total - 1) < 1e-9


def _kneser_ney(counts, context, shorter):
    """Plain interpolated modified Kneser-Ney: P(gram) under counts of its last signs and a model of shorter n-grams. context: the part of
    a counted n-gram that the rest follows; shorter(gram) has the whole n-gram, as it may ask for its classes."""
    n = [sum(c == k for c in counts.values()) for k in range(5)]
    cut = [0.0, 0.5, 1.0, 1.5]
    if all(n[1:]):
        y = n[1] / (n[1] + 2 * n[2])
        found = [0.0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        cut = [f if f > 0 else c for f, c in zip(found, cut)]
    total, left = Counter(), Counter()
    for gram, c in counts.items():
        total[gram[:-1]] += c
        left[gram[:-1]] += cut[min(c, 3)]

    def p(gram):
        own = gram[len(gram) - context - 1 :]
        c, of = counts.get(own, 0), total[own[:-1]]
        return (c - cut[min(c, 3)] + left[own[:-1]] * shorter(gram)) / of if of else shorter(gram)

    return p


def _text_model(texts):
    """P(third byte | first two) of a trigram of bytes, by the words of texts."""
    as_class = [int(c) for c in quality_rules._CLASS]
    grams = Counter(g for t in texts for g in _byte_trigrams(t))
    classes = Counter()
    for g, c in grams.items():
        classes[tuple(as_class[b] for b in g)] += c
    pairs = Counter(g[1:] for g in classes)
    single = _kneser_ney(Counter(g[1:] for g in pairs), 0, lambda g: 1 / 96)
    by_class = _kneser_ney(classes, 2, _kneser_ney(pairs, 1, single))
    once = [1 + sum(c for g, c in grams.items() if g[2] == b) for b in range(256)]
    share = [once[b] / sum(once[x] for x in range(256) if as_class[x] == as_class[b]) for b in range(256)]
    pair = _kneser_ney(Counter(g[1:] for g in grams), 1, lambda g: by_class(tuple(as_class[b] for b in g)) * share[g[2]])
    return _kneser_ney(grams, 2, pair)


def _byte_trigrams(text):
    data = b"  " + b" ".join(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")) + b" "
    return list(zip(data, data[1:], data[2:])) if len(data) > 3 else []


def test_perplexity_equals_plain_model_of_whole_texts(spark, prose):
    rng = random.Random(5)
    rows = [(i, t + f" {rng.randint(0, 10**6)} " + "".join(rng.choices("äöß世ñ", k=4)), lang) for i, t, lang in prose[:30]] + [(900, "", "en"), (901, None, "de"), (902, "\n a  b\tc ", "de")]
    docs = _frame(spark, rows).select("doc_id", "text", quality_rules.lang_key("lang").alias("lang_key"))
    models = quality_rules.fit_language_models(docs.where("doc_id % 4 <> 1"))
    got = {r.doc_id: r.log_perplexity for r in quality_rules.score(docs, models).collect()}
    for lang in ("en", "de"):
        plain = _text_model([t for i, t, x in rows if x == lang and i % 4 != 1])
        for i, t, x in rows:
            grams = _byte_trigrams(t) if x == lang else []
            if grams:
                assert got[i] == pytest.approx(-sum(math.log10(plain(g)) for g in grams) / len(grams), abs=1e-9)
    assert got[900] is None and got[901] is None


def test_text_model_sums_to_one(prose):
    grams = Counter((a << 16) + (b << 8) + c for _, t, _ in prose[:20] for a, b, c in _byte_trigrams(t + " 17 über"))
    model = quality_rules.text_model(np.array(sorted(grams)), np.array([grams[g] for g in sorted(grams)]))
    for a, b in ((32, 32), (116, 104), (0xC3, 0xBC), (122, 122), (0, 255)):
        assert abs((10 ** model.log_probabilities((a << 16) + (b << 8) + np.arange(256))).sum() - 1) < 1e-9


def test_bytes_of_a_class_and_neighbours_of_words_tell_texts_apart(spark):
    rng = random.Random(26)
    alike = str.maketrans("абвгдежз01234", "ийклмноп56789")  # letters that differ in one bit of their second byte, and digits

    def prose(letters):  # a word begins with the letter that ends the word before
        out = [letters[0]]
        for _ in range(rng.randint(60, 200)):
            out.append(out[-1][-1] + "".join(rng.choices("01234", k=rng.randint(0, 2))) + "".join(rng.choices(letters, k=rng.randint(1, 5))))
        return " ".join(out)

    clean = [(i, prose("abcdefgh" if i % 2 else "абвгдежз"), "en" if i % 2 else "ru") for i in range(800)]
    other = [(1000 + i, prose("абвгдежз").translate(alike), "ru") for i in range(20)]
    shuffled = [(2000 + i, " ".join(rng.sample(t.split(), len(t.split()))), "en") for i, t, lang in clean[:40] if lang == "en"]
    got = {r.doc_id: r for r in quality_rules.judge(_frame(spark, [*clean, *other, *shuffled])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i, _, _ in clean) >= 0.99 * len(clean)
    assert not any(got[i].kept for i, _, _ in [*other, *shuffled])


def test_odd_perplexity_is_rejected_and_prose_kept(spark, prose):
    junk = (999, " ".join("qxzj%07d~^" % (k * 7919 % 9999) for k in range(60)), "en")
    docs = _frame(spark, [*prose, junk])
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not got[999].base_failed and not got[999].kept
    assert all(got[i].kept for i, _, _ in prose)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in prose}


def test_symbol_spam_and_foreign_text_are_rejected_in_each_language(spark):
    rng = random.Random(16)
    clean = [(i, _prose(rng, "de" if i % 3 == 0 else "en", rng.randint(25, 400)), "de" if i % 3 == 0 else "en") for i in range(900)]
    texts = [(lang, _prose(rng, lang, rng.randint(40, 400)).split()) for lang in ("en", "de") for _ in range(20)]
    spam = [(1000 + i, " ".join(w + rng.choice(["***", "%%%", "$$$", "&&&"]) for w in t), lang) for i, (lang, t) in enumerate(texts)]
    tables = [(2000 + i, " | ".join(t), lang) for i, (lang, t) in enumerate(texts)]
    foreign = [(3000 + i, " ".join(t), "de" if lang == "en" else "en") for i, (lang, t) in enumerate(texts[::4])]
    got = {r.doc_id: r for r in quality_rules.judge(_frame(spark, [*clean, *spam, *tables, *foreign])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i, _, _ in clean) >= 0.99 * len(clean)
    for bad in (spam, tables, foreign):
        assert sum(not got[i].kept for i, _, _ in bad) >= 0.9 * len(bad)


def test_language_held_out(spark, prose):
    docs = _frame(spark, [*prose, (900, None, "en"), (901, "12 345 !!", "de"), (902, "", None), (None, "ein schung", "de")])
    model = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in prose if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (900, 901, 902))
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.accepted}


def test_language_with_nothing_to_learn(odd, empty):
    model = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(odd, model).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_quality_held_out(spark, prose, odd):
    rng = random.Random(8)
    spoiled = [(1000 + i, " ".join(w + rng.choice(["!!", "###", "$$$"]) for w in t.split()), lang) for i, t, lang in prose]
    docs = _frame(spark, [*prose, *spoiled])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in prose] + [(i, 0, 0) for i, _, _ in spoiled] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in quality_classifier.predict(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i < 1000) for i in held]) > 0.97
    for r in quality_classifier.predict(odd, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_quality_with_one_class_or_none(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality_classifier.predict(odd, quality_classifier.fit(odd, labels, F.lit(True))).collect()} == {1.0}
    model = quality_classifier.fit(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_classifier.predict(odd, model).collect()} == {0.5}
    assert quality_classifier.predict(empty, model).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    rows = [(np.array([k % 2, 2 + int(rng.integers(5))]), np.ones(2)) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    w, b = quality_classifier.descend(rows, y)
    assert all(y[k] * (w[i].sum() + b) > 0.9 for k, (i, _) in enumerate(rows))


def test_language_model_equals_plain_version(spark, odd, prose, empty):
    texts = {i: t for i, t in [*enumerate(ODD), *((100 + i, t) for i, t, _ in prose)]}
    docs = _frame(spark, [(i, t, None) for i, t in texts.items()] + [(None, "the and unseen", None)])
    texts[None] = "the and unseen"
    got = {r.doc_id: r for r in lm_score.score(docs, fold(F.col("doc_id"), 5) != 1).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t in texts.items()}
    train = [i for i in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = Counter(), Counter()
    for i in train:
        words.update(tokens[i])
        pairs.update(zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True))
    n, v = sum(words.values()), len(words)
    for i, own in tokens.items():
        base = score = 0.0
        for before, w in zip(["<s>", *own[:-1]], own, strict=True):
            p = (words[w] + 0.5) / (n + 0.5 * (v + 1))
            c = len(train) if before == "<s>" else words[before]
            left = 1 / (1 + c ** (1 - lm_score.HEAPS)) if c else 1.0
            base += math.log10(p)
            score += math.log10((1 - left) * (pairs[before, w] / c if c else 0) + left * p)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(words[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert lm_score.score(empty, F.lit(True)).count() == 0


def test_language_model_without_training(odd):
    got = lm_score.score(odd, F.lit(False)).collect()
    assert len(got) == len(ODD) + 1 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0.0) for r in got)


def test_buckets_do_not_change_scores(odd, monkeypatch):
    whole = {(r.doc_id, round(r.score, 9)) for r in lm_score.score(odd, F.lit(True)).collect()}
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 500)
    assert {(r.doc_id, round(r.score, 9)) for r in lm_score.score(odd, F.lit(True)).collect()} == whole


PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def _places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(j, label) for phrase, label in PHRASES for j in range(len(words)) if words[j : j + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((j for j, _ in found), default=None), max((j for j, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, odd, empty):
    texts = [
        "Under the MIT license; under-the MIT License!", "Apache License, Version 2.0 and CC BY-NC 4.0", "Relased undr the MIT Licence.", "Licensed under the GNU General Public License, version 3.",
        "Lizensed under the GNU General Publik License, version 2", "under the", "thunder the mit licenses", "All rights reservd", "Licensed under CC BY-SA 4.0", "x " * 50_000 + "released under the mit license",
        "released ünder the mit license 世", "cc by", "nc",
    ]
    docs = _frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == _places(t), t
    assert [got[i].labels for i in range(len(texts))] == [
        "mit", "apache-2,cc-by-nc", "mit", "gpl-3", "gpl-2", "", "", "all-rights-reserved", "cc-by-sa", "mit", "mit", "", "",
    ]
    assert got[2].base_labels == "" and 0.8 < got[2].score < 1 and got[3].score == 1 and got[5].score == 0
    spans = {(r.doc_id, r.label, r.first_word, r.last_word, r.errors) for r in license_scan.notices(docs).collect()}
    assert (2, "mit", 0, 4, 3) in spans
    assert (9, "mit", 50_000, 50_004, 0) in spans
    assert all(tuple(r)[1:6] == _places(dict(enumerate(ODD)).get(r.doc_id, "no id here")) for r in license_scan.scan(odd).collect())
    assert license_scan.scan(empty).count() == 0


def test_samples_take_one_row_of_an_id(spark):
    from pyspark.sql import functions as F

    from sweeplog.llm import language_id, quality_classifier

    rows = [(1, f"plain words of text {k}", "en") for k in range(500)] + [(i, f"andere Worte stehen hier {i}", "de") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = language_id.train
    language_id.train = lambda bags, labels: seen.append(list(labels)) or train(bags, labels)
    try:
        language_id.fit(docs, F.lit(True), per_language=1000)
    finally:
        language_id.train = train
    assert seen[0].count("en") == 1 and seen[0].count("de") == 38
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    sizes = []
    train = quality_classifier.train
    quality_classifier.train = lambda bags, y: sizes.append(len(bags)) or train(bags, y)
    try:
        quality_classifier.fit(docs, labels, F.lit(True))
    finally:
        quality_classifier.train = train
    assert sizes == [39]
