"""Fingerprints against a plain parse of one text at a time."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sweeplog.llm import textblocks as tb
from sweeplog.llm import text_signatures as op

MASK = (1 << 64) - 1


def mixed(x):
    return int(tb.mixed(np.array([x & MASK], np.uint64))[0])


def coin(a, b):
    low = (a ^ b) & -(a ^ b)
    return 2 * (low.bit_length() - 1) + bool(b & low)


def starts(symbols):
    label = [symbols[0] & 1] + [coin(a, b) for a, b in zip(symbols, symbols[1:])]
    for _ in range(3):
        label = [label[0] & 1] + [coin(a, b) for a, b in zip(label, label[1:])]
    for high in (3, 4, 5):
        for i in range(len(label)):
            if label[i] == high:
                label[i] = min({0, 1, 2} - set(label[max(i - 1, 0) : i] + label[i + 1 : i + 2]))
    side = [7, *label, 7]
    top = [side[i] < x > side[i + 2] for i, x in enumerate(label)]
    low = [side[i] > x < side[i + 2] and True not in top[max(i - 1, 0) : i + 2] for i, x in enumerate(label)]
    return [i for i in range(len(label)) if i == 0 or top[i] or low[i]]


def parse(text, depth):
    symbols, out = list(text), []
    for level in range(depth):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        names = [int(op._BYTE_NAMES[s]) if level == 0 else s for s, _ in runs]
        names = [mixed(x + 0x5851F42D4C957F2D * r) if r > 1 else x for x, (_, r) in zip(names, runs)]
        cut = starts([s for s, _ in runs]) if runs else []
        symbols = [mixed(sum(x * int(op._PLACE[k]) for k, x in enumerate(names[a:b])) + b - a) for a, b in zip(cut, [*cut[1:], len(names)])]
        assert all(b - a <= 4 for a, b in zip(cut, [*cut[1:], len(names)]))
        out.append(symbols)
    return out


def plain_print(text):
    found = parse(text, max(op.LEVELS))
    hashes = [sorted({mixed(x) >> 32 for x in found[k - 1]})[: op.KEPT] for k in op.LEVELS]
    whole = mixed(len(found[-1]) + sum(mixed(x + mixed(i + 1)) for i, x in enumerate(found[-1])))
    return whole.to_bytes(8, "big") + bytes(len(h) for h in hashes) + b"".join(x.to_bytes(4, "big") for h in hashes for x in h)


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def sets(p):
        sizes, at, out = p[8:12], 12, []
        for n in sizes:
            out.append({p[at + 4 * i : at + 4 * i + 4] for i in range(n)})
            at += 4 * n
        return out

    common = union = 0
    for x, y in zip(sets(a), sets(b)):
        both = sorted(x | y)[: op.KEPT]
        union += len(both)
        common += sum(h in x and h in y for h in both)
    return common / max(union, 1)


TEXTS = st.lists(st.one_of(st.text("ab", max_size=40), st.text("abc é日", max_size=200), st.text(max_size=30)), min_size=1, max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_fingerprints_equal_the_plain_parse(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = op._joined(raw)
    assert op.fingerprints(data, offsets) == [plain_print(t) for t in raw]
    for k, (names, at) in enumerate(op.levels(data, offsets, 4)):
        assert [names[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [parse(t, 4)[k] for t in raw]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefgh ", min_size=300, max_size=400), st.text(max_size=50), st.text(max_size=50))
def test_equal_substrings_share_their_inner_phrases(middle, before, behind):
    a = parse(middle.encode(), 3)
    b = parse((before + middle + behind).encode("utf-8", "ignore"), 3)
    for level, edge in ((0, 8), (1, 12), (2, 12)):
        inner = a[level][edge:-edge]
        whole = b[level]
        assert not inner or any(whole[i : i + len(inner)] == inner for i in range(len(whole) - len(inner) + 1))


def plain_rows(rows):
    """What the operator gives for rows in order."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        moved = len(text) // 4
        changed = text[: len(text) - moved] + after[:moved]
        own, other, following = (plain_print(t.encode()) for t in (text, changed, after))
        near = plain_likeness(own, other), plain_likeness(own, following)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, *near))
    return out


def compared(spark, rows, schema="doc_id long, text string"):
    found = op.compare_neighbours(spark.createDataFrame(rows, schema))
    return sorted(
        [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in found.collect()],
        key=lambda r: (r[0] is not None, r),
    )


def test_neighbours_across_partitions(spark):
    import random

    rng = random.Random(2)
    words = ["wind", "été", "日本", "corn", "lamp", "a", "of", "river", "stone"]
    rows = [(i * 7, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows[20], rows[21], rows[22], rows[149] = (140, None), (147, ""), (154, "é"), (1043, "x" * 5000)
    shuffled = [(i, t, t, 1, "b") for i, t in rows]
    rng.shuffle(shuffled)
    got = compared(spark, shuffled, "doc_id long, text string, `order` string, slot int, edge string")
    assert got == sorted(plain_rows(rows))


def test_repeated_rows_null_ids_and_an_only_row(spark):
    assert compared(spark, [(5, "abcdefgh" * 9)]) == plain_rows([(5, "abcdefgh" * 9)])
    assert compared(spark, [(5, "abcdefgh"), (5, "abcdefgh")]) == plain_rows([(5, "abcdefgh"), (5, "abcdefgh")])
    assert compared(spark, [(2, "b b b b"), (None, "some words here")]) == plain_rows([(None, "some words here"), (2, "b b b b")])
    assert compared(spark, [(1, None)])[0][5:] == (1.0, 1.0)
    assert compared(spark, []) == []


def test_likeness_tells_an_edit_from_another_text(spark):
    from sweeplog.llm.queries import REGISTRY

    rows = REGISTRY["op13_text_signatures"][0](spark, "/root/testdata/sf0.001").where("n_chars > 500").collect()
    edited, following = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert np.median(edited) > 0.45 and np.quantile(edited, 0.05) > 0.3 and np.median(following) < 0.1
    assert len(rows[0].fingerprint) <= 2 * (8 + 4 + 4 * 64)


def test_fingerprints_where_the_texts_lie(spark):
    rows = [(1, "a few words"), (None, None), (1, "a few words")]
    got = op.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_chars, bytes(r.fingerprint)) for r in got) == sorted((len(t or ""), plain_print((t or "").encode())) for _, t in rows)
