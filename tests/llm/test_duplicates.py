"""Near-duplicates of texts and vectors, and components, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sweeplog.llm import embedding_dedup, minhash_dedup
from sweeplog.llm.components import connected, unite

SCHEMA = "doc_id long, text string, component_id long, kept boolean, cid long, tree int, node long, tokens string"


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + k) for k in range(1, 400)] + [(7, 7), (3, 2), (2, 3)] + [(rng.randrange(1000, 1200),) * 1 + (rng.randrange(1000, 1200),) for _ in range(150)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(links, "a long, b long").repartition(5), "a", "b").collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == _components(ids, [x for x in links if x[0] != x[1]])
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_unite_equals_components():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    label = unite(np.arange(300), i, j)
    assert dict(enumerate(label.tolist())) == _components(range(300), zip(i.tolist(), j.tolist(), strict=True))


def _set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _wanted(rows, size, threshold):
    sets = {i: _set(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in _components(ids, links).items()}


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    rows, number = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 2, 3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, max(0, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((number, " ".join(copy).upper() if rng.random() < 0.1 else "  ".join(copy)))
            number += 1
    hub = [word() for _ in range(120)]
    for _ in range(150):  # a large group of near copies
        copy = list(hub)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((number, " ".join(copy)))
        number += 1
    rows += [(number + k, "copy of the same text") for k in range(90)]
    number += 90
    return rows + [(number, None), (number + 1, ""), (number + 2, " \n"), (number + 3, "one"), (number + 4, "ONE"), (number + 5, "two one")]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = _rows()
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 5, False, 6, 7, 8, "x") for i, t in rows], SCHEMA).repartition(4)
    want = _wanted(rows, size, 80)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, size=size).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = minhash_dedup.keep_first(docs, size=size)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_large_nodes_are_branched_before_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "HOT", 40)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, size=2).collect()}
    assert got == {i: c for i, (_, c) in _wanted(rows, 2, 80).items()}


def test_every_similar_pair_of_a_large_template_family_meets(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "DEPTH", 2)  # the family is not parted, as a larger one would not be by twelve
    rng = random.Random(9)
    core = [f"c{k}" for k in range(75)]
    rows, number = [], 0
    for _ in range(900):
        own = [f"w{rng.randrange(10**9)}" for _ in range(13)]
        rows.append((number, " ".join(core + own)))
        if number % 15 == 0:
            rows.append((10_000 + number, " ".join(core + own[:5] + [f"w{rng.randrange(10**9)}" for _ in range(8)])))
        number += 1
    random.Random(10).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, size=2).collect()}
    assert got == {i: i % 10_000 for i, _ in rows}


def test_a_node_that_no_choice_parts_is_dealt_in_parts_that_all_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "HOT", 50)
    monkeypatch.setattr(minhash_dedup, "DEPTH", 1)
    rows = spark.createDataFrame([(i, 9, bytearray(64), 0, 7, 0) for i in range(200)], "cid long, n_shingles long, sketch binary, tree int, node long, level int")
    nodes = {}
    for r in minhash_dedup._branched(rows).collect():
        nodes.setdefault((r.tree, r.node), []).append(r.cid)
    assert max(map(len, nodes.values())) < 100
    assert len({(a, b) for n in nodes.values() for a in n for b in n if a < b}) == 200 * 199 // 2


def test_texts_without_ids_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (9, "q r s")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(docs, size=2).collect()), key=str)
    assert got == sorted([(None, 3, None, True)] * 2 + [(4, 3, 2, False)] * 2 + [(2, 3, 2, True), (9, 2, 9, True)], key=str)
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def _vectors():
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=64) for _ in range(300)]
    for k in range(60):
        rows.append(rows[k] * float(rng.uniform(0.1, 20)) + rng.normal(size=64) * np.linalg.norm(rows[k]) / 8 * rng.choice([0.1, 0.3, 0.33, 0.36]))
    rows += [rows[0] + rng.normal(size=64) * 0.05 for _ in range(120)]  # a dense group
    rows += [rows[1]] * 40
    return [[float(np.float32(x)) for x in v] for v in rows]


@pytest.mark.parametrize("tile", [embedding_dedup.TILE, 50])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 2000)
    vectors = _vectors()
    n = len(vectors)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, vectors[0][:32], [None] * 64]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(n + k, v, 2) for k, v in enumerate(odd)] + [(None, vectors[0], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    x = np.array(vectors)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = _components(range(n), zip(*(a.tolist() for a in np.nonzero(linked)), strict=True))
    assert [got[i].n_links for i in range(n)] == linked.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(n)] == [want[i] for i in range(n)]
    assert all((got[n + k].n_links, got[n + k].component_id, got[n + k].kept) == (0, n + k, True) for k in range(len(odd)))
    assert got[None].n_links == 0 and got[None].component_id is None


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("count", "words", "stays", "redrawn"), [(3000, 300, 0.9665, 0.05), (6000, 200, 0.96, 0.05)])
def test_similar_pairs_meet_within_a_template_family(count, words, stays, redrawn):
    """Texts of a family are about 0.75 alike, planted pairs 0.8 and more; all constants are those in use."""
    rng = random.Random(1)
    own = lambda: f"x{rng.getrandbits(40)}"
    texts = [[f"t{k}" if rng.random() < stays else own() for k in range(words)] for _ in range(count)]
    texts += [[own() if rng.random() < redrawn else w for w in texts[k]] for k in range(400)]
    hashed, at = minhash_dedup.shingles(pa.array([" ".join(t) for t in texts]), 2)
    sets = [set(hashed[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    similar = [(k, count + k) for k in range(400) if 100 * len(sets[k] & sets[count + k]) >= 80 * len(sets[k] | sets[count + k])]
    least = minhash_dedup.minima(hashed, at)
    sketch = (minhash_dedup.tb.mixed(least) & np.uint64(0xFF)).astype(np.uint8)
    met = set()
    for tree in range(minhash_dedup.TREES):
        columns = {
            "cid": np.arange(len(texts)), "n_shingles": np.diff(at).astype(np.int64), "tree": np.full(len(texts), tree), "level": np.zeros(len(texts), np.int64),
            "node": least[:, tree].view(np.int64), "sketch": pa.array([b.tobytes() for b in sketch], pa.binary()),
        }
        nodes = minhash_dedup.Nodes(pa.table(columns))
        nodes.branch()
        where = {}
        for row, group in zip(nodes.row.tolist(), nodes.group.tolist(), strict=True):
            where.setdefault(row, set()).add(group)
        met.update((a, b) for a, b in similar if where[a] & where[b])
    assert len(similar) > 150 and len(met) / len(similar) >= 0.95


def test_rows_that_share_an_id_lose_no_text(spark):
    a, b = "one two three four five six seven", "quite other words stand in this text"
    rows = [(3, a), (5, a), (5, b), (9, b + " now"), (9, b + " now"), (None, a), (None, a), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, __mark string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, size=2).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True)], key=str)
    kept = minhash_dedup.keep_first(docs, size=2)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (None, a), (None, a), (7, None), (7, None)], key=str)
    twice = spark.createDataFrame([(4, a), (4, a), (4, a + " more"), (8, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash_dedup.keep_first(twice, size=2).collect()) == [4, 8]
