"""Packing, byte-level BPE and token files against the libraries and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sweeplog.llm import byte_bpe, packing, token_files

SCHEMA = "doc_id long, text string, tokens string, ids long, length long, part int, block long"
TEXTS = [
    "Hello world, it's  fine.\nNext line\n\nA para", None, "", "   ", "\t\n ", "café naïve 世界 \U0001f600!!", "x" * 3000, "!" * 500 + "a1b2", "é É Å",
    "a b c 　d", "word " * 6000, "<|endoftext|> is text", "'s don't we'll 'tis", "Ends with space ", "tab\tsep\x0bv \x1c x", "a.b,c;d 12 345.6", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, 3, 4) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None), (3, "   ", "x", 1, 2, 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return library


def _by_id(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bare", [True, False])
def test_packing_holds_every_id_once(docs, bare):
    vocabulary = "word_bpe_49k.json" if bare else "byte_bpe_50k.json"
    got = packing.pack_documents(docs, public_tokenizers.path(vocabulary), 2, capacity=64, bare=bare, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == _crc(r.ids) and len(r.ids) == r.length <= 64
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in _by_id(docs):
        ids = [*_library(vocabulary).encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[doc_id, len(ids)], key=lambda r: r.start)
        if doc_id == 3:  # the row that stands twice
            own = own[::2]
        assert [x for r in own for x in r.ids] == ids
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in got) > 64 * (len(sequences) - 1)  # but for the last, all are full here


def test_closest_fill_equals_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(40):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(0, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        used = packing.closest_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_each_count_once():
    histogram = {100: 7, 60: 11, 40: 11, 33: 5, 1: 3}
    fills = packing.plan_fills(histogram, 100)
    for length, n in histogram.items():
        assert sum(times * fill.get(length, 0) for times, fill in fills) == n
    assert all(sum(k * n for k, n in fill.items()) <= 100 for _, fill in fills)


def test_many_pieces_of_one_length_get_places_of_their_own(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "CASE WHEN id % 3 = 0 THEN 30L ELSE 34L END AS length", "id AS ids_crc32")
    got = packing.place_pieces(packing.materialize(pieces, "test"), ["doc_id"], capacity=64).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == 3000
    assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(places, places[1:], strict=False))


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json"), 2, bare=True).count() == 0


def _tiktoken():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    ids = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    library = _tiktoken()
    assert ids == {(i, tuple(library.encode_ordinary(t))) for i, t in _by_id(docs)}
    decoded = {(r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()}
    assert decoded == {(i, t.encode()) for i, t in _by_id(docs)}


def test_bpe_digests(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = _tiktoken()
    got = {tuple(r) for r in byte_bpe.round_trip_digests(docs, path, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, t in _by_id(docs):
        ids = library.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want
    assert byte_bpe.round_trip_digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_recursion_and_queue_contract_alike():
    bpe = byte_bpe.RelationalBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(np.frombuffer(b"abcdeth in\xc3\xa9", np.uint8), int(n)).tolist()) for n in rng.integers(1, byte_bpe.LONG_PIECE, 300)]
    flat, at = bpe.piece_ids(pieces)
    for i, piece in enumerate(pieces):
        assert flat[at[i] : at[i + 1]].tolist() == bpe._contracted(piece)


def test_token_files_round_trip(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = _library("byte_bpe_50k.json")
    manifest = token_files.write_tokens(docs, path, 2, files=4)
    got = sorted((tuple(r) for r in token_files.token_digests(manifest).collect()), key=lambda r: r[1])
    at = 0
    want = [(i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in _by_id(docs)]
    assert [r[0] for r in got] == [i for i, _ in want]
    for (doc_id, start, n, crc), (i, ids) in zip(got, want, strict=True):
        assert (doc_id, start, n, crc) == (i, at, len(ids), _crc(ids))
        at += n
    some = {(r.doc_id, tuple(r.tokens)) for r in token_files.read_tokens(manifest, [5, 10, 77]).collect()}
    assert some == {(i, tuple(ids)) for i, ids in want if i in (5, 10)}
    assert token_files.token_digests(token_files.write_tokens(empty, path, 2, files=2)).count() == 0


def test_a_reader_decompresses_only_wanted_frames_and_notices_damage(tmp_path):
    writer = token_files.FrameWriter(f"{tmp_path}/a.tok", width=2, frame_bytes=200)
    for i in range(100):
        writer.add(i, np.arange(i, i + 30, dtype=np.uint32))
    made = writer.close()
    assert made["documents"] == 100 and made["tokens"] == 3000
    reader = token_files.FrameReader(f"{tmp_path}/a.tok")
    (doc_id, tokens), = reader.documents({57})
    assert doc_id == 57 and tokens.tolist() == list(range(57, 87)) and reader.frames_read == 1 < len(reader.index)
    raw = bytearray((tmp_path / "a.tok").read_bytes())
    raw[int(reader.starts[3]) + 20] ^= 0xFF
    (tmp_path / "b.tok").write_bytes(raw)
    with pytest.raises(Exception, match="damaged|checksum|decompress|[Dd]ata"):
        token_files.FrameReader(f"{tmp_path}/b.tok").frame(3)
