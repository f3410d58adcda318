"""Language-model scoring of whole texts with a weighted backoff automaton over word n-grams.

The automaton has a state for each word seen in training, one for the beginning of a text, and the empty state. From a word's state
an arc leads on for each word that followed it in training, with the smoothed log-probability of that pair; a failure arc leads to
the empty state with the weight that is left, and the empty state has an arc for each word, known or not, with its smoothed unigram
log-probability. Reading a text from left to right carries the state and adds up the weights on the way; as a state is the word
just read, the steps of all texts of a block are looked up at once.

The n-grams of the corpus do not fit a task, so no task holds the automaton. Texts are stored as blocks of word codes. Each block
asks for its own distinct words and pairs: its sorted key hashes, with its training counts, go to the key's bucket, where counts of
equal keys are added up and sent back in the order asked. Blocks and buckets are of bounded size; a key that occurs everywhere comes
once from each block. Each block then reads its texts through its own part of the automaton.

Smoothing: P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and P(w | v) = (1 - b) c(v w) / c(v) + b P(w) with b = 1 / (1 + c(v)^(1 - HEAPS)),
which is the share of new followers where their number grows as c(v)^HEAPS.

Defined results: a null or empty text is its end alone; a row with a null id is scored, not learned from, and not held out; rows that
share an id are separate texts; with nothing to learn from all tokens are unknown; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.session import materialize

HEAPS = 0.9
# Tokens whose keys a bucket gets, about.
BUCKET_TOKENS = 2_000_000
WORDS, PAIRS = 0, 1
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers as byte planes under zstandard."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _widen(packed: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _squeeze_sorted(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _widen_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_widen(packed, np.uint64), dtype=np.uint64)


def encoded_blocks(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as blocks of word codes: block, ids, train (u8 each), sizes (words of each), codes, hashes (of each code), and totals."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            data, offsets = tb.text_bytes(block.column("text"))
            words = tb.words(tb.lowered(data), offsets)
            learned = block.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("doc_id"))
            number = int.from_bytes(os.urandom(8), "little") >> 1  # blocks are stored, so any distinct number will do
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), ids, pa.array([learned.tobytes()], pa.binary()), pa.array([_squeeze(words.counts.astype(np.int64))], pa.binary()),
                    pa.array([_squeeze(words.codes.astype(np.int32))], pa.binary()), pa.array([words.hashes().tobytes()], pa.binary()),
                    pa.array([len(words.codes) + block.num_rows], pa.int64()), pa.array([int(words.counts[learned == 1].sum() + learned.sum())], pa.int64()),
                    pa.array([int(learned.sum())], pa.int64()),
                ],
                ["block", "ids", "train", "sizes", "codes", "hashes", "tokens", "train_tokens", "train_texts"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        encoded, f"block long, ids array<{kind}>, train binary, sizes binary, codes binary, hashes binary, tokens long, train_tokens long, train_texts long"
    )


class Block:
    """A block's tokens: for each text its words and an end, each with the word before it."""

    def __init__(self, train: bytes, sizes: bytes, codes: bytes, hashes: bytes):
        self.train = np.frombuffer(train, np.uint8) == 1
        self.sizes = _widen(sizes, np.int64)
        words = _widen(codes, np.int32)
        self.hashes = np.frombuffer(hashes, np.uint64)
        n = len(self.hashes)
        self.begin, self.end = n, n + 1
        ends = np.cumsum(self.sizes + 1)
        self.offsets = np.concatenate([[0], ends])
        self.token = np.full(int(ends[-1]) if len(ends) else 0, self.end, dtype=np.int64)
        inside = np.ones(len(self.token), dtype=bool)
        inside[ends - 1] = False
        self.token[inside] = words
        self.before = np.concatenate([[self.begin], self.token[:-1]]) if len(self.token) else self.token
        self.before[self.offsets[:-1]] = self.begin
        self.learned = np.repeat(self.train, self.sizes + 1)

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the distinct words, and the codes in that order."""
        order = np.argsort(self.hashes)
        return self.hashes[order], order

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the distinct pairs, the pairs in that order, and all distinct pairs in ascending order."""
        every = self.before * (self.end + 1) + self.token
        pairs = np.unique(every)
        h = np.concatenate([self.hashes, [_BEGIN, _END]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = tb.mixed(h[pairs // (self.end + 1)] * np.uint64(0x9E3779B97F4A7C15) + tb.mixed(h[pairs % (self.end + 1)]))
        order = np.argsort(keys)
        return keys[order], order, pairs

    def pair_index(self, pairs: np.ndarray) -> np.ndarray:
        return np.searchsorted(pairs, self.before * (self.end + 1) + self.token)


def _requests(batch: dict, bits: int) -> Iterator[dict]:
    block = Block(batch["train"], batch["sizes"], batch["codes"], batch["hashes"])
    keys, order = block.word_keys()
    counts = np.bincount(block.token[block.learned & (block.token < block.begin)], minlength=len(keys))[order]
    yield from _by_bucket(batch["block"], WORDS, keys, counts, bits)
    keys, order, pairs = block.pair_keys()
    counts = np.bincount(block.pair_index(pairs)[block.learned], minlength=len(pairs))[order]
    yield from _by_bucket(batch["block"], PAIRS, keys, counts, bits)


def _by_bucket(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[dict]:
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    for b in np.unique(bucket).tolist():
        a, z = np.searchsorted(bucket, [b, b + 1])
        yield {"bucket": b, "block": block, "kind": kind, "keys": _squeeze_sorted(keys[a:z]), "counts": _squeeze(counts[a:z].astype(np.uint32))}


_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("totals", pa.binary()), ("seen", pa.int64())])


def _totals(group: pa.Table) -> pa.Table:
    """Adds up the counts of equal keys of a bucket and answers each block in its order; one more row says how many words were seen."""
    out = []
    bucket = group.column("bucket")[0].as_py()
    for kind in (WORDS, PAIRS):
        rows = [r for r in group.select(["block", "kind", "keys", "counts"]).to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        keys = [_widen_sorted(r["keys"]) for r in rows]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        totals = np.add.reduceat(np.concatenate([_widen(r["counts"], np.uint32) for r in rows]).astype(np.int64)[order], first)
        each = np.empty(len(flat), np.int64)
        each[order] = np.repeat(totals, np.diff(np.append(first, len(flat))))
        for i, r in enumerate(rows):
            out.append({"block": r["block"], "bucket": bucket, "kind": kind, "totals": _squeeze(each[at[i] : at[i + 1]]), "seen": 0})
        if kind == WORDS:
            out.append({"block": None, "bucket": bucket, "kind": kind, "totals": None, "seen": int((totals > 0).sum())})
    return pa.Table.from_pylist(out, _ANSWER)


class Automaton:
    """A block's part of the automaton. words: training count of each code; pairs: of each distinct pair."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, distinct: np.ndarray, *, tokens: int, vocabulary: int, texts: int):
        size = block.end + 1
        count = np.append(words, [0, texts]).astype(np.float64)  # a text's begin is not read; its end is
        self.empty = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        context = np.append(words, [texts, 0]).astype(np.float64)  # a text's begin is a state; its end is not
        left = np.where(context > 0, 1 / (1 + np.maximum(context, 1) ** (1 - HEAPS)), 1.0)
        self.failure = np.log10(left)
        before, token = distinct // size, distinct % size
        share = pairs / np.maximum(context[before], 1)
        self.arc = np.log10((1 - left[before]) * share + left[before] * 10 ** self.empty[token])
        self.has_arc = pairs > 0

    def read(self, block: Block, pair: np.ndarray) -> np.ndarray:
        """The weight of each step: an arc where there is one, else the failure arc and the empty state's arc."""
        return np.where(self.has_arc[pair], self.arc[pair], self.failure[block.before] + self.empty[block.token])


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row; learns from the rows where `train` holds."""
    kind = docs.schema[id_col].dataType.simpleString()
    stored = materialize(encoded_blocks(docs, train, id_col=id_col, text_col=text_col), "lm-blocks")
    sums = stored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_texts")]).first()
    bits = max(0, int(sums["tokens"]) // BUCKET_TOKENS).bit_length()

    def requests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for one in _requests(row, bits):
                    yield pa.RecordBatch.from_pylist([one], _REQUEST)

    asked = stored.select("block", "train", "sizes", "codes", "hashes").mapInArrow(requests, "bucket int, block long, kind int, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_totals, "block long, bucket int, kind int, totals binary, seen long"), "lm-answers")
    seen = int(answers.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"])
    learned = {"tokens": int(sums["train_tokens"]), "texts": int(sums["train_texts"]), "vocabulary": seen + (1 if sums["train_texts"] else 0)}

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row["train"], row["sizes"], row["codes"], row["hashes"])
            got = {}
            for kind_ in (WORDS, PAIRS):
                parts = [_widen(r["totals"], np.int64) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]) if r["kind"] == kind_]
                got[kind_] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            _, order = block.word_keys()
            words = np.empty(len(order), np.int64)
            words[order] = got[WORDS]
            _, order, distinct = block.pair_keys()
            pairs = np.empty(len(order), np.int64)
            pairs[order] = got[PAIRS]
            automaton = Automaton(block, words, pairs, distinct, **learned)
            steps = automaton.read(block, block.pair_index(distinct))
            known = np.append(words, [0, learned["texts"]])[block.token] > 0
            out.append(pa.table({
                "doc_id": left.column("ids").combine_chunks().flatten() if left.num_rows == 1 else pa.array(row["ids"]),
                "n_tokens": pa.array(block.sizes + 1), "n_known": pa.array(tb.sums(known, block.offsets)),
                "train_tokens": pa.array(np.full(len(block.sizes), learned["tokens"])), "base_score": pa.array(tb.sums(automaton.empty[block.token], block.offsets)),
                "score": pa.array(tb.sums(steps, block.offsets)),
            }))
        return pa.concat_tables(out)

    texts = stored.select("block", "ids", "train", "sizes", "codes", "hashes").groupBy("block")
    replies = answers.where(F.col("block").isNotNull()).select("block", "bucket", "kind", "totals").groupBy("block")
    return texts.cogroup(replies).applyInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
