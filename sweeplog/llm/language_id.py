"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and a calibrated limit for rejection.

A text is the average of the embeddings of its words' byte n-grams (2 to 4 bytes of `<word>`, hashed to `BUCKETS`); one linear
layer and a softmax follow. Both are trained in numpy by stochastic gradient descent on a bounded sample: about `per_language`
texts of each language, chosen by a hash of the id. A quarter of the sample is not trained on; it sets the temperature of the
softmax and the lowest probability at which predictions are accepted. Scoring reads every whole text: the layers are linear, so
each distinct word of a block has one vector of class scores, and a text's are the sums over its words.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected; rows without a language, or whose id
is null or in the held-out fold, are not learned from; with nothing to learn from every text is `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import unused

BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
# Languages beyond this are an error, as the model is held by each task.
MAX_LANGUAGES = 1000


def word_features(vocabulary: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the buckets of each word's n-grams, and where each word's begin (n + 1 values)."""
    data, at = tb.text_bytes(vocabulary)
    sizes = np.diff(at) + 2
    to = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.zeros(int(to[-1]), dtype=np.uint64)
    padded[to[:-1]], padded[to[1:] - 1] = ord("<"), ord(">")
    padded[np.arange(len(data)) + np.repeat(to[:-1] + 1 - at[:-1], sizes - 2)] = tb.lowered(data)
    left = np.repeat(to[1:], sizes) - np.arange(len(padded))
    out = []
    for size in SIZES:
        code = np.full(len(padded), size, dtype=np.uint64)
        for k in range(size):
            code[: len(padded) - k] = code[: len(padded) - k] * np.uint64(257) + padded[k:]
        whole = left >= size
        counts = np.maximum(sizes - size + 1, 0)
        out.append(((tb.mixed(code[whole]) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate([[0], np.cumsum(counts)])))
    return out


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, buckets, counts: the bag of each text."""
    for block in tb.blocks(batches, "text"):
        words = tb.words(*tb.text_bytes(block.column("text")))
        features = word_features(words.vocabulary)
        rows = []
        for i in range(block.num_rows):
            codes = words.codes[words.offsets[i] : words.offsets[i + 1]]
            got = np.concatenate([tb.gathered(values, at, codes)[0] for values, at in features])
            buckets, counts = np.unique(got, return_counts=True)
            rows.append((buckets.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [block.column("key"), block.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            ["key", "label", "buckets", "counts"],
        )


@dataclass
class LanguageModel:
    """word: class scores of each bucket (embedding times layer); bias, temperature, and the lowest accepted probability."""

    languages: list[str]
    word: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.5

    def probabilities(self, totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logits = (totals / np.maximum(sizes, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent over (buckets, counts) of each text, in a fixed random order."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(label) for label in labels])
    weights = [counts / max(counts.sum(), 1.0) for _, counts in bags]
    held = rng.random(len(bags)) < 0.25 if len(bags) >= 40 else np.zeros(len(bags), dtype=bool)
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    used = np.flatnonzero(~held)
    steps, step = epochs * max(len(used), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            at = rate * (1 - step / steps)
            step += 1
            buckets, w = bags[i][0], weights[i]
            hidden = w @ embedding[buckets]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= at * np.outer(hidden, p)
            bias -= at / 10 * p
            # an average spreads a step over all n-grams of the text, so embeddings move ten times as far
            embedding[buckets] -= (at * 10) * np.outer(w, back)
    model = LanguageModel(languages, embedding @ layer, bias)
    if held.any():
        _calibrate(model, [(bags[i][0], weights[i]) for i in np.flatnonzero(held)], y[held])
    return model


def _calibrate(model: LanguageModel, texts: list, y: np.ndarray, right: float = 0.995) -> None:
    """The temperature of least log-loss; the lowest probability above which `right` of the predictions are right."""
    totals = np.array([w @ model.word[buckets] for buckets, w in texts])
    ones = np.ones(len(texts))

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(model.probabilities(totals, ones)[np.arange(len(y)), y] + 1e-12).mean()

    model.temperature = min((float(t) for t in np.geomspace(0.2, 8, 40)), key=loss)
    p = model.probabilities(totals, ones)
    good, top = p.argmax(axis=1) == y, p.max(axis=1)
    limits = [x for x in np.arange(0.3, 0.95, 0.025) if (top >= x).any() and good[top >= x].mean() >= right]
    model.limit = float(min(limits)) if limits else 0.5


def fit(rows: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> LanguageModel:
    """Learn from the rows where `usable` holds, from about `per_language` texts of each language; of rows that share an id one is taken."""
    known = rows.where(usable & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    chosen = chosen.groupBy("key", "label").agg(F.min("text").alias("text"))
    got = chosen.mapInArrow(_bags, "key string, label string, buckets binary, counts binary").toArrow().sort_by([("label", "ascending"), ("key", "ascending")])
    bags = [
        (np.frombuffer(b, np.int32), np.frombuffer(c, np.float32).astype(np.float64))
        for b, c in zip(got.column("buckets").to_pylist(), got.column("counts").to_pylist(), strict=True)
    ]
    return train(bags, got.column("label").to_pylist())


def _predicted(texts: pa.Array, model: LanguageModel) -> tuple[pa.Array, np.ndarray]:
    n = len(texts)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not n or not model.languages:
        return pa.array([UNKNOWN] * n, pa.string()), np.zeros(n)
    words = tb.words(*tb.text_bytes(texts))
    each = np.zeros((len(words.vocabulary), len(model.languages)))
    sizes = np.zeros(len(words.vocabulary), dtype=np.int64)
    for buckets, at in word_features(words.vocabulary):
        sizes += np.diff(at)
        for c in range(len(model.languages)):
            each[:, c] += tb.sums(model.word[:, c][buckets], at)
    totals = np.stack([tb.weighted_sums(words, each[:, c]) for c in range(len(model.languages))], axis=1)
    p = model.probabilities(totals, tb.weighted_sums(words, sizes))
    names = pa.array(model.languages, pa.string()).take(pa.array(p.argmax(axis=1)))
    return pc.if_else(pa.array(lettered), names, UNKNOWN), np.where(lettered, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), accepted of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            names, p = _predicted(block.column("text"), model)
            accepted = (p >= model.limit) & (p > 0)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), names, pa.array(p), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows whose language the model accepts, with all their columns."""
    columns = docs.columns
    (text,) = unused(docs, "text")
    rows = docs.withColumn(text, F.col(text_col).cast("string"))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, text):
            _, p = _predicted(block.column(text), model)
            yield block.select(columns).filter(pa.array((p >= model.limit) & (p > 0)))

    return rows.mapInArrow(kept, docs.schema)
