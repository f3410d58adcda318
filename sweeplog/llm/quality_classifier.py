"""Quality classifier: a support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are over word shapes: letters become a or A, digits 9, runs of these one sign, other signs stay (up to three alike in a
row), and a word inside a passage of four words that its text repeats is marked. A text's indicators are its shape unigrams and
bigrams, and n-grams of marked words of lengths 2, 4, 8 and so on, hashed to `BUCKETS`; they are taken from whole texts. Each
indicator is scaled by the log ratio of its counts in good and bad texts; a linear hinge-loss model is fitted to the scaled,
length-normalised vectors by dual coordinate descent and its margin turned into a probability on texts not fitted to.

It learns from a bounded sample: about `sample` labelled texts chosen by a hash of the id.

Defined results: a null or empty text has no indicators and gets the probability of the bias alone; an id labelled twice counts with
its lower label; rows with a null label or id are not learned from; with labels of one class only, or none, every text scores the
share of good labels (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import sampled

BUCKETS = 1 << 18
PASSAGE = 4
LIMIT = 0.7
# Share of the learned weights that is kept beside their mean size, as proposed with the method.
KEEP = 0.25

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("9")
_MERGED = np.zeros(256, dtype=bool)
_MERGED[[ord("a"), ord("A"), ord("9")]] = True


def word_shapes(vocabulary: pa.Array) -> np.ndarray:
    """A hash of each word's shape."""
    data, at = tb.text_bytes(vocabulary)
    if not len(data):
        return np.zeros(len(vocabulary), np.uint64)
    shape = _SHAPE[data]
    first = np.zeros(len(data), dtype=bool)
    first[at[:-1]] = True
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (shape[1:] == shape[:-1]) & ~first[1:]
    third = same.copy()  # the fourth and later of a run of the same sign
    third[1:] &= same[:-1]
    fourth = third.copy()
    fourth[1:] &= third[:-1]
    keep = ~np.where(_MERGED[shape], same, fourth)
    sizes = tb.sums(keep, at)
    coded = tb.binary_array(shape[keep], np.concatenate([[0], np.cumsum(sizes)])).dictionary_encode()
    return tb.hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, texts one after the other, and their n + 1 offsets."""
    words = tb.words(*tb.text_bytes(texts))
    n = len(words.codes)
    count = len(texts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
    marked = tb.repeated(words, PASSAGE)
    shapes = word_shapes(words.vocabulary)
    token = shapes[words.codes]
    token[marked] ^= np.uint64(0x5851F42D4C957F2D)
    text = words.texts_of_words().astype(np.int64)
    last = np.zeros(n, dtype=bool)
    last[words.offsets[1:][words.counts > 0] - 1] = True
    follower = np.append(token[1:], np.uint64(0))
    follower[last] = 0
    with np.errstate(over="ignore"):
        pair = tb.mixed(token * np.uint64(3) + tb.mixed(follower))
    keys = [_keyed(text, pair), _keyed(text, tb.mixed(token + np.uint64(1)))]
    # runs of marked words: a run of n words holds n-grams of marked words of every length up to n
    begin = np.flatnonzero(marked & np.append(True, ~marked[:-1] | last[:-1]))
    end = np.flatnonzero(marked & (np.append(~marked[1:], True) | last)) + 1
    sizes = end - begin
    for power in range(1, 15):
        long = sizes >= 1 << power
        if long.any():
            keys.append(_keyed(text[begin[long]], np.full(int(long.sum()), power * 7919 + 11, dtype=np.uint64)))
    found = np.unique(np.concatenate(keys))
    return (found % BUCKETS).astype(np.int32), np.searchsorted(found, np.arange(count + 1) * BUCKETS)


def _keyed(text: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    return np.unique(text * BUCKETS + (hashed % np.uint64(BUCKETS)).astype(np.int64))


@dataclass
class QualityModel:
    """ratios, weights: of each bucket; the margin is the mean weighted ratio, and slope and offset turn it into a probability."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.ratios[buckets]
        norm = np.sqrt(tb.sums(r * r, at))
        return tb.sums(r * self.weights[buckets], at) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(buckets, at) + self.offset, -40, 40)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss. rows: buckets and values of each text; y: -1 or 1. Weights and bias."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    size = np.array([values @ values + 1.0 for _, values in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, values = rows[i]
            gradient = y[i] * (values @ w[buckets] + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[buckets] += step * values
                bias += step
                alpha[i] = new
    return w, bias


def train(bags: list[np.ndarray], labels: np.ndarray, *, cost: float = 1.0) -> QualityModel:
    """bags: the distinct buckets of each text; labels: 1 good, 0 bad."""
    good = np.asarray(labels) == 1
    empty = np.zeros(BUCKETS)
    if not len(good) or good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        return QualityModel(empty, empty, 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = [np.bincount(np.concatenate([bags[i] for i in np.flatnonzero(c)]), minlength=BUCKETS) + 1.0 for c in (good, ~good)]
    ratios = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratios[counts[0] + counts[1] == 2] = 0.0  # not seen
    rows = []
    for bag in bags:
        r = ratios[bag]
        rows.append((bag, r / max(float(np.sqrt(r @ r)), 1e-12)))
    y = np.where(good, 1.0, -1.0)
    fitted = np.random.default_rng(11).random(len(bags)) < 0.75 if len(bags) >= 40 else np.ones(len(bags), dtype=bool)
    w, bias = descend([rows[i] for i in np.flatnonzero(fitted)], y[fitted], cost=cost)
    # towards naive Bayes, where all weights are alike
    w = (1 - KEEP) * np.abs(w).mean() + KEEP * w if np.abs(w).any() else w
    model = QualityModel(ratios, w, KEEP * bias, 1.0, 0.0)
    check = ~fitted if (~fitted).any() and good[~fitted].any() and not good[~fitted].all() else fitted
    margins = np.array([values @ w[bag] + model.bias for bag, values in (rows[i] for i in np.flatnonzero(check))])
    model.slope, model.offset = _logistic(margins, good[check].astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(x.std()), 1e-9)
    z = (x - x.mean()) / spread
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return a / spread, b - a * x.mean() / spread


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches, "text"):
        buckets, at = indicators(block.column("text"))
        rows = [buckets[at[i] : at[i + 1]].tobytes() for i in range(block.num_rows)]
        yield pa.RecordBatch.from_arrays([block.column("key"), block.column("label"), pa.array(rows, pa.binary())], ["key", "label", "buckets"])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000
) -> QualityModel:
    """Learn from about `sample` labelled texts; `usable` is a condition on the id of `labels`. The sample is broadcast:
    `sample` ids and labels. Of rows that share an id one is taken."""
    known = (
        labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    )
    chosen = sampled(known, F.col("__id"), sample, known.count())
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    texts = texts.groupBy("__id", "label").agg(F.min("text").alias("text"))
    got = texts.select(F.col("__id").cast("string").alias("key"), "label", "text").mapInArrow(_bags, "key string, label int, buckets binary")
    rows = got.toArrow().sort_by([("key", "ascending"), ("buckets", "ascending")])
    bags = [np.frombuffer(b, np.int32) for b in rows.column("buckets").to_pylist()]
    return train(bags, rows.column("label").to_numpy())


def predict(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, score, predicted of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            scores = model.scores(*indicators(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(scores), pa.array((scores >= limit).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
