"""Whitening of embeddings along their principal components, by incremental eigendecomposition.

Entries become whole numbers, x = floor(1024 c) + 100000. Each partition keeps the spectrum (count, mean, eigenvalues, eigenvectors) of
the scatter of the vectors it has seen, and adds a vector by one rank-one update along its difference from the mean: the new
eigenvalues are the roots of the secular equation, the new eigenvectors follow from them. Directions that the vector does not touch are
deflated, and so are equal eigenvalues, after a reflection that leaves one of them touched. Equal vectors of a batch are one
update with their number as weight. Two spectra are combined by successive rank-one updates too, one along each
eigenvector of the second and one along the difference of the means; sixteen partitions' spectra at a time, in rounds.

The eigenvectors so found span the space; one more distributed pass forms the covariance of all vectors, exactly centred, in
that basis (Rayleigh-Ritz), and its eigenvectors give the components to double precision. A task holds a few matrices of the
dimension's square, whatever the number of rows, and nothing is shuffled but such matrices.

Defined results: rows whose vector is null or holds null or non-finite entries (or such of 2^42 and more, which are no embeddings) are
left out; so are vectors of another length than most have (of the greater length, where two lengths have as many). Repeated rows and
rows with equal or null ids are rows of their own. Components along which nothing varies have null `whitened` and no part in the
identity error; `explained` is null where nothing varies at all. Components are numbered by falling eigenvalue, of equal ones any
basis is taken; each has its largest entry positive. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.session import materialize

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LARGEST = 2.0**42
# Partial results that one task combines.
FAN = 16
_EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - x)), one above each pole, and poles[j] - roots[i] at [i, j].

    poles ascend and differ, weights are positive. Each root is sought from its nearer pole, by a rational function through both
    neighbouring poles, or by halving where that leaves the bracket.
    """
    with np.errstate(all="ignore"):
        return _roots(poles, weights)


def _roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(poles)
    rows = np.arange(k)
    gap = np.append(np.diff(poles), weights.sum())
    middle = 1 + (weights / (poles - (poles + gap / 2)[:, None])).sum(axis=1)
    left = middle >= 0
    left[-1] = True
    delta = poles - poles[np.where(left, rows, np.minimum(rows + 1, k - 1))][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    tau = (low + high) / 2
    below = np.tri(k)
    after = np.minimum(rows + 1, k - 1)
    done = np.zeros(k, dtype=bool)
    for _ in range(100):
        apart = delta - tau[:, None]
        terms = weights / apart
        value = 1 + terms.sum(axis=1)
        slopes = terms / apart
        steep = slopes.sum(axis=1)
        done |= np.abs(value) <= 4 * _EPS * (1 + np.abs(terms).sum(axis=1) + np.abs(tau) * steep)
        if done.all():
            break
        high, low = np.where(value > 0, tau, high), np.where(value < 0, tau, low)
        first = (slopes * below).sum(axis=1)
        second = steep - first
        d1, d2 = apart[rows, rows], apart[rows, after]
        c = value - d1 * first - d2 * second
        a = (d1 + d2) * value - d1 * d2 * (first + second)
        b = d1 * d2 * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step[-1] = d1[-1] + first[-1] * d1[-1] ** 2 / (value[-1] - d1[-1] * first[-1])  # no pole above the last root
        new = tau + step
        # a step a little beyond an end that was tried ends there, any other that leaves the bracket halves it
        ended = np.clip(new, low, high)
        close = (np.abs(new - ended) <= 0.01 * (high - low)) & (ended != 0) & (ended != tau)
        new = np.where((new > low) & (new < high), new, np.where(close, ended, (low + high) / 2))
        new = np.where(done, tau, new)
        done |= np.abs(new - tau) <= 2 * _EPS * np.abs(tau)
        tau = new
    apart = delta - tau[:, None]
    return poles - apart[rows, rows], apart


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of vectors diag(values) vectors' + weight direction direction'."""
    z = np.sqrt(weight) * (vectors.T @ direction)
    norm = float(z @ z)
    if not norm > 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tolerance = 8 * _EPS * max(values[-1], norm)
    equal = np.append(np.diff(values) <= tolerance, False)
    if equal.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2] + 1, strict=True):
            part = z[start:end]
            length = np.sqrt(part @ part)
            if length > 0:
                u = part.copy()
                u[-1] += np.copysign(length, part[-1])
                u /= np.sqrt(u @ u)
                vectors[:, start:end] -= 2 * np.outer(vectors[:, start:end] @ u, u)
                last = -np.copysign(length, part[-1])
                z[start:end] = 0
                z[end - 1] = last
    touched = np.abs(z) * np.sqrt(norm) > tolerance
    if touched.any():
        poles, z = values[touched], z[touched]
        roots, apart = secular_roots(poles, z * z)
        # the weights of which these roots are exact: vectors made from them are orthogonal
        between = poles[:, None] - poles
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs(np.prod(-apart / between, axis=0)))
        new = np.copysign(exact, z)[:, None] / apart.T
        new /= np.sqrt((new * new).sum(axis=0))
        values[touched] = roots
        vectors[:, touched] = vectors[:, touched] @ new
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean, and the eigenvalues and eigenvectors of the scatter around the mean."""

    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    n: int = field(default=0)

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray, count: int = 1) -> None:
        apart = vector - self.mean
        total = self.n + count
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * count / total)
        self.mean = self.mean + apart * (count / total)
        self.n = total

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self.add(other.mean, other.n)

    def row(self, slot: int) -> pa.RecordBatch:
        columns = [np.array([self.n], np.float64), self.mean, self.values, self.vectors.ravel()]
        return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "state": pa.array([np.concatenate(columns).tobytes()], pa.binary())})

    @classmethod
    def read(cls, state: bytes) -> Spectrum:
        flat = np.frombuffer(state, np.float64)
        size = int(np.sqrt(len(flat))) - 1  # of 1 + 2 size + size^2 numbers
        return cls(flat[1 : 1 + size], flat[1 + size : 1 + 2 * size], flat[1 + 2 * size :].reshape(size, size), int(flat[0]))


def _partial(rows: DataFrame, of_part: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """slot, state: what a function makes of each partition's vectors."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = of_part(_entries(b) for b in batches if b.num_rows)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": pa.array([state], pa.binary())})

    return rows.select("vector").mapInArrow(made, "slot long, state binary")


def _combined(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The states of all partitions made one, `FAN` at a time."""

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        slot, states = table.column("slot")[0].as_py() // FAN, table.column("state").to_pylist()
        return pa.table({"slot": pa.array([slot], pa.int64()), "state": pa.array([combine([states[i] for i in order])], pa.binary())})

    while True:
        parts = materialize(parts, "partial")
        left = parts.count()
        if left < 2:
            found = parts.first()
            return found and bytes(found["state"])
        group = F.floor(F.col("slot") / F.lit(FAN)).cast("long")
        parts = parts.groupBy(group.alias("group")).applyInArrow(fold, "slot long, state binary")


def _summed(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, np.float64) for s in states], axis=0).tobytes()


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, -1) + OFFSET


class Centre:
    """n and the exact sums S of all vectors; gives x - S / n, and the sum of squares of n x - S."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact, as decimals; null beyond 38 digits."""
        y = x - self.base
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if largest < 1 << 62:
            v = y * self.n - np.array(self.rest, np.int64)
            if largest * largest * x.shape[1] < 1 << 62:
                return pa.array((v * v).sum(axis=1)).cast(pa.decimal128(38, 0))
            # three parts of 21 bits: sums of their products stay far below 64 bits
            v = np.abs(v)
            a, b, c = v >> 42, (v >> 21) & 0x1FFFFF, v & 0x1FFFFF
            parts = [(a * a, 84), (2 * a * b, 63), (2 * a * c + b * b, 42), (2 * b * c, 21), (c * c, 0)]
            total = [sum(t) for t in zip(*[[int(s) << shift for s in p.sum(axis=1).tolist()] for p, shift in parts], strict=True)]
        else:
            total = [sum((self.n * i - s) ** 2 for i, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([Decimal(t) if t < 10**38 else None for t in total], pa.decimal128(38, 0))


def usable(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) of the rows that have a vector of the commonest length with finite entries only."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)))
    rows = rows.where(F.coalesce(finite & (F.size("vector") > 0), F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
    return rows.where(F.size("vector") == (common["size"] if common else 0))


def centre(rows: DataFrame) -> Centre | None:
    """n and the sums of all vectors, in whole numbers; None where there is no vector."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch)
            # halves of 26 bits, so that no sum passes 64 bits
            parts = (x >> 26).sum(axis=0).tolist(), (x & 0x3FFFFFF).sum(axis=0).tolist()
            high = [a + b for a, b in zip(high, parts[0], strict=True)] if n else parts[0]
            low = [a + b for a, b in zip(low, parts[1], strict=True)] if n else parts[1]
            n += len(x)
        if n:
            total = [Decimal((a << 26) + b) for a, b in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array(total, pa.decimal128(38, 0))})

    parts = rows.select("vector").mapInArrow(summed, "place int, n long, s decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()  # a row for each dimension
    return Centre(found[0]["n"], [int(r["s"]) for r in found]) if found else None


def _spectrum(rows: DataFrame, at: Centre) -> Spectrum:
    """The spectrum of all vectors around their mean, by rank-one updates in each partition and between them."""

    def of_part(batches: Iterator[np.ndarray]) -> bytes | None:
        spectrum = Spectrum.empty(len(at.base))
        for x in batches:
            each, counts = np.unique(x - at.base, axis=0, return_counts=True)
            for vector, count in zip(each.astype(np.float64), counts.tolist(), strict=True):
                spectrum.add(vector, count)
        return spectrum.row(0).column("state")[0].as_py() if spectrum.n else None

    def combine(states: list[bytes]) -> bytes:
        spectrum = Spectrum.read(states[0])
        for state in states[1:]:
            spectrum.merge(Spectrum.read(state))
        return spectrum.row(0).column("state")[0].as_py()

    return Spectrum.read(_combined(_partial(rows, of_part), combine))


@dataclass
class Components:
    """Unit vectors (columns) by falling eigenvalue; a factor that whitens each (nan where nothing varies); shares of the trace."""

    vectors: np.ndarray
    factor: np.ndarray
    explained: np.ndarray
    identity_error: float


def components(rows: DataFrame, at: Centre, count: int = COMPONENTS) -> Components:
    basis = _spectrum(rows, at).vectors
    size = len(basis)

    def projected(batches: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in batches:
            p = at.centred(x) @ basis
            total = p.T @ p if total is None else total + p.T @ p
        return None if total is None else total.tobytes()

    inner = np.frombuffer(_combined(_partial(rows, projected), _summed), np.float64).reshape(size, size) / at.n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    chosen = np.argsort(-values, kind="stable")[:count]
    vectors = basis @ turn[:, chosen]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(chosen))])
    e, trace = values[chosen], float(np.trace(inner))
    varies = e > size * _EPS * max(values.max(), 0)
    with np.errstate(all="ignore"):
        factor = np.where(varies, 1 / np.sqrt(e), np.nan)
    explained = np.maximum(e, 0) / trace if trace > 0 else np.full(len(e), np.nan)
    found = Components(vectors, factor, explained, 0.0)
    used = np.flatnonzero(varies)

    def moments(batches: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in batches:
            w = (at.centred(x) @ vectors * factor)[:, used]
            state = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            total = state if total is None else total + state
        return None if total is None else total.tobytes()

    if len(used):
        flat = np.frombuffer(_combined(_partial(rows, moments), _summed), np.float64) / at.n
        mean, second = flat[: len(used)], flat[len(used) :].reshape(len(used), -1)
        found.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(used))).max())
    return found


def whiten(rows: DataFrame, *, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error: `count` rows for each usable vector."""
    id_type = rows.schema[id_col].dataType
    rows = usable(rows, id_col=id_col, vector_col=vector_col)
    schema = f"vec_id {id_type.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    at = centre(rows)
    if at is None:
        return rows.sparkSession.createDataFrame([], schema)
    found = components(rows, at, count)
    k = len(found.factor)

    def whitened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            w = (at.centred(x) @ found.vectors * found.factor).ravel()
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(w), at.n)), "deviation": at.deviation(x).take(each), "whitened": pa.array(w, from_pandas=True),
                    "explained": pa.array(np.tile(found.explained, len(x)), from_pandas=True), "identity_error": pa.array(np.full(len(w), found.identity_error)),
                }
            )

    return rows.mapInArrow(whitened, schema)
