"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of c or more are at most 2 - 2c apart in squared distance. All vectors are rotated by one random rotation
and cut into blocks of `BLOCK` dimensions; if a pair's squared distance is within that budget, then in at least one block it is
within the block's proportional share. So each block is range-joined by itself: its first two dimensions lay a grid of cells twice
as wide as the block's radius, a vector stays in its cell and visits those of half its neighbours that are in reach, and within a cell
the remaining dimensions are joined in strips of the radius's width, recursively. The union of the candidates is verified with the
exact cosine in double precision, and a pair is counted in the first block whose share it keeps, so no pair is ever emitted or
shuffled: a cell gives each of its vectors the number of its links and one link to its group.

Equal vectors form a class first and count as many. Cells with more than `TILE` vectors are cut into tiles that are joined pairwise, so
a region that holds a third of all vectors is many tasks. Each vector is sent about 2.5 times for each block.

Defined results: vectors that are null or zero, or hold null or non-finite components, link with nothing; neither do vectors of
different lengths; rows with a null id are counted by no one and link with nothing, with a null component; rows that share an id are
separate vectors whose components are united; an empty table gives no rows. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.llm.components import connected, unite
from sweeplog.session import join_small, materialize

BLOCK = 8
TILE = 16_384
# Pairs that are compared at once.
PAIRS = 400_000
# Verified pairs whose distances are held at once.
VERIFIED = 30_000


class Blocks:
    """The rotation of vectors of one length, its blocks, and the share of the squared distance that each has."""

    def __init__(self, size: int, cosine: float, seed: int = 29):
        rng = np.random.default_rng(seed + size)
        q, r = np.linalg.qr(rng.normal(size=(size, size)))
        self.rotation = q * np.sign(np.diag(r))
        self.starts = np.arange(0, size, BLOCK)
        self.ends = np.minimum(self.starts + BLOCK, size)
        self.cosine = cosine
        # a little more than the share, for rounding
        self.share = (2 - 2 * cosine) * (self.ends - self.starts) / size + 1e-9
        self.radius = np.sqrt(self.share)

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype(np.float64)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def cells(self, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The two cell numbers in block k, and how far each vector is above its cell's lower sides."""
        a = self.starts[k]
        plane = rotated[:, a : min(a + 2, self.ends[k])]
        if plane.shape[1] < 2:
            plane = np.hstack([plane, np.zeros((len(plane), 1))])
        width = 2 * self.radius[k]
        cell = np.floor(plane / width)
        return cell.astype(np.int32), plane - cell * width


def _places(blocks: Blocks, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(block, rows, cells, role): every vector at home (0), and as a visitor (1) to those of half its neighbours that are in reach."""
    rotated = blocks.unit(vectors) @ blocks.rotation
    for k in range(len(blocks.starts)):
        cell, above = blocks.cells(rotated, k)
        below = 2 * blocks.radius[k] - above
        yield k, np.arange(len(cell)), cell, 0
        for dx, dy, gap in ((0, 1, below[:, 1] ** 2), (1, -1, below[:, 0] ** 2 + above[:, 1] ** 2), (1, 0, below[:, 0] ** 2), (1, 1, below[:, 0] ** 2 + below[:, 1] ** 2)):
            rows = np.flatnonzero(gap <= blocks.share[k])
            if len(rows):
                yield k, rows, cell[rows] + np.array([dx, dy], np.int32), 1


def _vectors(column: pa.Array, size: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


class Cell:
    """The vectors of a cell (or of two tiles of one): links found so far of each, and the group each is in."""

    def __init__(self, blocks: Blocks, k: int, vectors: np.ndarray, weight: np.ndarray):
        self.blocks, self.k, self.weight = blocks, k, weight
        self.unit = blocks.unit(vectors)
        self.rotated = self.unit @ blocks.rotation
        self.single = self.unit.astype(np.float32)
        self.links = np.zeros(len(vectors), np.int64)
        self.label = np.arange(len(vectors))

    def join(self, left: np.ndarray, right: np.ndarray | None, dimension: int) -> None:
        """Range-join of two sets of places, or of one with itself, by strips along the block's next dimension."""
        a, end = self.blocks.starts[self.k], self.blocks.ends[self.k]
        other = left if right is None else right
        if not len(left) or not len(other):
            return
        if len(left) * len(other) <= PAIRS or a + dimension >= end:
            self._compare(left, right)
            return
        radius = self.blocks.radius[self.k]
        strips = np.floor(self.rotated[left, a + dimension] / radius).astype(np.int64)
        if right is None:
            parts = {int(s): left[strips == s] for s in np.unique(strips)}
            for s, part in parts.items():
                self.join(part, None, dimension + 1)
                if s + 1 in parts:
                    self.join(part, parts[s + 1], dimension + 1)
            return
        other_strips = np.floor(self.rotated[right, a + dimension] / radius).astype(np.int64)
        for s in np.unique(strips).tolist():
            part = left[strips == s]
            for t in (s - 1, s, s + 1):
                self.join(part, right[other_strips == t], dimension + 1)

    def _compare(self, left: np.ndarray, right: np.ndarray | None) -> None:
        other = left if right is None else right
        step = max(1, PAIRS // len(other))
        for at in range(0, len(left), step):
            # single precision passes all that could be links; double precision decides
            close = self.single[left[at : at + step]] @ self.single[other].T >= self.blocks.cosine - 1e-4
            if right is None:
                close &= np.arange(len(other))[None, :] > np.arange(at, min(at + step, len(left)))[:, None]
            i, j = np.nonzero(close)
            for b in range(0, len(i), VERIFIED):
                self._verify(left[at + i[b : b + VERIFIED]], other[j[b : b + VERIFIED]])

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        gap = np.add.reduceat((self.rotated[i] - self.rotated[j]) ** 2, self.blocks.starts, axis=1)
        first = (gap <= self.blocks.share).argmax(axis=1) == self.k
        first &= gap[:, self.k] <= self.blocks.share[self.k]
        first &= np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= self.blocks.cosine
        i, j = i[first], j[first]
        n = len(self.links)
        self.links += np.bincount(i, weights=self.weight[j], minlength=n).astype(np.int64) + np.bincount(j, weights=self.weight[i], minlength=n).astype(np.int64)
        self.label = unite(self.label, i, j)


def joined_cells(classes: DataFrame, cosine: float, dtype: str) -> DataFrame:
    """cid, links (weighted), root: for each cell and each of its vectors with a link in it. classes: cid, weight, size, vector (bytes)."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                for k, rows, cell, role in _places(Blocks(size, cosine), _vectors(part.column("vector"), size, dtype)):
                    n = len(rows)
                    chosen = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(np.ascontiguousarray(cell[:, 0])),
                            pa.array(np.ascontiguousarray(cell[:, 1])), pa.array(np.full(n, role, np.int32)), chosen.column("cid"), chosen.column("weight"), chosen.column("vector"),
                        ],
                        ["size", "k", "x", "y", "role", "cid", "weight", "vector"],
                    )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                for k, _, cell, role in _places(Blocks(size, cosine), _vectors(part.column("vector"), size, dtype)):
                    cells, n = np.unique(cell, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), size, np.int32)), pa.array(np.full(len(n), k, np.int32)), pa.array(np.ascontiguousarray(cells[:, 0])),
                            pa.array(np.ascontiguousarray(cells[:, 1])), pa.array(n * (role == 0)), pa.array(n * (role == 1)),
                        ],
                        ["size", "k", "x", "y", "home", "away"],
                    )

    where = ["size", "k", "x", "y"]
    counts = classes.mapInArrow(counted, "size int, k int, x int, y int, home long, away long").groupBy(*where)
    large = counts.agg(F.ceil(F.sum("home") / TILE).alias("th"), F.ceil(F.sum("away") / TILE).alias("tv")).where("th > 1 OR tv > 2")
    rows = classes.mapInArrow(placed, "size int, k int, x int, y int, role int, cid long, weight long, vector binary")
    rows = join_small(rows, large, where, "left", spread=["cid"]).withColumns({
        "th": F.greatest(F.coalesce("th", F.lit(1)), F.lit(1)).cast("int"), "tv": F.greatest(F.coalesce("tv", F.lit(1)), F.lit(1)).cast("int"),
    })
    # (i, j): home tiles i < j against each other; (i, -1 - v): home tile i against visitors v, and with v = 0 against itself
    rows = rows.withColumn("t", F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("role") == 0, F.col("th")).otherwise(F.col("tv"))).cast("int"))
    home = F.expr(
        "concat(transform(sequence(0, tv - 1), v -> struct(t AS i, -1 - v AS j, 0 AS side)),"
        " transform(filter(sequence(0, th - 1), o -> o <> t), o -> struct(least(t, o) AS i, greatest(t, o) AS j, IF(t < o, 0, 1) AS side)))"
    )
    away = F.expr("transform(sequence(0, th - 1), o -> struct(o AS i, -1 - t AS j, 1 AS side))")
    dealt = rows.withColumn("g", F.explode(F.when(F.col("role") == 0, home).otherwise(away)))
    dealt = dealt.select(*where, F.col("g.i").alias("i"), F.col("g.j").alias("j"), F.col("g.side").alias("side"), "cid", "weight", "vector")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        size, k, _, _, _, j = (x.as_py() for x in key)
        side = table.column("side").to_numpy()
        cell = Cell(Blocks(size, cosine), k, _vectors(table.column("vector"), size, dtype), table.column("weight").to_numpy())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if j == -1:
            cell.join(left, None, 2)
        cell.join(left, right, 2)
        linked = np.flatnonzero(cell.links > 0)
        cid = table.column("cid").to_numpy()
        return pa.table({"cid": pa.array(cid[linked]), "links": pa.array(cell.links[linked]), "root": pa.array(cid[cell.label[linked]])})

    return dealt.groupBy(*where, "i", "j").applyInArrow(joined, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (the smallest id reachable by links), kept (vec_id = component_id) of each row."""
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    dtype = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    whole = F.expr("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    good = F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()
    # two hashes of different kinds tell vectors apart
    keyed = rows.withColumn("ok", good).select(
        "vec_id", F.when(F.col("ok"), F.xxhash64("vector")).alias("h1"), F.when(F.col("ok"), F.hash("vector")).alias("h2"), F.when(F.col("ok"), F.col("vector")).alias("vector")
    )
    grouped = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = [flat[at[i] : at[i + 1]].tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), batch.column("cid"), batch.column("weight"), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary())],
                ["h1", "h2", "cid", "weight", "size", "vector"],
            )

    classes = materialize(grouped.mapInArrow(packed, "h1 long, h2 int, cid long, weight long, size int, vector binary"), "vectors")
    found = materialize(joined_cells(classes.select("cid", "weight", "size", "vector"), cosine, dtype), "cells")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    components = connected(found.where("cid <> root"), "cid", "root")
    named = classes.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("cid").alias("_cid"), "weight")
    named = named.join(links.withColumnRenamed("cid", "_cid"), "_cid", "left").join(components.withColumnRenamed("id", "_cid"), "_cid", "left")
    named = materialize(named, "classes")
    joined = keyed.select("vec_id", "h1", "h2").join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return joined.select(
        "vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "_cid", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
