"""Connected components of a graph given as links, by alternating star contractions on Spark.

Each round replaces links by links to the smallest neighbour, first towards larger ids, then towards smaller ones, until the links
form stars around the smallest id of each component. A task first reduces its own links to a forest. Hubs are no special case: minima
are aggregated before the shuffle and joined to the links from a stored table, so a hub's links can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.session import materialize

# Links that a task holds at a time while it makes its forest.
HELD = 2_000_000


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, with the classes of i[k] and j[k] made one for each k. A label is the smallest index of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def stars() -> pa.RecordBatch:
        links = np.concatenate(held)
        ids, index = np.unique(links, return_inverse=True)
        index = index.reshape(-1, 2)
        label = unite(np.arange(len(ids)), index[:, 0], index[:, 1])
        other = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            size += batch.num_rows
        if size >= HELD:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def connected(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) for each id that has a link to another; ids are integers."""
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    stars = materialize(pairs.mapInArrow(_forest, "a long, b long").distinct(), "stars")
    last = None
    for _ in range(rounds):
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        stars = materialize(small.distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == (now["n"], now["h"]):
            break
        last = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = stars.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
