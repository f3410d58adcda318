"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Texts with equal sets form a class first. Each class chooses a minwise token in each of
several independent trees and so comes to a node; nodes with more than `NODE` members branch again, each member by its next chosen
minwise token, until they are small, and small nodes are compared exhaustively by their sketches. A choice keeps a pair of similarity s
together with probability s, so a path of depth d would keep it with s^d only. Therefore a node makes a second choice in some cases, by
chance, and its members stand in the children of both: at the threshold a pair is then expected in one node of a tree at any depth.
Groups of near copies, whose members stay together anyway, are left out of that.

Pairs that look similar are confirmed on the full sets. A node first gives a spanning forest of its similar pairs, so a large group
of copies gives about as many pairs as members. When these are confirmed and the components known, the nodes are read again for
the pairs whose members are still apart; those that are similar by many more coordinates of their sets are all confirmed too. Members that twelve choices do not part are all compared too,
tile by tile; pairs that are linked already are left out, so near copies cost little, while a family of texts just below the threshold
costs the square of its size.

Very large nodes are branched on Spark before they are dealt to tasks, so a token that a third of all documents choose is spread.
Those that stay very large are dealt as pairs of parts, such that any two members meet in a task.

Defined results: a null or empty text has no shingles, is linked with nothing and stays; a text with fewer words than a shingle is
one shingle; rows with a null id are linked with nothing and stay, with a null component; rows that share an id are documents of their
own, each with the component of its text, of which `keep_first` keeps one for each group; an empty table gives no rows. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.components import connected, unite
from sweeplog.llm.frames import id_and_text, unused
from sweeplog.session import join_small, materialize

COORDINATES = 64
TREES = 12
NODE = 64
DEPTH = 12
# A node is branched by a second choice too in so many hundredths of the cases, 100 / threshold - 1, so that a pair of this similarity
# is expected in one child whatever the depth; but not where this share of all pairs stays together, which shows a group of near copies.
TWICE = 25
ALIKE = 0.8
# Rows on a side of a tile of a large node.
TILE = 256
# Rows of a node beyond which it is branched on Spark, and rows that a task compares at a time.
HOT = 50_000
HELD = 200_000

# Further coordinates by which pairs of the second reading of the nodes are compared, before their sets are.
FINE = 512

_SALT = tb.mixed(np.arange(1, COORDINATES + FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = tb.mixed(_SALT) | np.uint64(1)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, texts one after the other, and the n + 1 offsets."""
    data, offsets = tb.text_bytes(texts)
    words = tb.words(tb.lowered(data), offsets)
    each = words.hashes()
    hashed, whole = tb.window_hashes(words, size, each)
    counts = words.counts
    for short in range(1, size):  # the whole text is its only shingle
        rows = words.offsets[:-1][counts == short]
        if len(rows):
            other, _ = tb.window_hashes(words, short, each)
            hashed[rows] = tb.mixed(other[rows] + np.uint64(short))
            whole[rows] = True
    place = np.flatnonzero(whole)
    hashed, text = hashed[place], words.texts_of_words()[place]
    order = np.argsort(hashed)
    order = order[np.argsort(text[order], kind="stable")]
    hashed, text = hashed[order], text[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])) if len(hashed) else np.zeros(0, dtype=bool)
    hashed, text = hashed[new], text[new]
    return hashed, np.searchsorted(text, np.arange(len(texts) + 1))


def minima(hashed: np.ndarray, at: np.ndarray, coordinates: range = range(COORDINATES)) -> np.ndarray:
    """The minwise value of each text (that has shingles) under each coordinate's permutation."""
    full = at[:-1][np.diff(at) > 0]
    out = np.empty((len(full), len(coordinates)), dtype=np.uint64)
    if len(full):
        for place, k in enumerate(coordinates):
            out[:, place] = np.minimum.reduceat((hashed ^ _SALT[k]) * _ODD[k], full)
    return out


def floor_of(threshold: int, coordinates: int) -> float:
    """The least share of equal coordinates of a pair that counts as similar: four deviations below the threshold."""
    s = threshold / 100
    return s - 4 * float(np.sqrt(s * (1 - s) / coordinates))


def sketched(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, two sums that tell sets apart, the chosen tokens, and a byte of each minwise token."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            hashed, at = shingles(block.column("text"), size)
            counts = np.diff(at)
            least = minima(hashed, at)
            has = counts > 0
            low, high = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            if has.any():
                low[has] = np.add.reduceat(hashed, at[:-1][has]).view(np.int64)
                high[has] = np.add.reduceat(tb.mixed(hashed), at[:-1][has]).view(np.int64)
            bytes_ = (tb.mixed(least) & np.uint64(0xFF)).astype(np.uint8)
            row = np.cumsum(has) - 1
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * TREES)]), pa.int32()), pa.array(least[:, :TREES].ravel().view(np.int64)))
            sketch = pa.array([bytes_[row[i]].tobytes() if has[i] else None for i in range(len(counts))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("mark"), pa.array(counts.astype(np.int64)), pa.array(low), pa.array(high), tokens, sketch],
                ["doc_id", "mark", "n_shingles", "low", "high", "tokens", "sketch"],
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(made, "doc_id long, mark long, n_shingles long, low long, high long, tokens array<long>, sketch binary")


def _coordinate(tree, level, second=0):
    """Which byte of the sketch a tree branches by at a level, first or (1) second; the first ones are its first choices."""
    return TREES + (tree * 17 + level * 5 + second * 2) % (COORDINATES - TREES)


def _branched(rows: DataFrame) -> DataFrame:
    """rows with very large nodes branched until none is left, or no choice is left; those left are dealt in pairs of parts."""
    for _ in range(DEPTH):
        byte = lambda second: F.col("sketch").substr(F.lit(TREES + 1) + F.pmod(F.col("tree") * 17 + F.col("level") * 5 + second * 2, F.lit(COORDINATES - TREES)), F.lit(1))
        child = rows.groupBy("tree", "node", "level", byte(0).alias("_byte")).agg(F.count(F.lit(1)).alias("_c"))
        sizes = child.groupBy("tree", "node").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_together"))
        twice = (F.pmod(F.xxhash64("tree", "node"), F.lit(100)) < TWICE) & (F.col("_together") < ALIKE * F.col("_n") * F.col("_n"))
        hot = materialize(sizes.where(F.col("_n") > HOT).select("tree", "node", twice.alias("_twice")), "hot-nodes")
        if hot.isEmpty():
            return rows
        columns = rows.columns
        rows = join_small(rows, hot, ["tree", "node"], "left", spread=["cid"], stored=True)
        one, two = F.xxhash64("node", byte(0)), F.xxhash64("node", byte(1), F.lit(2))
        nodes = F.when(F.col("_twice").isNull(), F.array("node")).when(F.col("_twice"), F.array(one, two)).otherwise(F.array(one))
        level = F.when(F.col("_twice").isNull(), F.col("level")).otherwise(F.col("level") + 1)
        rows = rows.withColumn("level", level).withColumn("node", F.explode(nodes)).select(*columns)
    return _parted(rows)


def _parted(rows: DataFrame) -> DataFrame:
    """rows with each very large node cut into parts of about HOT / 2 rows and a node for each two parts, which has the rows of both."""
    parts = F.ceil(F.col("_n") * 2 / HOT).cast("int").alias("_parts")
    hot = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("tree", "node", parts)
    hot = materialize(hot, "hot-nodes")
    if hot.isEmpty():
        return rows
    columns = rows.columns
    rows = join_small(rows, hot, ["tree", "node"], "left", spread=["cid"])
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("cid", "tree"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))))
    # two parts meet in their node, one part with itself in the nodes that it shares with others
    rows = rows.where((F.col("_other") < 0) | (F.col("_other") != F.col("_part")))
    both = F.xxhash64("node", F.least("_part", "_other"), F.greatest("_part", "_other"))
    return rows.withColumn("node", F.when(F.col("_other") < 0, F.col("node")).otherwise(both)).select(*columns)


class Nodes:
    """The members of whole level-one nodes, as columns; nodes are branched and compared here.

    After branching a member may stand in several nodes: `row` is the member of each standing.
    """

    def __init__(self, table: pa.Table):
        self.cid = table.column("cid").to_numpy()
        self.n = table.column("n_shingles").to_numpy()
        self.tree = table.column("tree").to_numpy().astype(np.int64)
        self.level = table.column("level").to_numpy().astype(np.int64)
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        self.component = table.column("component").to_numpy() if "component" in table.column_names else None
        self.fine = None
        if "fine" in table.column_names:
            self.fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        self.row = np.arange(len(self.cid))
        # members that chosen pairs have linked so far have equal labels, whichever nodes they stand in
        self.label = np.arange(len(self.cid)) if self.component is None else np.unique(self.component, return_inverse=True)[1]
        # what led to the node: equal for its members, so that all of them make the same choices
        self.path = tb.mixed(tb.mixed(table.column("node").to_numpy().view(np.uint64)) + self.tree.astype(np.uint64))
        _, self.group = np.unique(self.path, return_inverse=True)

    def branch(self) -> None:
        while True:
            sizes = np.bincount(self.group)
            large = (sizes[self.group] > NODE) & (self.level < DEPTH)
            at = np.flatnonzero(large)
            if not len(at):
                break
            children = [self._children(at, 0)]
            _, first, part, counts = np.unique(children[0], return_index=True, return_inverse=True, return_counts=True)
            together = np.bincount(self.group[at[first]], weights=counts.astype(float) ** 2, minlength=len(sizes))
            seldom = together[self.group[at]] < ALIKE * sizes[self.group[at]].astype(float) ** 2
            again = at[seldom & (tb.mixed(self.path[at] + np.uint64(3)) % np.uint64(100) < TWICE)]
            children.append(self._children(again, 1))
            rest, at = np.flatnonzero(~large), np.concatenate([at, again])
            self.path = np.concatenate([self.path[rest], *children])
            self.level = np.concatenate([self.level[rest], self.level[at] + 1])
            self.row = np.concatenate([self.row[rest], self.row[at]])
            self.tree = np.concatenate([self.tree[rest], self.tree[at]])
            _, self.group = np.unique(self.path, return_inverse=True)

    def _children(self, at: np.ndarray, second: int) -> np.ndarray:
        """The path that each standing takes from its node by its first or second choice."""
        chosen = self.sketch[self.row[at], _coordinate(self.tree[at], self.level[at], second)]
        return tb.mixed(tb.mixed(self.path[at] + np.uint64(second + 1)) + chosen)

    def similar(self, floor: float, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of members of a small node that look similar: two places, and in how many coordinates they agree."""
        order, sizes = self._ordered()
        keep = (sizes > 1) & (sizes <= NODE)
        order = order[keep[self.group[order]]]
        group = self.group[order]
        out = []
        for shift in range(1, NODE):
            if shift >= len(order):
                break
            at = np.flatnonzero(group[shift:] == group[:-shift])
            if not len(at):
                break
            out.append(self._compared(self.row[order[at]], self.row[order[at + shift]], floor, threshold))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The standings by node, and the size of each node."""
        return np.argsort(self.group, kind="stable"), np.bincount(self.group)

    def similar_in_large(self, floor: float, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of a node that is still large, some tiles at a time: a spanning forest of those that look similar, or, with
        components, all whose components differ."""
        order, sizes = self._ordered()
        ends = np.cumsum(sizes)
        for g in np.flatnonzero(sizes > NODE):
            rows = self.row[order[ends[g] - sizes[g] : ends[g]]]
            label = np.unique(self.label[rows], return_inverse=True)[1]
            linked = []
            for a in range(0, len(rows), TILE):
                for b in range(a, len(rows), TILE):
                    x, y = np.arange(a, min(a + TILE, len(rows))), np.arange(b, min(b + TILE, len(rows)))
                    i, j = self._tile(rows, label, x, y, floor, threshold)
                    if not len(i):
                        continue
                    if self.component is None:
                        both, where = np.unique(np.concatenate([label[i], label[j]]), return_inverse=True)
                        chosen = forest(len(both), where[: len(i)], where[len(i) :])
                        i, j = i[chosen], j[chosen]
                        label = self._united(label, both, where, len(where) // 2, chosen)
                        linked.append((rows[i], rows[j]))
                    yield rows[i], rows[j]
            if linked:
                self.link(*(np.concatenate(x) for x in zip(*linked, strict=True)))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = unite(self.label, i, j)

    @staticmethod
    def _united(label: np.ndarray, both: np.ndarray, where: np.ndarray, half: int, chosen: np.ndarray) -> np.ndarray:
        """label with the labels that the chosen pairs link made one."""
        least = unite(np.arange(len(both)), where[:half][chosen], where[half:][chosen])
        new = np.arange(label.max() + 1)
        new[both] = both[least]
        return new[label]

    def _tile(self, rows: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray, floor: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of x and y (numbers in rows) that look similar and have different labels."""
        usual = np.bincount(label[np.concatenate([x, y])]).argmax()
        odd_x, odd_y = x[label[x] != usual], y[label[y] != usual]
        out = []
        for p, q in ((odd_x, y), (x[label[x] == usual], odd_y)):
            if not len(p) or not len(q):
                continue
            a, b = self.sketch[rows[p]].T.copy(), self.sketch[rows[q]].T.copy()
            same = np.zeros((len(p), len(q)), np.uint8)
            for k in range(COORDINATES):
                same += a[k][:, None] == b[k][None, :]
            n, m = self.n[rows[p]][:, None], self.n[rows[q]][None, :]
            fit = (same >= floor * COORDINATES) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * threshold) & (label[p][:, None] != label[q][None, :])
            if x[0] == y[0]:
                fit &= p[:, None] < q[None, :] if p is not odd_x else (p[:, None] < q[None, :]) | (label[q] == usual)[None, :]
            i, j = np.nonzero(fit)
            good = self._finely(rows[p[i]], rows[q[j]], threshold)
            out.append((p[i[good]], q[j[good]]))
        if not out:
            return x[:0], x[:0]
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def _compared(self, i: np.ndarray, j: np.ndarray, floor: float, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = (np.minimum(self.n[i], self.n[j]) * 100 >= np.maximum(self.n[i], self.n[j]) * threshold) & (self.cid[i] != self.cid[j])
        if self.component is not None:
            fit &= self.component[i] != self.component[j]
        i, j = i[fit], j[fit]
        same = np.concatenate([(self.sketch[i[a : a + 50_000]] == self.sketch[j[a : a + 50_000]]).sum(axis=1) for a in range(0, len(i), 50_000)] or [np.zeros(0, int)])
        good = same >= floor * COORDINATES
        i, j, same = i[good], j[good], same[good]
        good = self._finely(i, j, threshold)
        return i[good], j[good], same[good]

    def _finely(self, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
        """Which of the pairs are similar by the further coordinates too, where rows have them."""
        if self.fine is None:
            return np.ones(len(i), dtype=bool)
        least = floor_of(threshold, FINE) * FINE
        step = 20_000
        return np.concatenate([(self.fine[i[a : a + step]] == self.fine[j[a : a + step]]).sum(axis=1) >= least for a in range(0, len(i), step)] or [np.zeros(0, dtype=bool)])


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of places below `size` form a spanning forest, the first ones first."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for start in range(0, len(i), 100_000):
        part = slice(start, start + 100_000)
        for k, (a, b) in enumerate(zip(i[part].tolist(), j[part].tolist(), strict=True), start):
            a, b = find(a), find(b)
            if a != b:
                root[a] = b
                chosen.append(k)
    return np.array(chosen, dtype=np.int64)


def node_pairs(classes: DataFrame, threshold: int) -> DataFrame:
    """a, b (a < b): pairs of classes that look similar in some node.

    classes: cid, n_shingles, tokens, sketch, and possibly component and fine; without component a node gives a spanning forest of its
    similar pairs, with it all similar pairs whose components differ; fine: bytes of further coordinates.
    """
    floor = floor_of(threshold, COORDINATES)
    more = [c for c in ("component", "fine") if c in classes.columns]
    rows = classes.select("cid", "n_shingles", "sketch", *more, F.posexplode("tokens").alias("tree", "node")).withColumn("level", F.lit(0))
    dealt = _branched(rows).repartition("tree", "node").sortWithinPartitions("tree", "node")

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = Nodes(table)
        nodes.branch()
        i, j, same = nodes.similar(floor, threshold)
        if not more:
            order = np.argsort(-same, kind="stable")
            kept = order[forest(len(nodes.cid), i[order], j[order])]
            i, j = i[kept], j[kept]
            nodes.link(i, j)
        for i, j in chain([(i, j)], nodes.similar_in_large(floor, threshold)):
            a, b = np.minimum(nodes.cid[i], nodes.cid[j]), np.maximum(nodes.cid[i], nodes.cid[j])
            found = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < HELD:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            tree, node = table.column("tree").to_numpy(), table.column("node").to_numpy()
            changed = np.flatnonzero((tree[1:] != tree[:-1]) | (node[1:] != node[:-1]))
            if len(changed):  # the last node may go on in the next batch
                cut = int(changed[-1]) + 1
                yield from pairs(table.slice(0, cut))
                table = table.slice(cut)
            held, count = table.to_batches(), table.num_rows
        if count:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(compared, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= threshold * union."""

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column("first"), batch.column("second"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                common = int((y[place] == x).sum()) if len(y) else 0
                good[k] = 100 * common >= threshold * (len(x) + len(y) - common) and common > 0
            yield batch.select(["a", "b"]).filter(pa.array(good))

    first = sets.select(F.col("cid").alias("a"), F.col("set").alias("first"))
    second = sets.select(F.col("cid").alias("b"), F.col("set").alias("second"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "first", "second").mapInArrow(checked, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """cid, set: the full sets of the classes in members (cid, and the id and mark of its first document)."""

    def set_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            hashed, at = shingles(block.column("text"), size)
            rows = [hashed[at[i] : at[i + 1]].tobytes() for i in range(block.num_rows)]
            yield pa.RecordBatch.from_arrays([block.column("cid"), pa.array(rows, pa.binary())], ["cid", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text", F.xxhash64("text").alias("mark"))
    wanted = join_small(texts, members.select("first", "mark", "cid"), ["first", "mark"], spread=["mark"])
    return wanted.select("cid", "text").mapInArrow(set_of, "cid long, set binary").dropDuplicates(["cid"])


def _fine(sets: DataFrame) -> DataFrame:
    """cid, fine: a byte of each of the further coordinates of the sets."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
            for a in range(0, len(each), 500):
                part = each[a : a + 500]
                at = np.concatenate([[0], np.cumsum([len(x) for x in part])])
                least = minima(np.concatenate(part), at, range(COORDINATES, COORDINATES + FINE))
                rows = (tb.mixed(least) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(a, len(part)), pa.array([r.tobytes() for r in rows], pa.binary())], ["cid", "fine"])

    return sets.mapInArrow(made, "cid long, fine binary")


def _resolved(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and lead (whether the row's id and mark are the least of its component) of each row."""
    each = materialize(sketched(docs, size), "sketches")
    known = each.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sums = ["n_shingles", "low", "high"]
    grouped = known.groupBy(*sums).agg(F.min(F.struct("doc_id", "mark")).alias("_f"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    # numbered once and stored; classes whose first documents share an id stay apart
    classes = grouped.select(*sums, F.col("_f.doc_id").alias("first"), F.col("_f.mark").alias("mark"), "tokens", "sketch", F.monotonically_increasing_id().alias("cid"))
    classes = materialize(classes, "classes")
    plain = classes.select("cid", "n_shingles", "tokens", "sketch")
    pairs = materialize(node_pairs(plain, threshold), "pairs")
    members = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct(), "members")
    firsts = materialize(classes.drop("tokens", "sketch").join(members, "cid", "left_semi"), "firsts")
    sets = materialize(_sets(docs, firsts, size), "sets")
    links = materialize(_confirmed(pairs, sets, threshold), "links")
    found = materialize(connected(links, "a", "b"), "components")
    apart = plain.join(members, "cid", "left_semi").join(found.withColumnRenamed("id", "cid"), "cid", "left")
    apart = apart.withColumn("component", F.coalesce("component", "cid")).join(_fine(sets), "cid")
    rest = materialize(node_pairs(apart, threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_confirmed(rest, sets, threshold), "links")
    if not more.isEmpty():
        found = materialize(connected(links.union(more), "a", "b"), "components")
    # a component is named by its first document
    joined = found.withColumnRenamed("id", "cid").join(firsts.select("cid", "first", "mark"), "cid")
    named = joined.groupBy("component").agg(F.min(F.struct(F.col("first").alias("id"), F.col("mark").alias("mark"))).alias("least"))
    least = materialize(joined.select("cid", "component").join(named, "component").select("cid", "least"), "least")
    own = F.struct(F.col("first").alias("id"), F.col("mark").alias("mark"))
    linked = classes.select(*[F.col(c).alias(f"_{c}") for c in sums], "cid", own.alias("_own")).join(least, "cid", "left")
    linked = linked.select(*[f"_{c}" for c in sums], F.coalesce("least", "_own").alias("_least"))
    rows = each.join(linked, [F.col(c) == F.col(f"_{c}") for c in sums], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least.id", "doc_id"))
    lead = (F.col("doc_id") == F.col("_least.id")) & (F.col("mark") == F.col("_least.mark"))
    return rows.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(lead, F.lit(True)).alias("lead"))


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), kept (doc_id = component_id) of each row.

    size: words in a shingle; threshold: hundredths of the Jaccard similarity from which documents are linked.
    """
    found = _resolved(id_and_text(docs, id_col, text_col), size, threshold)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, *, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id, with all its columns.

    Rows are told apart by id and a hash of the text. Of repeated rows (equal id and text) with shingles one stays; rows without
    shingles and rows with a null id all stay.
    """
    found = materialize(_resolved(id_and_text(docs, id_col, text_col), size, threshold), "resolved")
    marked = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    counts = marked.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("lead").alias("_lead")).where("NOT _lead OR _n > 1")
    id_, mark, state = unused(docs, "id", "mark", "lead")
    keys = counts.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("_lead").alias(state))
    named = docs.withColumn(id_, F.col(id_col).cast("long")).withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    joined = join_small(named, keys, [id_, mark], "left", spread=[mark])
    single = joined.where(F.col(state).isNull()).select(*docs.columns)
    repeated = joined.where(F.col(state)).dropDuplicates([id_, mark]).select(*docs.columns)
    return single.unionByName(repeated)
