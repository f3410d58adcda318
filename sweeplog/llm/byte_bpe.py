"""Byte-level BPE by relational steps: DuckDB recursive queries over token positions, run in each task.

A task splits the distinct segments of its block by the vocabulary's pattern and encodes the distinct pieces together. The rows
(piece, position, token) start as the ids of single bytes; a recursive query joins neighbouring positions with the merge table,
takes each piece's pair of least rank (the leftmost of equals), contracts it, and ends when no piece has a pair left. Decoding
joins ids with the vocabulary and aggregates the bytes in the order of their positions.

A recursion over a piece of n bytes handles up to n^2 / 2 rows, so pieces over `LONG_PIECE` bytes, such as very long runs of one
class of characters, are contracted with a queue of pairs instead, by the same rule.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import id_and_text

LONG_PIECE = 96
# Token positions that one recursive query starts with, and the memory its database may use before it spills to the task's folder.
POSITIONS = 400_000
MEMORY = "256MB"

# A row's place is piece * 128 + position, so neighbours are one apart; positions stay dense.
_ENCODE = """
WITH RECURSIVE steps(step, place, token) AS (
    SELECT 0, place, token FROM positions
  UNION ALL
    SELECT step + 1, CASE WHEN place > least_place THEN place - 1 ELSE place END, CASE WHEN place = least_place THEN merged ELSE token END
    FROM (
        SELECT s.step, s.place, s.token, b.best & 127 | (s.place & ~127) AS least_place, b.best >> 7 AS merged
        FROM steps s JOIN (
            SELECT l.place >> 7 AS piece, min(m.merged << 7 | (l.place & 127)) AS best
            FROM steps l JOIN steps r ON r.place = l.place + 1 JOIN merges m ON m.pair = (l.token::BIGINT << 20 | r.token)
            WHERE (r.place & 127) > 0
            GROUP BY piece
        ) b ON b.piece = s.place >> 7
    )
    WHERE place <> least_place + 1
)
SELECT place >> 7 AS piece, place & 127 AS position, token
FROM (SELECT *, max(step) OVER (PARTITION BY place >> 7) AS final FROM steps) WHERE step = final ORDER BY place
"""

_DECODE = """
SELECT piece, unhex(string_agg(hex, '' ORDER BY position)) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


# Opened vocabularies by file and pattern, for all tasks of a process.
_OPEN: dict[tuple[str, str], RelationalBpe] = {}


class RelationalBpe:
    """The vocabulary and its merge table in a database of the task's own process."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._con = path, pattern, None
        self.known = tb.Remembered()

    @staticmethod
    def opened(path: str, pattern: str) -> RelationalBpe:
        return _OPEN.setdefault((path, pattern), RelationalBpe(path, pattern))

    @property
    def con(self) -> duckdb.DuckDBPyConnection:
        if self._con is None:
            self.ranks = read_ranks(self.path)
            self.bytes_of = {rank: token for token, rank in self.ranks.items()}
            self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
            pairs = [(left << 20 | right, rank) for token, rank in self.ranks.items() for left, right in self._splits(token)]
            self._con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
            self._create("merges", pair=np.array([p for p, _ in pairs], np.int64), merged=np.array([m for _, m in pairs], np.int64))
            table = pa.table({"token": pa.array(list(self.bytes_of), pa.int64()), "hex": pa.array([t.hex() for t in self.bytes_of.values()])})
            self._con.register("given", table)
            self._con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
            self.split = regex.compile(self.pattern)
        return self._con

    def _splits(self, token: bytes) -> Iterator[tuple[int, int]]:
        for k in range(1, len(token)):
            left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if left is not None and right is not None:
                yield left, right

    def _create(self, name: str, **columns: np.ndarray) -> None:
        self._con.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self._con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self._con.unregister("given")

    def piece_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece one after the other, and where each piece's begin (n + 1 values)."""
        con = self.con
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        short = np.flatnonzero(sizes <= LONG_PIECE)
        short = short[np.argsort(sizes[short], kind="stable")]  # pieces of a query take about as many steps
        total = np.concatenate([[0], np.cumsum(sizes[short])])
        first = 0
        while first < len(short):
            last = max(first + 1, int(np.searchsorted(total, total[first] + POSITIONS, side="right")) - 1)
            chosen = short[first:last]
            data = np.frombuffer(b"".join([pieces[i] for i in chosen.tolist()]), np.uint8)
            number = np.repeat(np.arange(len(chosen)), sizes[chosen])
            position = np.arange(len(data)) - np.repeat(total[first:last] - total[first], sizes[chosen])
            self._create("positions", place=number << 7 | position, token=self.single[data])
            got = con.execute(_ENCODE).fetchnumpy()
            parts.append((chosen[got["piece"]], got["position"], got["token"]))
            first = last
        for i in np.flatnonzero(sizes > LONG_PIECE).tolist():
            ids = self._contracted(pieces[i])
            parts.append((np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int64)))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(pieces) + 1, np.int64)
        piece, position, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.bincount(piece, minlength=len(pieces))
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(len(token), np.int64)
        flat[at[piece] + position] = token
        return flat, at

    def _contracted(self, piece: bytes) -> list[int]:
        """The same contraction with a queue of (rank, place): a pair that is gone when its turn comes is passed over."""
        n = len(piece)
        token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(token[i] + token[j])) is not None:
                heapq.heappush(queue, (rank, i, token[i], token[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[t] for t in token if t is not None]

    def decoded(self, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        con = self.con
        out: list[bytes] = [b""] * (len(at) - 1)
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + POSITIONS, side="right")) - 1)
            sizes = np.diff(at[first : last + 1])
            index = np.arange(at[first], at[last])
            self._create("ids", piece=np.repeat(np.arange(first, last), sizes), position=index, token=flat[index])
            for piece, content in con.execute(_DECODE).fetchall():
                out[piece] = content
            first = last
        return out

    def segment_ids(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment one after the other, and where each segment's begin (n + 1 values)."""
        self.con  # noqa: B018  opens the database
        return self.known.runs(vocabulary, self._encoded)

    def _encoded(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments from those of their distinct pieces."""
        number: dict[str, int] = {}
        codes: list[int] = []
        sizes: list[int] = []
        find = self.split.findall
        for text in vocabulary.cast(pa.large_string()).to_pylist():
            pieces = find(text)
            sizes.append(len(pieces))
            codes += [number.setdefault(p, len(number)) for p in pieces]
        flat, at = self.piece_ids([p.encode() for p in number])
        to = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        ids, ends = tb.gathered(flat, at, np.array(codes, np.int64))
        return ids, ends[to]


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each row."""
    rows = id_and_text(docs, id_col, text_col)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RelationalBpe.opened(ranks, pattern)
        for block in tb.blocks(batches, "text"):
            cut = tb.segments(*tb.text_bytes(block.column("text")))
            flat, at = bpe.segment_ids(cut.vocabulary)
            ids, to = tb.gathered(flat, at, cut.codes)
            lists = pa.ListArray.from_arrays(pa.array(to[cut.offsets], pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists], ["doc_id", "ids"])

    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes of each row; null ids are none. An id that the vocabulary lacks gives no bytes."""
    rows = encoded.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{ids_col}`, array()) AS ids")

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RelationalBpe.opened(ranks, pattern)
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bpe.decoded(flat, at), pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(decoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again, and both hashed in the task.

    The ids of a segment are decoded once for all its places in a block; a text's bytes are those of its segments in order.
    """
    rows = id_and_text(docs, id_col, text_col)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RelationalBpe.opened(ranks, pattern)
        for block in tb.blocks(batches, "text"):
            cut = tb.segments(*tb.text_bytes(block.column("text")))
            flat, at = bpe.segment_ids(cut.vocabulary)
            content = bpe.decoded(flat, at)
            names = list(map(str, flat.tolist()))
            written = [",".join(names[a:b]).encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            of_ids, of_bytes = [], []
            for a, b in zip(cut.offsets[:-1].tolist(), cut.offsets[1:].tolist(), strict=True):
                codes = cut.codes[a:b].tolist()
                of_ids.append(hashlib.sha256(b",".join([written[c] for c in codes])).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join([content[c] for c in codes])).hexdigest())
            counts = tb.weighted_sums(cut, np.diff(at))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(digests, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
