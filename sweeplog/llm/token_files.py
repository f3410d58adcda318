"""Token files: independent zstandard frames with a seek table, so that a reader decompresses only the frames it needs.

A file holds documents in ascending id order:

    frame, frame, ...            zstandard frames; content: number of documents (u32), token width in bytes (u32), then for each
                                 document whether it has an id (u8), its id (i64) and its number of tokens (u32), column by
                                 column, then all tokens (u16 or u32); little-endian
    index (a skippable frame)    for each frame: documents (u32), tokens (u64), first and last id (i64; the lowest i64 for none)
    seek table                   the skippable frame of the zstandard seekable format: compressed size, content size and checksum
                                 (low 32 bits of xxh64 of the content) of each frame and of the index, then the footer

Any zstandard decoder reads the frames. Tasks write files under a name of their own and report it in the written manifest, so only
files of tasks that finished are ever read, whatever was tried before.

Defined results: a null text is empty, a document has at least its end id; documents without an id come first; rows that share an id
stay next to each other, ordered by a hash of the text; an empty table gives no files and no rows. Ids must be integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.llm.frames import id_and_text
from sweeplog.llm.subwords import SubwordEncoder
from sweeplog.session import materialize, staging_path

FRAME_BYTES = 256 * 1024
SKIPPABLE_INDEX = 0x184D2A50
# Fixed values of the seekable format: the magic of its skippable frame, of its footer, and the flag for checksums.
SKIPPABLE_TABLE = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NO_ID = -(1 << 63)

MANIFEST = "part int, path string, documents long, tokens long, bytes long, first_id long, last_id long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents in the order given; a frame is closed when its tokens reach `frame_bytes`."""

    def __init__(self, path: str, *, width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = 1):
        files, inner = _open(path)
        files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = files.open_output_stream(inner)
        self.path, self.width, self.frame_bytes = path, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.held = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens) * self.width
        if self.held >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.ids:
            return
        n = len(self.ids)
        flat = np.concatenate(self.tokens)
        content = b"".join((
            struct.pack("<II", n, self.width), np.array([x is not None for x in self.ids], np.uint8).tobytes(),
            np.array([0 if x is None else x for x in self.ids], "<i8").tobytes(), np.array([len(t) for t in self.tokens], "<u4").tobytes(),
            flat.astype(f"<u{self.width}").tobytes(),
        ))
        self._put(self.packer.compress(content), content)
        known = [x for x in self.ids if x is not None]
        self.index.append((n, len(flat), known[0] if len(known) == n else NO_ID, known[-1] if known else NO_ID))
        self.ids, self.tokens, self.held = [], [], 0

    def _put(self, packed: bytes, content: bytes) -> None:
        self.out.write(packed)
        self.bytes += len(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> dict:
        self._close_frame()
        body = b"".join(struct.pack("<IQqq", *row) for row in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.table.append((8 + len(body), 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        tail = rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(tail)) + tail)
        self.out.close()
        self.bytes += 8 + len(body) + 8 + len(tail)
        known = [x for row in self.index for x in row[2:] if x != NO_ID]
        return {
            "path": self.path, "documents": sum(r[0] for r in self.index), "tokens": sum(r[1] for r in self.index), "bytes": self.bytes,
            "first_id": min(known, default=None), "last_id": max(known, default=None),
        }


class FrameReader:
    """Reads the seek table and index of a file, then single frames, each checked against its checksum."""

    def __init__(self, path: str):
        files, inner = _open(path)
        self.path = path
        self.file = files.open_input_file(inner)
        self.frames_read = 0
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.table = rows[:-1]
        self.starts = np.concatenate([[0], np.cumsum(rows[:, 0])])
        body = self._at(int(self.starts[-2]) + 8, int(rows[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != rows[-1, 2]:
            raise ValueError(f"{path}: the index is damaged")
        self.index = list(struct.iter_unpack("<IQqq", body))
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Ids of the documents, all their tokens, and the n + 1 offsets."""
        packed, size, checksum = (int(x) for x in self.table[k])
        content = self.unpacker.decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        self.frames_read += 1
        n, width = struct.unpack_from("<II", content)
        known = np.frombuffer(content, np.uint8, n, 8)
        ids = np.frombuffer(content, "<i8", n, 8 + n)
        sizes = np.frombuffer(content, "<u4", n, 8 + 9 * n)
        tokens = np.frombuffer(content, f"<u{width}", int(sizes.sum()), 8 + 13 * n).astype("<u4")
        return [int(i) if k else None for i, k in zip(ids, known, strict=True)], tokens, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, tokens) of all documents, or of the wanted ones; frames that hold none of these are not read."""
        ordered = np.array(sorted(wanted), dtype=np.int64) if wanted is not None else None
        for k, (_, _, first, last) in enumerate(self.index):
            if ordered is not None and (last == NO_ID or np.searchsorted(ordered, first) == np.searchsorted(ordered, last, side="right")):
                continue
            ids, tokens, at = self.frame(k)
            for i, doc_id in enumerate(ids):
                if wanted is None or doc_id in wanted:
                    yield doc_id, tokens[at[i] : at[i + 1]]

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> DataFrame:
    """Encode all documents into token files, one per range of ids; returns the stored manifest, a row per file.

    Documents are dealt by ranges of (id, hash of the text), so rows that share an id spread too. folder: where all executors can
    write; by default a new one in the shared folder. files: how many ranges; by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    folder = folder or staging_path(spark, "tokens")
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("_tie")
    encoder = SubwordEncoder(tokenizer, end_id)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = None
        for block in tb.blocks(batches, "text"):
            ids = block.column("doc_id").to_pylist()
            for first, tokens, at in encoder.texts(block.column("text")):
                if out is None:
                    width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                    out = FrameWriter(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok", width=width)
                for i in range(len(at) - 1):
                    out.add(ids[first + i], tokens[at[i] : at[i + 1]])
        if out is not None:
            made = out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, **made}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), *((k, pa.int64()) for k in ("documents", "tokens", "bytes", "first_id", "last_id"))]),
            )

    return materialize(ranged.mapInArrow(written, MANIFEST), "manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One task per file."""
    return manifest.repartition(max(1, manifest.count()), "part")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, tokens of all documents, or of the wanted ids; files and frames without any of these are not read."""
    ids = set(wanted) if wanted is not None else None
    if ids is not None:
        manifest = manifest.where(F.lit(False) if not ids else (F.col("last_id") >= min(ids)) & (F.col("first_id") <= max(ids)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            reader = FrameReader(path)
            for doc_id, tokens in reader.documents(ids):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([tokens.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "tokens"])
            reader.close()

    return _spread(manifest.select("part", "path")).mapInArrow(read, "doc_id long, tokens array<int>")


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files. start: tokens of all documents before it.

    Files are in id order, so a file's first start is the sum over the files before it: a running sum over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("begin"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                reader = FrameReader(path)
                for k in range(len(reader.index)):
                    ids, tokens, at = reader.frame(k)
                    raw = memoryview(tokens.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(begin + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    begin += int(at[-1])
                reader.close()

    return _spread(begun).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)
