"""Phrase collocations by relational mining (SETM): occurrence relations that grow by one word a level.

A text is lower-cased (A-Z) and cut at `. , ; : ! ?` and line breaks into pieces, a piece at blanks and tabs into words. The occurrence
relation of length k has a row for each place where a frequent phrase of k words stands: (place, phrase), sorted by place. Places
number the words of a chunk of texts and skip one between pieces, so a row's neighbour in the same piece is the row at place + 1.

A level does what SETM does:
- merge-join: the relation is joined with itself at the next place, which gives phrases of k + 1 words whose first k and last k
  words are frequent;
- group-count: each chunk counts its own phrases first; the counts are dealt by a hash of the phrase and summed over all chunks;
- semi-join: phrases below the limit go, frequent ones get a number, which goes back to the chunks that hold the phrase; the rows
  that are left are written as the next relation.

Relations are tables in the shared folder with a row for each chunk (8 MB of texts, or one longer text), whose columns are
compressed arrays. A chunk sends a phrase once however often it holds it, so a phrase that stands everywhere is a number from each
chunk, and no task gets more than a share of the phrases: buckets of the hash grow in number with the words of the corpus. A phrase is
named by the numbers of its first and its last k words, so nothing rests on hashes being different.

Counts and scores then need only the tables of frequent phrases: every part of a candidate is frequent itself.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows count as often as they stand; rows' ids
play no part; equal scores are ordered by count, then by phrase; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.llm import textblocks as tb
from sweeplog.session import materialize

LEAST = 30
LONGEST = 4
TOP = 2000
# A candidate goes where a longer one has this many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
# Words of the corpus for each bucket; a chunk's phrases are fewer than its words.
BUCKET_WORDS = 500_000
UNKNOWN = "und"

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False

_RELATION = "chunk long, place binary, code binary, ids binary"
_DEALT = "bucket int, chunk long, words array<binary>, a binary, b binary, n binary"
_COUNTED = "chunk long, bucket int, ids binary, id long, word binary, a long, b long, n long"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int64).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def occurrences(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The relation of single words, a row for each chunk: places, codes, the word of each code as language, line break and word,
    and the number of words of each language."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(tb.blocks(batches, "text")):
            data, offsets = tb.text_bytes(block.column("text"))
            words = tb.words(tb.lowered(data), offsets, _WORD)
            text = words.texts_of_words()
            ends = np.cumsum(_ENDS[data], dtype=np.int64)[words.starts] if len(words.starts) else np.zeros(0, np.int64)
            new = np.ones(len(text), dtype=np.int64)  # 2 at the first word of a piece
            new[1:] += (text[1:] != text[:-1]) | (ends[1:] != ends[:-1])
            langs = block.column("lang").dictionary_encode()
            size = max(len(words.vocabulary), 1)
            of_word = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
            both, code = np.unique(of_word * size + words.codes, return_inverse=True)
            names, spelled = [x.encode() for x in langs.dictionary.to_pylist()], words.vocabulary.to_pylist()
            listed = [names[i] + b"\n" + spelled[j] for i, j in zip((both // size).tolist(), (both % size).tolist(), strict=True)]
            counts = np.bincount(of_word, minlength=len(names))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([part << 32 | k], pa.int64()), "place": pa.array([_pack_sorted(np.cumsum(new))], pa.binary()),
                    "code": pa.array([_pack(code)], pa.binary()), "words": pa.array([listed], pa.list_(pa.binary())),
                    "langs": pa.array([langs.dictionary.to_pylist()], pa.list_(pa.string())), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
                }
            )

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(made, "chunk long, place binary, code binary, words array<binary>, langs array<string>, counts array<long>")


class Found:
    """The phrases of a chunk at a level: where each stands, and what is dealt of them."""

    def __init__(self, row: dict, buckets: int):
        place, code = _unpack_sorted(row["place"]), _unpack(row["code"])
        if "words" in row:
            self.words = row["words"]
            self.place, self.code = place, code
            self.n = np.bincount(code, minlength=len(self.words))
            bucket = tb.hashes(pa.array(self.words, pa.binary()))
        else:
            self.words = None
            ids = _unpack(row["ids"])
            at = np.flatnonzero(place[1:] == place[:-1] + 1)  # the merge-join with the rows at the next place
            both, self.code, self.n = np.unique(code[at] * max(len(ids), 1) + code[at + 1], return_inverse=True, return_counts=True)
            self.place = place[at]
            self.a, self.b = ids[both // max(len(ids), 1)], ids[both % max(len(ids), 1)]
            bucket = tb.mixed(tb.mixed(self.a) + self.b.astype(np.uint64))
        bucket = (bucket % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, starts = np.unique(bucket[self.order], return_index=True)
        self.parts = np.split(self.order, starts[1:]) if len(starts) else []

    def dealt(self, chunk: int) -> Iterator[dict]:
        for bucket, part in zip(self.buckets.tolist(), self.parts, strict=True):
            row = {"bucket": bucket, "chunk": chunk, "words": None, "a": None, "b": None, "n": _pack(self.n[part])}
            if self.words is not None:
                row["words"] = [self.words[i] for i in part.tolist()]
            else:
                row["a"], row["b"] = _pack(self.a[part]), _pack(self.b[part])
            yield row

    def kept(self, back: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, codes and numbers of the rows whose phrase came back with a number."""
        ids = np.empty(len(self.order), np.int64)
        if back:
            ids[self.order] = np.concatenate([_unpack(x) for x in back])
        good = ids >= 0
        rows = good[self.code]
        return self.place[rows], (np.cumsum(good) - 1)[self.code[rows]], ids[good]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The chunks one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _deal(relation: DataFrame, buckets: int) -> DataFrame:
    columns = [c for c in ("chunk", "place", "code", "words", "ids") if c in relation.columns]

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.list_(pa.binary())), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())]
        )
        for row in _rows(batches):
            found = list(Found(row, buckets).dealt(row["chunk"]))
            for at in range(0, len(found), 256):
                yield pa.RecordBatch.from_pylist(found[at : at + 256], schema)

    return relation.select(*columns).mapInArrow(dealt, _DEALT)


def _count(dealt: DataFrame, buckets: int, least: int) -> DataFrame:
    """For each bucket the frequent phrases with their numbers, and for each chunk the numbers of its phrases, -1 for rare ones."""

    def summed(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        n = [_unpack(x) for x in table.column("n").to_pylist()]
        sizes, n = [len(x) for x in n], np.concatenate(n)
        one = table.column("words").null_count == 0
        if one:
            coded = pc.list_flatten(table.column("words")).combine_chunks().dictionary_encode()
            group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())[group]  # numbered in the words' order
            keys = coded.dictionary.take(pc.sort_indices(coded.dictionary))
        else:
            a = np.concatenate([_unpack(x) for x in table.column("a").to_pylist()])
            b = np.concatenate([_unpack(x) for x in table.column("b").to_pylist()])
            order = np.lexsort((b, a))
            new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
            group = np.empty(len(a), np.int64)
            group[order] = np.cumsum(new) - 1
            keys = order[new]
        by_group = np.argsort(group, kind="stable")
        total = np.add.reduceat(n[by_group], np.searchsorted(group[by_group], np.arange(len(keys))))
        good = np.flatnonzero(total >= least)
        ids = np.full(len(keys), -1, np.int64)
        ids[good] = np.arange(len(good)) * buckets + bucket
        back = [_pack(x) for x in np.split(ids[group], np.cumsum(sizes)[:-1])]
        none = pa.nulls(len(good))
        frequent = {
            "chunk": none.cast(pa.int64()), "bucket": pa.array(np.full(len(good), bucket), pa.int32()), "ids": none.cast(pa.binary()), "id": pa.array(ids[good]),
            "word": (keys.take(pa.array(good)) if one else none).cast(pa.binary()), "a": none.cast(pa.int64()) if one else pa.array(a[keys[good]]),
            "b": none.cast(pa.int64()) if one else pa.array(b[keys[good]]), "n": pa.array(total[good]),
        }
        rows = pa.table(frequent)
        none = pa.nulls(len(back))
        returned = {"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": pa.array(back, pa.binary())}
        returned |= {f.name: none.cast(f.type) for f in rows.schema if f.name not in returned}
        return pa.concat_tables([rows, pa.table(returned).select(rows.column_names).cast(rows.schema)])

    return dealt.groupBy("bucket").applyInArrow(summed, _COUNTED)


def _extend(relation: DataFrame, counted: DataFrame, buckets: int) -> DataFrame:
    """The relation of the frequent phrases among those that the relation's rows gave."""
    columns = [c for c in ("chunk", "place", "code", "words", "ids") if c in relation.columns]
    listed = F.array_sort(F.collect_list(F.struct("bucket", "ids")))
    back = counted.where("chunk IS NOT NULL").groupBy("chunk").agg(F.transform(listed, lambda r: r["ids"]).alias("back"))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            place, code, ids = Found(row, buckets).kept(row.pop("back"))
            if len(place):
                values = [row["chunk"]], [_pack_sorted(place)], [_pack(code)], [_pack(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["chunk", "place", "code", "ids"])

    return relation.select(*columns).join(back, "chunk").mapInArrow(kept, _RELATION)


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, and lang, n: all words of each language.

    The first table has id, lang, phrase, a (how often it stands); the others also first and last, the numbers of the phrases
    without their last and without their first word, and the counts and texts that `candidates` reads.
    """
    relation = materialize(occurrences(docs, lang_col=lang_col, text_col=text_col), "words")
    each = F.explode(F.arrays_zip("langs", "counts")).alias("e")
    totals = materialize(relation.select(each).groupBy(F.col("e.langs").alias("lang")).agg(F.sum("e.counts").alias("n")).where("n > 0"), "totals")
    words = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = int(words // BUCKET_WORDS) + 1
    levels = []
    for k in range(1, longest + 1):
        counted = materialize(_count(_deal(relation, buckets), buckets, least), "counted")
        found = counted.where("chunk IS NULL")
        levels.append(materialize(_spelled(found) if k == 1 else _joined(found, levels[-1], k), "phrases"))
        if k < longest:
            relation = materialize(_extend(relation, counted, buckets), "occurrences")
    return levels, totals


def _spelled(found: DataFrame) -> DataFrame:
    spelled = F.col("word").cast("string")
    lang = F.regexp_replace(spelled, "(?s)\n[^\n]*$", "")
    word = F.substring_index(spelled, "\n", -1)
    return found.select("id", lang.alias("lang"), word.alias("phrase"), F.col("n").alias("a"), word.alias("end"), F.array(F.col("n")).alias("left"), F.array(F.col("n")).alias("right"))


def _joined(found: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """left[j] and right[j]: the counts of the phrase's first and of its last j words, its own last."""
    first = shorter.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("_begin"), F.col("left").alias("_left"))
    last = shorter.select(F.col("id").alias("last"), F.col("end").alias("end"), F.col("right").alias("_right"))
    rows = found.select("id", F.col("a").alias("first"), F.col("b").alias("last"), F.col("n").alias("a")).join(first, "first").join(last, "last")
    return rows.select(
        "id", "lang", F.concat_ws(" ", "_begin", "end").alias("phrase"), "a", "end", F.concat("_left", F.array("a")).alias("left"),
        F.concat("_right", F.array("a")).alias("right"), "first", "last",
    )


def _lowest_cut(k: int) -> Column:
    """score, k, l, r of the cut with the lowest score, the first of equal ones; in decimals, as products may pass 64 bits."""
    cuts = []
    for j in range(1, k):
        left, right = F.get("left", F.lit(j - 1)), F.get("right", F.lit(k - j - 1))
        whole = F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)")
        both = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
        cuts.append(F.struct(F.call_function("div", whole, both).alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def candidates(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words or more that no longer one covers.

    A longer phrase with enough occurrences that holds a phrase has one of just one word more in it that has as many, so that
    one word more is looked at only.
    """
    out = None
    for k in range(2, len(levels) + 1):
        rows = levels[k - 1].withColumn("_cut", _lowest_cut(k))
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("first", "last")).alias("id"), F.col("a").alias("_longer")).groupBy("id").agg(F.max("_longer").alias("_longer"))
            share = F.col("a").cast("decimal(20,0)") * F.lit(COVERED).cast("decimal(3,0)")
            rows = rows.join(longer, "id", "left").where(F.col("_longer").isNull() | (F.col("_longer").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") < share))
        rows = rows.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, *, top: int = TOP, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` collocations.

    a: occurrences; l, r: those of the two sides of the cut that binds least; n: words of the language; score: floor(2,000,000 a / (l + r)).
    """
    levels, totals = frequent_phrases(docs, least=least, longest=longest, lang_col=lang_col, text_col=text_col)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = candidates(levels).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
