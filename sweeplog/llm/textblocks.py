"""Words, lines and segments of many texts at once, as numpy arrays over the bytes of an Arrow block.

A block is a bounded number of text bytes (`BLOCK_BYTES`, or one text where that is longer), so a task's memory does not
depend on the size of its partition. Within a block equal words are kept once (`Words.vocabulary`) and the texts are arrays of
word codes; work per distinct word is then done once for all its places.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

# Text bytes that a task holds at a time.
BLOCK_BYTES = 8 * 1024 * 1024

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words between white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = ~_SPACES
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True
_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True
_SIGNS = _GRAPHIC & ~ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about `limit` bytes of the text column. A text is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in _pieces(batch, text, limit):
            if held and size + _text_bytes(part, text) > limit:
                yield _joined(held)
                held, size = [], 0
                _give_back()
            held.append(part)
            size += _text_bytes(part, text)
    if held:
        yield _joined(held)
        held.clear()
        _give_back()


def _give_back() -> None:
    """Free memory goes back to the machine, as a task's process lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def _text_bytes(batch: pa.RecordBatch, text: str) -> int:
    if not batch.num_rows:
        return 0
    _, offsets = text_bytes(batch.column(text))
    return int(offsets[-1] - offsets[0])


def _pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or _text_bytes(batch, text) <= limit:
        yield batch
        return
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 offsets of its values; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where a text ends."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(mask))]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    begins[cut] = mask[cut]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    ends[cut - 1] = mask[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


@dataclass
class Words:
    """codes: a code for each word, texts one after the other; offsets: where each text's words start, n + 1 values;
    vocabulary: the byte string of each code; starts: the byte place of each word."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hashes(self.vocabulary, seed)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    """Runs of the bytes of `kind`, with equal ones coded alike within the block."""
    mask = kind[data]
    starts, ends = spans(mask, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = binary_array(data[mask], at).dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(starts, offsets), coded.dictionary, starts
    )


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string, the same in every task."""
    make = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([make(v, seed) for v in values.to_pylist()]), dtype=">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values well spread (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: Words, size: int, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the `size` words that start at each word, and whether they lie in one text. each: a hash of each distinct word."""
    n = len(words.codes)
    out = np.zeros(n, np.uint64)
    if not n:
        return out, np.zeros(0, bool)
    each = each[words.codes]
    with np.errstate(over="ignore"):
        for k in range(min(size, n)):
            part = each[k:] if k else each
            out[: n - k] = out[: n - k] * np.uint64(0x9E3779B97F4A7C15) + part
    left = np.repeat(words.offsets[1:], words.counts) - np.arange(n)
    return mixed(out), left >= size


def repeated(words: Words, size: int) -> np.ndarray:
    """Whether each word lies in a window of `size` words that its text holds twice or more."""
    n = len(words.codes)
    hashed, whole = window_hashes(words, size, mixed(np.arange(len(words.vocabulary)) + 1))
    place = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        key = hashed[place] + mixed(words.texts_of_words()[place] + 1)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, dtype=bool)
    found = place[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    change = np.zeros(n + size + 1, dtype=np.int32)
    change[found] += 1
    change[found + size] -= 1
    return np.cumsum(change)[:n] > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    out = np.zeros(len(offsets) - 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        flat = values.view(np.uint8) if values.dtype == bool else values
        out[full] = np.add.reduceat(flat, offsets[full], dtype=out.dtype)
    return out


def weighted_sums(words: Words, each: np.ndarray) -> np.ndarray:
    """For each text the sum of a number that each distinct word has."""
    return sums(each[words.codes], words.offsets)


def segments(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Texts cut where no match of the vocabularies' split patterns reaches across, so that a text's ids are those of its segments.

    The patterns' matches hold white space only before other characters, and never letters before signs. Cuts lie
    - before ASCII white space that follows another character,
    - between an ASCII letter and an ASCII sign,
    - after a line break that stands alone, before an ASCII character that is not white space.
    What precedes a cut must surely be no white space: after characters of three bytes that begin with E1, E2 or E3, among which
    the wide spaces lie, texts are not cut.
    """
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 1:
        place = np.flatnonzero(_SPACES[data[1:]]) + 1
        before = data[place - 1]
        plain = ~_SPACES[before] & ~((before >= 0x1C) & (before <= 0x1F))
        high = before >= 0x80
        second = np.where(place >= 2, data[place - 2], 0)
        third = np.where(place >= 3, data[place - 3], 0)
        plain &= ~(high & (((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3))))
        place = place[plain]
        cut[place] = True
        alone = place[(data[place] == 0x0A) & (place + 1 < n)] + 1
        cut[alone[_GRAPHIC[data[alone]]]] = True
        cut[1:] |= _LETTERS[data[:-1]] & _SIGNS[data[1:]]
    cut[offsets[offsets < n]] = True
    return _coded(data, offsets, np.flatnonzero(cut))


def between_space_and_sign(values: pa.Array) -> np.ndarray:
    """Whether each byte string begins with a space and ends with an ASCII character that is not white space."""
    data, at = text_bytes(values)
    out = np.diff(at) > 1
    rows = np.flatnonzero(out)
    out[rows] = (data[at[rows]] == 0x20) & _GRAPHIC[data[at[rows + 1] - 1]]
    return out


def bare_segments(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Segments for vocabularies that drop white space and case: words in lower case, cut between an ASCII letter and an ASCII sign."""
    data = lowered(data)
    mask = NOT_SPACE[data]
    starts, ends = spans(mask, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    bare = data[mask]
    cut = np.zeros(len(bare), dtype=bool)
    cut[1:] = _LETTERS[bare[:-1]] & _SIGNS[bare[1:]]
    cut[at[:-1]] = True
    return _coded(bare, at[np.searchsorted(starts, offsets)], np.flatnonzero(cut))


def _coded(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> Words:
    coded = binary_array(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64)).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(starts, offsets), coded.dictionary, starts)


def gathered(values: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[at[c]:at[c + 1]] of the given codes one after the other, and where each starts (n + 1)."""
    sizes = np.diff(at)[codes]
    to = np.concatenate([[0], np.cumsum(sizes)])
    if not len(codes):
        return values[:0], to
    index = np.arange(to[-1]) + np.repeat(at[codes] - to[:-1], sizes)
    return values[index], to


class Remembered:
    """What a function made of byte strings: runs of numbers, kept for the strings used last, `limit` strings and `numbers` numbers at
    most, beside those of one block.

    Strings are told apart by 128 bits of their hash. A task's process is used again by later tasks, so common words are worked
    on once per process; nothing depends on what is remembered but time.
    """

    def __init__(self, limit: int = 1 << 20, numbers: int = 1 << 23):
        self.limit, self.numbers, self.turn = limit, numbers, 0
        # by the first half of the hash: its second half, when it was used last, and where its run lies in `flat`
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.used, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def runs(self, values: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """make(values) for all values (runs one after the other, and n + 1 offsets), called for those not known."""
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(v) for v in values.to_pylist()]), ">u8").astype(np.uint64).reshape(-1, 2)
        high, low = both[:, 0], both[:, 1]
        place = np.minimum(np.searchsorted(self.high, high), max(len(self.high) - 1, 0))
        known = (self.high[place] == high) & (self.low[place] == low) if len(self.high) else np.zeros(len(high), dtype=bool)
        self.turn += 1
        self.used[place[known]] = self.turn
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(high[new])]
            flat, at = make(values.take(pa.array(new)))
            order = np.argsort(np.concatenate([self.high, high[new]]), kind="stable")  # two sorted runs are merged
            more = (
                ("high", high[new]), ("low", low[new]), ("used", np.full(len(new), self.turn, np.int32)),
                ("size", np.diff(at).astype(np.int32)), ("start", at[:-1] + len(self.flat)),
            )
            for name, column in more:
                setattr(self, name, np.concatenate([getattr(self, name), column])[order])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            place = np.searchsorted(self.high, high)
            while (other := self.low[place] != low).any():  # equal first halves are next to each other
                place[other] += 1
        out = self._taken(place)
        if len(self.high) > self.limit or len(self.flat) > self.numbers:
            last = np.argsort(self.used, kind="stable")[::-1][: self.limit // 2]  # the newest first
            last = np.sort(last[np.cumsum(self.size[last], dtype=np.int64) <= self.numbers // 2])
            self.flat, at = self._taken(last)
            self.high, self.low, self.used, self.size, self.start = self.high[last], self.low[last], self.used[last], self.size[last], at[:-1]
        return out

    def _taken(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[place]
        to = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return self.flat[np.arange(to[-1]) + np.repeat(self.start[place] - to[:-1], sizes)], to
