"""Ids of whole texts by the tokenizers library, encoding each distinct segment once per process.

Texts are cut where no match of the vocabularies' split patterns and no step of their normalizers reaches across
(`textblocks.segments`), so a text's ids are those of its segments one after the other. Rare words cost as much as before; common ones
are encoded once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sweeplog.llm import textblocks as tb

# Segments handed to the library at a time, and ids held at a time beyond the texts.
BATCH = 20_000
# Segments that are put into one text where that changes nothing.
JOINED = 500
IDS = 1 << 20


# By vocabulary file, for all tasks of a process: the library's tokenizer and what it made of segments.
_OPEN: dict[str, tuple] = {}


class SubwordEncoder:
    """bare: the vocabulary drops white space and case."""

    def __init__(self, path: str, end_id: int | None = None, *, bare: bool = False):
        self.path, self.end_id, self.bare = path, end_id, bare

    def _open(self) -> tuple:
        if self.path not in _OPEN:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)
            library.encode_special_tokens = True
            library.no_padding()
            library.no_truncation()
            widths = None
            if library.normalizer is None and type(library.pre_tokenizer).__name__ == "ByteLevel":
                # each character of a byte-level token stands for a byte
                widths = np.zeros(library.get_vocab_size(), np.int64)
                for token, number in library.get_vocab().items():
                    widths[number] = len(token)
            _OPEN[self.path] = library, tb.Remembered(), widths
        return _OPEN[self.path]

    @property
    def library(self):
        return self._open()[0]

    def segment_ids(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment one after the other, and where each segment's begin (n + 1 values)."""
        _, _, widths = self._open()
        if widths is None:
            return self._single_ids(vocabulary)
        # Segments from a space to an ASCII character that is not white space can stand one after the other in one text.
        joined = tb.between_space_and_sign(vocabulary)
        index = [np.flatnonzero(joined), np.flatnonzero(~joined)]
        parts = [self._joined_ids(vocabulary.take(pa.array(index[0])), widths), self._single_ids(vocabulary.take(pa.array(index[1])))]
        size, start = np.empty(len(vocabulary), np.int64), np.empty(len(vocabulary), np.int64)
        before = 0
        for rows, (flat, at) in zip(index, parts, strict=True):
            size[rows], start[rows] = np.diff(at), at[:-1] + before
            before += len(flat)
        to = np.concatenate([[0], np.cumsum(size)])
        return np.concatenate([p[0] for p in parts])[np.arange(to[-1]) + np.repeat(start - to[:-1], size)], to

    def _joined_ids(self, vocabulary: pa.Array, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many segments in one text; the bytes that ids stand for tell where each segment's ids end."""
        data, at = tb.text_bytes(vocabulary)
        cuts = [*range(0, len(vocabulary), JOINED), len(vocabulary)]
        texts = [data[at[a] : at[b]].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [np.array(one.ids, np.int64) for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        reached = np.concatenate([[0], np.cumsum(widths[flat])])
        ends = np.searchsorted(reached, at)
        if not np.array_equal(reached[ends], at):
            return self._single_ids(vocabulary)
        return flat, ends

    def _single_ids(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, sizes = [], []
        for at in range(0, len(vocabulary), BATCH):
            texts = vocabulary.slice(at, BATCH).cast(pa.large_string()).to_pylist()
            for one in self.library.encode_batch_fast(texts, add_special_tokens=False):
                ids = one.ids
                sizes.append(len(ids))
                found += ids
        return np.array(found, dtype=np.int64), np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts: the index of the first, their ids one after the other (with the end id, if any), and the n + 1 offsets."""
        cut = (tb.bare_segments if self.bare else tb.segments)(*tb.text_bytes(texts))
        flat, at = self._open()[1].runs(cut.vocabulary, self.segment_ids)
        flat = flat.astype(np.uint32)
        sizes = tb.weighted_sums(cut, np.diff(at))
        total = np.concatenate([[0], np.cumsum(sizes)])
        end, first = int(self.end_id is not None), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(total, total[first] + IDS, side="right")) - 1)
            ids, _ = tb.gathered(flat, at, cut.codes[cut.offsets[first] : cut.offsets[last]])
            offsets = total[first : last + 1] - total[first]
            if end:
                ids = np.insert(ids, offsets[1:], self.end_id)
                offsets = offsets + np.arange(len(offsets))
            yield first, ids, offsets
            first = last
