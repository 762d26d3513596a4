"""Token ids of whole texts, with each distinct word given to the tokenizer once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task, words encoded at once, and words remembered by a worker.
SLICE_BYTES = 8 << 20
ENCODE_WORDS = 5_000
MAX_WORDS = 250_000
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids by a tokenizer that splits at white space, whatever stands around it.

    The texts are cut at ASCII white space, and between an ASCII letter and a mark
    after it, where this tokenizer always cuts too, and lower-cased in ASCII, as it
    does itself outside of special tokens. The pieces are encoded by the library once and remembered; when the
    memory holds MAX_WORDS, only those met again since the last time stay, as most words of
    large tables are met once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words = pa.array([], pa.string())
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def forget(self) -> None:
        """Drops the words that were not met again since the last time."""
        self.words = self.words.filter(pa.array(self.again))
        self.ids = self.ids[np.repeat(self.again, self.lengths)]
        self.lengths = self.lengths[self.again]
        self.again = np.zeros(len(self.words), bool)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of distinct ``words`` in the memory; new ones are encoded and added.

        The memory is one Arrow array: as Python objects the words would take ten times the space.
        """
        if len(self.words) > MAX_WORDS:
            self.forget()
        places = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(places).to_numpy(zero_copy_only=False)
        known = len(self.words)
        new = words.filter(pa.array(missing))
        lengths, ids = [self.lengths], [self.ids]
        # The library's results are much larger than the ids kept of them, so take some at a time.
        for at in range(0, len(new), ENCODE_WORDS):
            part = new.slice(at, ENCODE_WORDS).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for one in found for i in one), np.uint32, int(lengths[-1].sum())))
        self.words = pa.concat_arrays([self.words, new])
        self.lengths, self.ids = np.concatenate(lengths), np.concatenate(ids)
        self.starts = np.cumsum(self.lengths) - self.lengths
        numbers = places.fill_null(0).to_numpy().astype(np.int64)
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.again[numbers[~missing]] = True
        numbers[missing] = known + np.arange(len(new))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for n texts the n + 1 places where they begin and end."""
        texts = pc.fill_null(texts, "")
        # Names of special tokens count only as they are written.
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(lowered, pattern=r"([A-Za-z])([.,!?;:])", replacement=r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        numbers = self.numbers(coded.dictionary)
        index = numbers[coded.indices.to_numpy()]
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = self.starts[index] - (ends - lengths)
        flat = self.ids[np.arange(total) + np.repeat(shift, lengths)]
        offsets = words.offsets.to_numpy().astype(np.int64)
        return flat, np.concatenate([[0], ends])[offsets - offsets[0]]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with up to ``most`` bytes of text, one row at least.
    What a run needed is given back before the next one, as workers outlive their tasks."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


def binary_slices(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The runs of ``flat`` between ``bounds`` as binary values, without copying each."""
    width = flat.dtype.itemsize
    buffers = [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)
