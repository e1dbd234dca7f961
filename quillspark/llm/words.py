"""Vectorised words of Arrow text batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls: a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Bag:
    """Words of n documents: document i has ``codes[offsets[i]:offsets[i + 1]]``, indexes into ``unique``."""

    codes: np.ndarray
    offsets: np.ndarray
    unique: pa.Array

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.lengths)


def bag_of_words(texts: pa.Array, lower: bool = False) -> Bag:
    """Words between ASCII white space; ``lower`` maps A-Z only."""
    texts = as_strings(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    encoded = flat.filter(pa.array(full)).dictionary_encode() if len(flat) else flat.dictionary_encode()
    return Bag(np.asarray(encoded.indices).astype(np.int64), kept[offsets], encoded.dictionary)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each ragged row; 0 for an empty one. Works on the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
AS_IS = np.arange(256, dtype=np.uint64)
#: Bytes of text hashed at once; working arrays take about 50 times as much.
HASH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over each other, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, ODD, np.uint64))


@dataclass
class HashedWords:
    """64-bit hashes of all words of n texts: text i has ``hashes[offsets[i]:offsets[i + 1]]``.

    ``data`` are all bytes; word j is ``data[begin[j]:end[j]]``; ``line`` counts the line breaks before it in its text.
    """

    hashes: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    line: np.ndarray
    data: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths)


def _parts(data: np.ndarray) -> list[int]:
    """Where a long text is cut: at the first white space after each HASH_BYTES."""
    cuts = [0]
    while len(data) - cuts[-1] > HASH_BYTES:
        at = cuts[-1] + HASH_BYTES
        while at < len(data) and not (blank := SPACE[data[at : at + HASH_BYTES]]).any():
            at += HASH_BYTES
        cuts.append(min(at + int(blank.argmax()), len(data)) if at < len(data) else len(data))
    return cuts if cuts[-1] == len(data) else [*cuts, len(data)]


def hashed_words(texts: pa.Array, lower: bool = True) -> HashedWords:
    """Words between ASCII white space, hashed from the bytes of a batch without making strings; ``lower`` maps A-Z.

    A single text of more than HASH_BYTES is hashed in parts, so that it takes a few times its bytes and not fifty.
    """
    texts = as_strings(texts)
    if len(texts) != 1 or (size := pc.binary_length(texts)[0].as_py()) <= HASH_BYTES:
        return _hashed(texts, lower)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] :][:size]
    found, lines, cuts = [], 0, _parts(data)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = _hashed(pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, b - a], np.int64)), pa.py_buffer(data[a:b])]), lower)
        found.append((part.hashes, part.begin + a, part.end + a, part.line + lines))
        lines += int(np.count_nonzero(part.data == 10))
    hashes, begin, end, line = (np.concatenate(x) for x in zip(*found, strict=True))
    return HashedWords(hashes, np.array([0, len(hashes)]), begin, end, line, data)


def _hashed(texts: pa.Array, lower: bool) -> HashedWords:
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word = ~SPACE[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.searchsorted(begin, bounds)
    if not len(begin):
        return HashedWords(np.zeros(0, np.uint64), offsets, begin, end, begin, data)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = (LOWER if lower else AS_IS)[data[word]] + np.uint64(1)
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(values * powers(int(size.max()))[place], first) + size.astype(np.uint64))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[begin] - np.repeat(breaks[bounds[:-1]], np.diff(offsets))
    return HashedWords(hashes, offsets, begin, end, line, data)
