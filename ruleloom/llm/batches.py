"""Texts of Arrow batches as flat byte arrays, their words, and hashes of words and word runs.

Everything works on whole texts. A batch is cut into pieces of bounded size between documents, so the memory of a task
does not depend on the number of rows in a batch; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
CHUNK = 1_000_000

#: White space of the word definition `[^\x20\x09-\x0D]+`, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=_U)
_BASE = _U(int(_RNG.integers(1, 2**63)) * 2 + 1)
_POSITION = _RNG.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
#: Powers of _BASE and of its inverse, as many as the longest piece so far has bytes.
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _U(pow(int(_BASE), -1, 2**64)))):
                _POWERS[k] = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(n, CHUNK + 1) - 1, base)]))
    return _POWERS


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed 64-bit permutation that spreads every bit over all."""
    x = x + _U(salt)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 texts, their bytes); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return (offsets - offsets[0] if len(column) else np.zeros(1, np.int64)), data


def pieces(batch: pa.RecordBatch, text: str = "text", chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `chunk` bytes of text, one document at least."""
    if not batch.num_rows:
        return
    offsets, _ = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of consecutive texts: `start`, `end` (bytes) and `doc` of each; `first` is the index of each text's first word."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE):
        blank = space[data]
        inner = blank[:-1].copy() if len(blank) else blank
        begins = ~blank
        if len(blank):
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(blank))]
            inner[cuts - 1] = True
            begins[1:] &= inner
        self.offsets, self.data = offsets, data
        self.start = np.flatnonzero(begins)
        stops = ~blank
        if len(blank):
            after = blank[1:].copy()
            after[cuts - 1] = True
            stops[:-1] &= after
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        data = LOWER[self.data] if lower else self.data
        return mix(spans(data, self.start, self.end))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span: a polynomial with random byte values, the length mixed in."""
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(data) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=_U)])
        # Brought back to the begin of the span, equal bytes have equal hashes wherever they stand.
        return (total[end] - total[start]) * inverse[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)


def strings(words: Words) -> pa.LargeStringArray:
    """The words as strings, in order. The bytes that `words` takes for space stand in none of them."""
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1  # a word of the next text may begin just here
    offsets = np.concatenate([[0], np.cumsum(words.end - words.start)])
    letters = words.data[np.cumsum(inside[:-1]) > 0]
    return pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(letters))


def runs(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `width` words inside a text, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _POSITION[0]
        for k in range(1, width):
            total += hashes[k : k + n] * _POSITION[k]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[width - 1 :]
    return mix(total[whole]), doc[:n][whole]


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text as (sorted hashes, bounds): text i has hashes[bounds[i] : bounds[i + 1]].

    A text with fewer words than `width` has its whole sequence as its one shingle, a text without words has none.
    """
    value, doc = runs(hashes, words.first, width)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        extra = np.zeros(len(short), _U)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                has = words.count[short] > k
                extra[has] += hashes[words.first[short[has]] + k] * _POSITION[k]
            extra = mix(extra + words.count[short].astype(_U) * _U(0xD6E8FEB86659FD93))
        value, doc = np.concatenate([value, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(words.count) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
