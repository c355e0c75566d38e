"""Counts of whole texts in Arrow batches: words, lines, symbols, repetition. All by flat byte arrays, none by row."""

from __future__ import annotations

import numpy as np

from ruleloom.llm.batches import SPACE, Words, mix, runs, spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

_U = np.uint64


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there an equal one in the same text, is there an equal one before it) for each value."""
    if not len(value):
        return np.zeros(0, bool), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        key = mix(value + doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def lines(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every \\n-split line that has a word."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[doc + 1])
    inked = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = inked[end] > inked[start]
    return start[full], end[full], doc[full]


def window_cover(hashes: np.ndarray, words: Words, width: int) -> np.ndarray:
    """For each word whether it lies in a window of `width` words that is found twice or more in its text."""
    value, doc = runs(hashes, words.first, width)
    starts = np.arange(len(hashes))[: max(0, len(hashes) - width + 1)]
    starts = starts[words.doc[: len(starts)] == words.doc[width - 1 :]] if len(starts) else starts
    again, _ = repeated(value, doc)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(words: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text, as int64."""
    offsets, data = words.offsets, words.data
    hashes = words.hashes()
    start, end, doc = lines(offsets, data)
    _, again = repeated(spans(data, start, end), doc)
    cover = window_cover(hashes, words, 8)
    points = (data & 0xC0) != 0x80
    n = len(words.count)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_text(points & ~SPACE[data], offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc[again], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(words.doc[cover], minlength=n).astype(np.int64),
    }
