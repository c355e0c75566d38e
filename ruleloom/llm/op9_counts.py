"""Token counts by the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved once, on the driver, by encoding every one of them.
A pre-token that is such a string counts 1 without any merging; only the rest goes through the merge rounds of bpe.py.

Null texts count as empty: no bytes, no tokens. Repeated rows give repeated rows, an empty table an empty one; rows with a
null id are kept with it. Special strings inside texts count as one token, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleloom.llm.batches import pieces, utf8
from ruleloom.llm.bpe import Remembered, Vocabulary, byte_symbols, vocabulary
from ruleloom.llm.tables import texts


def whole_tokens(words: Vocabulary) -> np.ndarray:
    """By id: whether the token's own text, taken as one pre-token, encodes as that one token."""
    back = {s: b for b, s in enumerate(byte_symbols())}
    proved = np.zeros(words.size, bool)
    ids, spelled = [], []
    for i, name in enumerate(words.names):
        if name and name not in words.special and all(c in back for c in name.removesuffix(words.suffix)):
            try:
                text = bytes(back[c] for c in name.removesuffix(words.suffix)).decode()
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token equals it
            if words.pretokens(text) == [text]:
                ids.append(i)
                spelled.append(text)
    made, bounds = words.encode_words(spelled)
    alone = np.diff(bounds) == 1
    ids_ = np.array(ids)
    same = np.zeros(len(ids), bool)
    same[alone] = made[bounds[:-1][alone]] == ids_[alone]
    proved[ids_[same]] = True
    return proved


class Counter:
    """Token counts of chunks: pre-tokens in the proved set count 1, the rest are merged together."""

    def __init__(self, words: Vocabulary, proved: np.ndarray):
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.whole = {
            bytes(back[c] for c in words.names[i].removesuffix(words.suffix)).decode() for i in np.flatnonzero(proved)
        }

    def __call__(self, words, chunks: list[str]) -> list[int]:
        split = list(map(words.pretokens, chunks))
        flat = list(chain.from_iterable(split))
        counts = np.ones(len(flat), np.int64)
        rest = [k for k, w in enumerate(flat) if w not in self.whole]
        counts[rest] = np.diff(words.encode_words([flat[k] for k in rest])[1])
        ends = np.cumsum([0, *map(len, split)])
        total = np.concatenate([[0], np.cumsum(counts)])
        return (total[ends[1:]] - total[ends[:-1]]).tolist()


@lru_cache(1)
def _counts(path: str, proved: bytes) -> Remembered:
    words = vocabulary(path)
    return Remembered(words, Counter(words, np.frombuffer(proved, bool)), 400_000)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; over_limit: more than `limit` tokens."""
    proved = whole_tokens(vocabulary(path)).tobytes()  # one flag per vocabulary entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                column = part.column("text").fill_null("")
                counts = np.fromiter(map(sum, _counts(path, proved).rows(column.to_pylist())), np.int64, len(column))
                sizes = np.diff(utf8(column)[0])
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
