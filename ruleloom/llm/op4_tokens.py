"""BPE encoding and decoding by batched merge rounds (see bpe.py), over whole texts in Arrow batches.

Null and empty texts have no tokens. Repeated rows give repeated rows; an empty table gives an empty one. Special strings
inside texts are special tokens, as the library does by default. Rows with a null id are kept with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleloom.llm.batches import pieces
from ruleloom.llm.bpe import Remembered, encode_chunks, raw_ids, vocabulary
from ruleloom.llm.tables import texts


@lru_cache(1)
def _raw(path: str) -> Remembered:
    return Remembered(vocabulary(path), raw_ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text, by the vocabulary file at `path` (a place every executor can read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = _raw(path).rows(part.column("text").fill_null("").to_pylist())
                flat = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in rows]
                ids = pa.array(flat, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the ids of each row; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = vocabulary(path).decode
        for batch in batches:
            out = [turn(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _shown(words, chunks: list[str]) -> list[tuple[str, str]]:
    """(ids as decimals, the symbols decoded) of each chunk, both joined by a space.

    Only for files without a decoder, where decoding joins symbols by a space: then the text of a document is that of its
    chunks, joined by a space.
    """
    ids, bounds = encode_chunks(words, chunks)
    numbers, names, at = list(map(str, ids.tolist())), list(map(words.names.__getitem__, ids.tolist())), bounds.tolist()
    return [(" ".join(numbers[a:b]), " ".join(names[a:b])) for a, b in zip(at, at[1:], strict=False)]


@lru_cache(1)
def _digests(path: str) -> Remembered:
    return Remembered(vocabulary(path), _shown, 150_000)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both as digests.

    The ids are digested as decimals joined by one space. The whole id list of a document lives in one row's task only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        first, second = itemgetter(0), itemgetter(1)
        for batch in batches:
            for part in pieces(batch):
                given = part.column("text").fill_null("").to_pylist()
                counts, ids_sha, text_sha = [], [], []
                if words.decodes_bytes:
                    for row in _raw(path).rows(given):
                        ids = np.frombuffer(b"".join(row), "<u4")
                        counts.append(len(ids))
                        ids_sha.append(_sha(" ".join(map(str, ids.tolist()))))
                        text_sha.append(_sha(words.decode(ids)))
                else:
                    for row in _digests(path).rows(given):
                        shown = " ".join(filter(None, map(first, row)))
                        counts.append(shown.count(" ") + 1 if shown else 0)
                        ids_sha.append(_sha(shown))
                        text_sha.append(_sha(" ".join(filter(None, map(second, row)))))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
