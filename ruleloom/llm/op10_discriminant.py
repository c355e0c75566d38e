"""Quality by regularised quadratic discriminant analysis of document statistics.

Statistics of whole texts are brought near normal by logarithms and logits and staged once. Class means and covariances come
from sums over all labelled documents that may be learned from. Each covariance is shrunk towards the pooled one and both
towards a multiple of the unit matrix, and factored once (Cholesky); the score is the logistic function of the difference of
the two log-densities, each a Mahalanobis distance by the cached factor.

Null and empty texts are texts without words and get a score like others. Repeated rows give repeated rows; rows with a null
id are scored and never learned from. Without two labelled documents of each class every score is the share of good labels
seen (0.5 if none). An empty table gives an empty one. Columns other than id and text are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import SPACE, Words, pieces, runs, spans, utf8
from ruleloom.llm.labelled import classes, held_out
from ruleloom.llm.measures import SYMBOL, lines, per_text, repeated, window_cover
from ruleloom.llm.tables import texts
from ruleloom.staging import stage

#: Shares of the pooled covariance, and of the unit matrix, in each class covariance.
POOLED, UNIT = 0.4, 0.05
#: Scores from here on are predicted good.
GOOD = 0.3

NAMES = [
    "words", "word_length", "word_length_spread", "capitals", "digits", "symbols", "other_marks", "sentence_ends", "lines",
    "repeated_lines", "repeated_words", "same_as_before", "distinct_words", "distinct_pairs", "longest_word", "non_ascii",
]

_U = np.uint64


def _flag(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CAPITAL = _flag(bytes(range(0x41, 0x5B)))
_LETTER = _flag(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_DIGIT = _flag(b"0123456789")
_END = _flag(b".!?")
_MARK = ~(_LETTER | _DIGIT | SPACE | SYMBOL | _END | _flag(b",;:'\"-()"))


def statistics(words: Words) -> np.ndarray:
    """One row of transformed statistics for each text."""
    offsets, data, n = words.offsets, words.data, words.count
    hashes = words.hashes(lower=True)
    points = per_text((data & 0xC0) != 0x80, offsets)
    start, end, line_doc = lines(offsets, data)
    _, line_again = repeated(spans(data, start, end), line_doc)
    _, word_again = repeated(hashes, words.doc)
    pair, pair_doc = runs(hashes, words.first, 2)
    _, pair_again = repeated(pair, pair_doc)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    cover = window_cover(hashes, words, 8)
    size = (words.end - words.start).astype(float)
    count = lambda flags, doc: np.bincount(doc[flags], minlength=len(n)).astype(float)
    mean = np.bincount(words.doc, size, len(n)) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(np.bincount(words.doc, size**2, len(n)) / np.maximum(n, 1) - mean**2, 0))
    longest = np.zeros(len(n))
    full = n > 0
    if full.any():
        longest[full] = np.maximum.reduceat(size, words.first[:-1][full])
    n_lines = np.bincount(line_doc, minlength=len(n)).astype(float)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Log-odds of a share, drawn in for short texts."""
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5 + 20))

    flags = lambda table: per_text(table[data], offsets)
    columns = [
        np.log1p(n), np.log1p(mean), np.log1p(spread), share(flags(_CAPITAL), flags(_LETTER)), share(flags(_DIGIT), points),
        share(flags(SYMBOL), points), share(flags(_MARK), points), share(flags(_END), n), share(n_lines, n),
        share(count(line_again, line_doc), n_lines), share(count(cover, words.doc), n), share(count(same, words.doc), n),
        share(n - count(word_again, words.doc), n), share(np.maximum(n - 1, 0) - count(pair_again, pair_doc), np.maximum(n - 1, 0)),
        np.log1p(longest), share(per_text(data >= 0xC0, offsets), points),
    ]
    return np.stack(columns, 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = statistics(Words(*utf8(part.column("text"))))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """For class 0 and 1: mean, inverse Cholesky factor, and log prior less half the log determinant."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [
            c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (n, sum of x, sum of x x') over (label, x): summed in tasks, then by key."""
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        names = np.tile(np.arange(total.shape[1], dtype=np.int32), 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([0, 1], np.int32), total.shape[1])), pa.array(names), pa.array(total.ravel())], ["label", "place", "value"]
        )

    sums = rows.select("label", "x").mapInArrow(run, "label int, place int, value double")
    out = {k: np.zeros(1 + p + p * p) for k in (0, 1)}
    for r in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # two rows for each moment
        out[r["label"]][r["place"]] = r["value"]
    return {k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in out.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, unit: float = UNIT) -> Model | float:
    """The model, or without two documents of each class the share of good labels."""
    n = {k: v[0] for k, v in sums.items()}
    if min(n.values()) < 2:
        return n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    means = {k: v[1] / n[k] for k, v in sums.items()}
    own = {k: v[2] / n[k] - np.outer(means[k], means[k]) for k, v in sums.items()}
    both = sum(n[k] * own[k] for k in own) / sum(n.values())
    out = Model([], [], [])
    for k in (0, 1):
        cov = (1 - pooled) * own[k] + pooled * both
        # The unit part on the scale of each statistic.
        cov = (1 - unit) * cov + unit * np.diag(np.maximum(np.diag(both), 1e-6)) + 1e-9 * np.eye(len(cov))
        root = np.linalg.cholesky(cov)
        out.means.append(means[k])
        out.factors.append(np.linalg.inv(root))
        out.constants.append(float(np.log(n[k] / sum(n.values())) - np.log(np.diag(root)).sum()))
    return out


def learn(table: DataFrame, labels: DataFrame, label: str = "quality") -> Model | float:
    """Fit on the rows (doc_id, x) whose labels may be learned from."""
    return fit(moments(table.join(classes(labels, label), "doc_id")))


def score(table: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row (doc_id, x)."""
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            value = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    scored = table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of their labelled part."""
    table = stage(features(docs), "statistics")
    return score(table, learn(table, labels))


def accepted(docs: DataFrame, model: Model | float) -> DataFrame:
    """The documents, all columns, that are predicted good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = statistics(Words(*utf8(part.column("text"))))
                value = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
                yield part.filter(pa.array(value >= GOOD))

    return docs.mapInArrow(run, docs.schema)
