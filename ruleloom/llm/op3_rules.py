"""Quality rules: base counts with fixed limits, then a logistic regression over hashed n-grams, calibrated.

The model sees how often hashed word 1- and 2-grams and character 3-grams occur in a text, each family as shares of 1. It is
fitted on at most SAMPLE labelled documents of either class (those with the smallest hash of their id, so the same ones at any
partitioning): n-grams are hashed where the texts are read, rows that share an id are reduced to one, and one task gets the
shares, at most FAMILIES * SLOTS of a document, however long it is. Part of the sample is left for Platt's calibration. Scoring
takes whole texts in Arrow batches, very long ones too, and adds up weights by table look-up.

Null and empty texts have no words, fail the base rule and are not kept. Repeated rows give repeated rows; rows with a null
id are judged like others. Without labels of both classes there is no verdict and the base rules alone decide. An empty table
gives an empty one. Columns other than id and text are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import Words, pieces, runs, utf8
from ruleloom.llm.labelled import classes, sample
from ruleloom.llm.measures import measures
from ruleloom.llm.tables import texts

#: Labelled documents of either class that the model is fitted on at most.
SAMPLE = 1500
#: Slots of each n-gram family.
SLOTS = 1 << 15
FAMILIES = 3
#: Entries (document, slot, share) worked on at once while fitting.
ENTRIES = 1 << 19
#: Documents whose calibrated probability of good quality is below this are not kept.
KEEP = 0.3

MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30

_U = np.uint64
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Model:
    """Weights by slot, the intercept, and the calibration p = 1 / (1 + exp(-(scale * logit + shift)))."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -500, 500)))


def characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of every character; the number is made of its UTF-8 bytes, so different characters differ."""
    doc = np.repeat(np.arange(len(words.count)), np.diff(words.offsets))
    data = words.data
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), doc
    start = np.flatnonzero((data & 0xC0) != 0x80)
    number = data[start].astype(np.uint32)
    for k, least in enumerate((0xC0, 0xE0, 0xF0), 1):
        at = np.flatnonzero((data[start] >= least) & (start + k < len(data)))
        number[at] |= data[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return number, doc[start]


def slots(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, text) of every n-gram, family by family: words, word pairs, character triples."""
    hashes = words.hashes(lower=False)
    yield (hashes >> _U(49)).astype(np.int64), words.doc
    value, doc = runs(hashes, words.first, 2)
    yield (value >> _U(49)).astype(np.int64) + SLOTS, doc
    number, doc = characters(words)
    if len(number) > 2:
        key = (number[:-2] * np.uint32(0x9E3779B1) ^ number[1:-1]) * np.uint32(0x85EBCA6B) ^ number[2:]
        key = (key ^ key >> np.uint32(15)) * np.uint32(2654435761)
        inside = doc[:-2] == doc[2:]
        yield (key >> np.uint32(17)).astype(np.int64)[inside] + 2 * SLOTS, doc[:-2][inside]


def shares(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, share) of the slots that occur, text by text: a slot's part in the n-grams of its family."""
    found = []
    for slot, doc in slots(words):
        key, count = np.unique(doc * np.int64(FAMILIES * SLOTS) + slot, return_counts=True)
        doc = key // (FAMILIES * SLOTS)
        found.append((key, (count / np.maximum(np.bincount(doc, count, len(words.count)), 1)[doc]).astype(np.float32)))
    key, share = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key)
    return key[order] // (FAMILIES * SLOTS), (key[order] % (FAMILIES * SLOTS)).astype(np.int32), share[order]


def logits(words: Words, model: Model) -> np.ndarray:
    n = len(words.count)
    out = np.full(n, model.bias)
    for slot, doc in slots(words):
        out += np.bincount(doc, model.weights[slot], n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return out


def fit(row: np.ndarray, slot: np.ndarray, share: np.ndarray, label: np.ndarray, steps: int = 120, penalty: float = 1e-6) -> Model:
    """Logistic regression by accelerated gradient steps on two parts in three, calibrated on the third.

    (row, slot, share) are the entries, those of the third part last; `share` is overwritten. Entries are worked on in blocks,
    so nothing but the entries themselves takes memory in proportion to their number.
    """
    n, width = len(label), FAMILIES * SLOTS
    third = np.arange(n) % 3 == 2
    cut = int(np.searchsorted(third[row], True))
    used, held = ([slice(a, min(a + ENTRIES, end)) for a in range(begin, end, ENTRIES)] for begin, end in ((0, cut), (cut, len(row))))
    # Shares are small: slots are brought to one scale by their root mean square.
    size = np.zeros(width)
    for p in used + held:
        size += np.bincount(slot[p], share[p] ** 2, width)
    size = np.sqrt(size / n) + 1e-4
    long = np.zeros(n)
    for p in used + held:
        share[p] /= size[slot[p]]
        long += np.bincount(row[p], share[p] ** 2, n)
    weight_of = np.where(label == 1, 0.5 / max(label[~third].mean(), 1e-9), 0.5 / max(1 - label[~third].mean(), 1e-9)) * ~third
    norm = np.sqrt(long[~third].max()) + 1
    rate = 4.0 / norm**2 * n
    w, bias, before = np.zeros(width), 0.0, (np.zeros(width), 0.0)
    for k in range(steps):
        push = k / (k + 3)
        at_w, at_b = w + push * (w - before[0]), bias + push * (bias - before[1])
        logit = np.full(n, at_b)
        for p in used:
            logit += np.bincount(row[p], share[p] * at_w[slot[p]], n)
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - label) * weight_of / n
        slope = penalty * at_w
        for p in used:
            slope += np.bincount(slot[p], share[p] * error[row[p]], width)
        before = (w, bias)
        w = at_w - rate * slope
        bias = at_b - rate * error.sum() * 0.1
    logit = np.full(n, bias)
    for p in held:
        logit += np.bincount(row[p], share[p] * w[slot[p]], n)
    scale, shift = platt(logit[third], label[third])
    return Model(w / size, float(bias), scale, shift)


def platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Calibration by Newton steps on smoothed labels."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logit, np.ones(len(logit))], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (ab - [1, 0]))
        ab = ab - step / max(1.0, np.abs(step).max())
    return float(max(ab[0], 1e-3)), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = SAMPLE) -> Model | None:
    """The model of a bounded sample, fitted in one task; None without labels of both classes."""
    chosen = F.broadcast(sample(classes(labels, label), each))  # at most 2 * each rows
    rows = texts(docs).join(chosen, "doc_id").select("doc_id", "label", F.xxhash64("text").alias("digest"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                doc, slot, share = shares(Words(*utf8(part.column("text"))))
                bounds = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (slot, share)]
                given = [part.column(c) for c in ("doc_id", "label", "digest")]
                yield pa.RecordBatch.from_arrays([*given, *lists], ["doc_id", "label", "digest", "slots", "shares"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, views = [], []
        for batch in batches:
            y.append(batch.column("label").to_numpy().astype(float))
            ends = np.cumsum(pa.compute.list_value_length(batch.column("slots")).to_numpy())[:-1]
            flat = [pa.compute.list_flatten(batch.column(c)).to_numpy() for c in ("slots", "shares")]
            views += zip(*[np.split(x, ends) for x in flat], strict=True)
        y = np.concatenate([np.zeros(0), *y])
        held = np.arange(len(y)) % 3 == 2
        if 0 < y[~held].sum() < (~held).sum() and 0 < y[held].sum() < held.sum():
            order = np.argsort(held, kind="stable").astype(np.int32)
            row = np.repeat(order, [len(views[i][0]) for i in order])
            slot, share = (np.concatenate([views[i][k] for i in order]) for k in (0, 1))
            views.clear()
            m = fit(row, slot, share, y)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()]), pa.array([[m.bias, m.scale, m.shift]])], ["weights", "rest"])

    known = rows.mapInArrow(hashed, "doc_id long, label int, digest long, slots array<int>, shares array<float>")
    one = known.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "slots", "shares")).alias("d"))
    one = one.select("doc_id", F.xxhash64("doc_id").alias("place"), "d.label", "d.slots", "d.shares")
    got = one.repartition(1).sortWithinPartitions("place", "doc_id").mapInArrow(run, "weights binary, rest array<double>").collect()
    return Model(np.frombuffer(got[0]["weights"], "<f4").astype(np.float64), *got[0]["rest"]) if got else None


def judge(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, quality_score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(*utf8(part.column("text")))
                found = measures(words)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED_PERCENT * found["n_words"])
                score = model.probability(logits(words, model)) if model else np.ones(part.num_rows)
                columns = [part.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in _COUNTS)]
                columns += [pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "base_failed", "kept", "quality_score"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return texts(docs).mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, quality_score double")


def quality_rules(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(labelled_docs, labels))


def accepted(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The documents, all columns, that the rules keep; each row is judged by itself, so repeated rows share their fate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(*utf8(part.column("text")))
                found = measures(words)
                ok = (found["n_words"] >= MIN_WORDS) & (100 * found["n_repeat_words"] <= MAX_REPEATED_PERCENT * found["n_words"])
                if model:
                    ok &= model.probability(logits(words, model)) >= keep
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
