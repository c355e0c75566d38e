"""Packing documents into sequences of bounded length: dominance reduction, then best fit.

Spark tokenises, cuts and numbers the pieces; what the packing decides on is their length histogram, which has at most
`capacity` entries however large the corpus is. From it the driver makes a plan of ranges ("the pieces number a to b in order
of length stand in sequences s, s + 1, ... at offset o"), and the tasks look their pieces up in it.

Dominance (after Martello and Toth): a set of pieces with j that fits one sequence dominates all sets with j if every
alternative's other pieces can be put in place of distinct ones of it; then some optimal packing has that set as a sequence
and it is fixed for good. Sets of up to three pieces are tried. What no dominance settles is packed best fit, longest first.

Null and empty texts are one piece, the closing id alone. Equal lengths are ordered by id and piece, repeated rows are packed
each for themselves, rows with a null id too. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import pieces
from ruleloom.llm.bpe import byte_symbols, vocabulary
from ruleloom.llm.tables import texts
from ruleloom.operators.indexing import global_index
from ruleloom.staging import stage

#: (length, pieces, first sequence, offset in it, pieces of this length in each sequence)
Entry = tuple[int, int, int, int, int]


class Encoder:
    """The vocabulary file's ids by the faster of the installed libraries: same merges, same splitting, same special ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        words = vocabulary(path)
        if not words.decodes_bytes or words.suffix:
            raise ValueError("packing needs a byte-level vocabulary whose ids follow its merges")
        back = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in n): i for i, n in enumerate(words.names) if n and n not in words.special}
        self.marks = list(words.special)
        self.encoding = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=words.special
        )

    def __call__(self, text: str) -> np.ndarray:
        if any(m in text for m in self.marks):
            return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), "<u4")
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), "<u4")


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and `end_id`, cut into pieces of `capacity`.

    Only texts longer than `capacity` are cut; the first piece takes what is left over.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for part in pieces(batch):
                out: list[tuple] = []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").fill_null("").to_pylist(), strict=True):
                    ids = np.append(encode(text), np.array([end_id], "<u4"))
                    start, piece = 0, 0
                    stop = len(ids) % capacity or capacity
                    while start < len(ids):
                        own = ids[start:stop]
                        out.append((key, piece, start, len(own), zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if keep_ids else ()))
                        start, stop, piece = stop, stop + capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return texts(docs).mapInArrow(run, schema)


# -- the plan, from a histogram of lengths ------------------------------------------------------------------------------


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Take dominating sets out of `counts` (by length, changed in place): [(times, length, ...)], each a full sequence.

    With j of length w and k the longest piece that fits beside it, fixed sets are:
    {j} if nothing fits; {j, k} if no two others fit together, or none that are longer in sum than k; {j, k, b} with b the
    longest that fits then, if no three others fit and every two that fit have one no longer than b.
    Taking pieces away keeps these conditions true, so a set is taken as often as its pieces last.
    """
    fixed: list[tuple[int, ...]] = []
    for w in range(capacity, 0, -1):
        while counts[w]:
            counts[w] -= 1  # j itself, while the others are looked at
            found = _dominating(counts, capacity - w)
            counts[w] += 1
            if found is None:
                break
            need: dict[int, int] = {}
            for x in (w, *found):
                need[x] = need.get(x, 0) + 1
            times = min(int(counts[x]) // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= times * n
            fixed.append((times, w, *found))
    return fixed


def _dominating(counts: np.ndarray, room: int) -> tuple[int, ...] | None:
    there = np.flatnonzero(counts[: room + 1])
    if not len(there):
        return ()
    k = int(there[-1])
    small = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) == 3 and small.sum() <= room:
        return None
    if _longest_pair(there, counts, room) <= k:
        return (k,)
    counts[k] -= 1
    beside = np.flatnonzero(counts[: room - k + 1])
    counts[k] += 1
    if not len(beside):
        return None
    b = int(beside[-1])
    longer = there[there > b]
    two = np.repeat(longer[:2], np.minimum(counts[longer[:2]], 2))[:2]
    return (k, b) if len(two) < 2 or two.sum() > room else None


def _longest_pair(there: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum of two different pieces that fits."""
    at = np.searchsorted(there, room - there, "right") - 1
    ok = at >= 0
    alone = ok & (at == np.arange(len(there))) & (counts[there] < 2)
    at[alone] -= 1
    ok = at >= 0
    return int((there[ok] + there[at[ok]]).max(initial=0))


def best_fit(counts: np.ndarray, capacity: int, first: int) -> tuple[list[Entry], int]:
    """Best fit, longest first, for whole groups of equal sequences at once; (entries, next free sequence)."""
    entries: list[Entry] = []
    rooms: list[int] = []  # rooms left, sorted, with the groups that have them
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, start: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((start, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, start, n = capacity, first, -(-left // (capacity // length))
                first += n
            each = room // length
            full = min(n, left // each)
            if full:
                entries.append((length, full * each, start, capacity - room, each))
                put(room - each * length, start, full)
                left -= full * each
            if full < n and left:
                entries.append((length, left, start + full, capacity - room, left))
                put(room - left * length, start + full, 1)
                full, left = full + 1, 0
            put(room, start + full, n - full)
    return entries, first


def make_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(entries with the number of their first piece, ordered by it; number of sequences).

    Pieces are numbered by falling length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = counts.copy()
    entries: list[Entry] = []
    first = 0
    for times, *lengths in reduce_by_dominance(counts, capacity):
        offset = 0
        for length in lengths:
            entries.append((length, times, first, offset, 1))
            offset += length
        first += times
    more, first = best_fit(counts, capacity, first)
    begin = total[::-1].cumsum()[::-1] - total  # pieces longer than this
    rows = []
    for entry in sorted(entries + more, key=lambda e: -e[0]):
        rows.append((int(begin[entry[0]]), *entry))
        begin[entry[0]] += entry[1]
    return np.array(rows, np.int64).reshape(-1, 6), first


# -- the operator -------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return place(stage(cut(docs, path, capacity, end_id), "pieces"), capacity)


def place(cuts: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a staged table of pieces with (doc_id, piece, length)."""
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = make_plan(histogram, capacity)
    names = cuts.columns
    numbered = global_index(cuts, [F.desc("length"), F.asc("doc_id"), F.asc("piece")], "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(plan[:, 0], number, "right") - 1] if len(number) else plan[:0]
            k = number - row[:, 0]
            sequence, offset = row[:, 3] + k // row[:, 5], row[:, 4] + k % row[:, 5] * row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, "_number").mapInArrow(run, schema)
