"""Encoding, decoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ruleloom.llm import op4_tokens, op5_packing, op9_counts
from ruleloom.llm.bpe import Vocabulary, file_of
from ruleloom.staging import stage

WORDS, BYTES = file_of("word_bpe_49k.json"), file_of("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (WORDS, BYTES)}


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encode_and_decode_like_the_library(odd, library, path):
    encoded = op4_tokens.encode(odd, path)
    got, back = by_key(encoded), by_key(op4_tokens.decode(encoded, path))
    for row in odd.collect():
        ids = ids_of(library[path], row["text"])
        assert got[row["doc_id"]][0]["ids"] == ids
        assert back[row["doc_id"]][0]["text"] == library[path].decode(ids, skip_special_tokens=False)
    assert len(got[5]) == 2


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_digests(odd, none, library, path):
    got = by_key(op4_tokens.round_trip(odd, path))
    for row in odd.collect():
        ids = ids_of(library[path], row["text"])
        text = library[path].decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[row["doc_id"]][0])[1:] == want
    assert op4_tokens.round_trip(none, path).count() == 0


def test_random_words_like_the_library(library):
    rng = random.Random(3)
    letters = "abcdeéñ日한 \n\t.,'<|>0129½Σ"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    for path in (WORDS, BYTES):
        mine = Vocabulary(path).encode(texts)
        assert [x.tolist() for x in mine] == [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]


def test_forgetting_chunks_changes_nothing(monkeypatch):
    from ruleloom.llm.bpe import Remembered, raw_ids

    words = Vocabulary(BYTES)
    small, large = Remembered(words, raw_ids, size=5), Remembered(words, raw_ids)
    for k in range(6):
        texts = [f"some words {k} and {k * 7} more <|endoftext|>", "some words again"]
        assert small.rows(texts) == large.rows(texts)


def test_counts(odd, none, library):
    got = by_key(op9_counts.count_tokens(odd, BYTES, 100))
    for row in odd.collect():
        n = len(ids_of(library[BYTES], row["text"]))
        assert tuple(got[row["doc_id"]][0])[1:] == (len((row["text"] or "").encode()), n, n > 100)
    assert op9_counts.count_tokens(none, BYTES).count() == 0


def test_whole_tokens_are_proved(library):
    words = Vocabulary(BYTES)
    proved = op9_counts.whole_tokens(words)
    assert proved.sum() > 40_000
    for i in random.Random(1).sample(np.flatnonzero(proved).tolist(), 500):
        text = library[BYTES].decode([i], skip_special_tokens=False)
        assert ids_of(library[BYTES], text) == [i]


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and fits; returns the number of sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_whole_documents(odd, none, library):
    rows = op5_packing.pack(odd, BYTES, capacity=64).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 64) <= -(-total // 64) + 1
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    for row in odd.where("doc_id is null or doc_id != 5").collect():
        ids = np.array([*ids_of(library[BYTES], row["text"]), 0], "<u4")
        start = 0
        for piece, r in enumerate(sorted(found[row["doc_id"]], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (piece, start)
            assert r["length"] == 64 or piece == 0
            assert r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
            start += r["length"]
        assert start == len(ids)
    assert len(found[5]) == 2 * len({r["piece"] for r in found[5]})
    assert op5_packing.pack(none, BYTES).count() == 0


def fewest(lengths, capacity):
    """Least number of sequences, by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(5)
    fixed = 0
    for _ in range(150):
        capacity = rng.randint(8, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        sets = op5_packing.reduce_by_dominance(counts, capacity)
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        assert sorted(rest + [x for times, *ls in sets for x in ls * times]) == sorted(lengths)
        assert all(sum(ls) <= capacity for _, *ls in sets)
        assert sum(t for t, *_ in sets) + fewest(rest, capacity) == fewest(lengths, capacity)
        fixed += sum(t for t, *_ in sets)
    assert fixed > 100


def test_plan_places_equal_pieces_once(spark):
    rng = random.Random(9)
    rows = [(i, 0, rng.choice([1, 2, 3, 7, 7, 7, 50, 60, 100])) for i in range(4000)]
    cuts = stage(spark.createDataFrame(rows, "doc_id long, piece int, length long"), "cuts")
    placed = op5_packing.place(cuts, 100).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 4000
    n = {length: sum(r[2] == length for r in rows) for length in (50, 60, 100)}
    assert check_packing(placed, 100) == n[100] + n[60] + -(-n[50] // 2)  # the short ones go into what 60s leave
