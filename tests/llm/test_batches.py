"""Word and shingle hashes of flat byte arrays."""

import random
import re

import numpy as np
import pyarrow as pa

from ruleloom.llm import batches
from ruleloom.llm.batches import Words, pieces, shingles, utf8


def test_words_and_hashes_do_not_depend_on_the_piece():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é\n\tX", k=rng.randint(0, 40))) for _ in range(400)] + [None, "", "   "]
    seen = {}
    for step in (1, 7, 403):
        for start in range(0, len(texts), step):
            part = texts[start : start + step]
            offsets, data = utf8(pa.array(part, pa.string()))
            words = Words(offsets, data)
            hashes = words.hashes()
            for i, text in enumerate(part):
                want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
                own = range(words.first[i], words.first[i + 1])
                assert [bytes(data[words.start[k] : words.end[k]]).decode() for k in own] == want
                for k, w in zip(own, want, strict=True):
                    assert seen.setdefault(w, hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_shingles_are_distinct_sets():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(300)]
    words = Words(*utf8(pa.array(texts)))
    value, bounds = shingles(words, words.hashes(), 5)
    names = {}
    for i, text in enumerate(texts):
        w = text.split()
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        own = value[bounds[i] : bounds[i + 1]]
        assert len(own) == len(want) == len(np.unique(own))
        names.setdefault(frozenset(want), set(own.tolist()))
        assert names[frozenset(want)] == set(own.tolist())


def test_pieces_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(batches, "CHUNK", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in range(20)] + [None, ""])], ["text"])
    assert [t for p in pieces(batch) for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
