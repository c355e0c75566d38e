"""Byte-pair encoding by batched numpy merge rounds, for vocabulary files of the `tokenizers` library.

The distinct pre-tokens of a batch are laid out as one flat array of symbols. A round finds the rank of all adjacent pairs
at once, by binary search over the sorted pair keys, takes the lowest rank inside each word, merges its places and compacts
the array; words without a mergeable pair leave. Pre-tokens already encoded are kept in a table of bounded size that is
emptied when full, which changes the time only.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: White space of the splitting patterns (the Unicode property of that name).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: symbols, merge ranks, how its texts are normalised, split and joined again."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.path = spec["model"], path
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = [""] * (max([*ids.values(), *special.values()]) + 1)
        for name, i in [*ids.items(), *special.items()]:
            self.names[i] = name
        self.size = len(self.names)
        symbols = byte_symbols()
        self.inner = np.array([ids.get(s, -1) for s in symbols], np.int32)
        self.last = np.array([ids.get(s + self.suffix, -1) for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.decodes_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if spec["pre_tokenizer"]["type"] == "ByteLevel":
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
            coarse = rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
        else:
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
            coarse = rf"[^{BLANK}]+"
        self.pretokens = regex.compile(pattern).findall
        self.chunks = re.compile(coarse).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.marks = list(special)

    # -- splitting --------------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Chunks of a text: each run of non-blanks (with the blank before it, where pre-tokens take one in) or of blanks.

        No pre-token crosses a chunk, and a chunk has the same pre-tokens alone as in its text. A special string is a
        chunk of its own.
        """
        if self.cut and any(m in text for m in self.marks):
            out: list[str] = []
            for k, part in enumerate(self.cut(text)):
                out += [part] if k % 2 else self.chunks(self._normal(part))
            return out
        return self.chunks(self._normal(text))

    def _normal(self, text: str) -> str:
        if not self.lowers:
            return text
        # The library lowers character by character: no special form of sigma at the end of a word.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    # -- merging ----------------------------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (pre-tokens), merged together in rounds: word i has ids[bounds[i] : bounds[i + 1]]."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        if self.suffix:
            tails = np.cumsum(lengths)[lengths > 0] - 1
            symbols[tails] = self.last[data[tails]]
        word = np.repeat(np.arange(len(raw)), lengths)
        known = symbols >= 0
        ids, owner = self._merge(symbols[known], word[known])
        return ids, np.searchsorted(owner, np.arange(len(raw) + 1))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merge rank of the pair that begins at each place, by binary search; NONE across words."""
        key = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        return np.where((self.keys[found] == key) & (word[at] == word[at + 1]), self.ranks[found], NONE)

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_ids, done_words = [], []
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self._ranks(symbols, word, np.arange(len(symbols) - 1))
        while len(symbols) > 1:
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            best = np.repeat(lowest, np.diff(np.append(starts, len(word))))
            going = best != NONE
            if not going.all():
                done_ids.append(symbols[~going])
                done_words.append(word[~going])
                symbols, word, rank, best = symbols[going], word[going], rank[going], best[going]
                if not len(symbols):
                    break
            joined = np.flatnonzero(rank == best)
            # Of overlapping places ("aaa") every second one counts, from the left.
            fresh = np.append(True, np.diff(joined) > 1)
            if not fresh.all():
                run = np.arange(len(joined)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                joined = joined[run % 2 == 0]
            symbols[joined] = self.made[rank[joined]]
            keep = np.ones(len(symbols), bool)
            keep[joined + 1] = False
            here = joined - np.arange(len(joined))  # one symbol less for each merge before
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only the pairs on either side of a merge have changed.
            at = np.concatenate([here, here - 1])
            at = at[(at >= 0) & (at < len(symbols) - 1)]
            rank[at] = self._ranks(symbols, word, at)
            rank[-1] = NONE
        done_ids.append(symbols)
        done_words.append(word)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def special_form(self, form: Callable, mark: str):
        """form() of a special string, which no merge makes: asked of it with the one id in place of its merges."""
        return form(_One(self.special[mark], self), [mark])[0]

    # -- texts ------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        table = Remembered(self, raw_ids)
        return [np.frombuffer(b"".join(x), "<u4") for x in table.rows(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: symbols joined by a space, or the bytes they stand for where the file says so."""
        if not self.decodes_bytes:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        back = {s: b for b, s in enumerate(byte_symbols())}
        out = bytearray()
        for i in ids.tolist():
            name = self.names[i]
            out += bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        return out.decode("utf-8", "replace")


class _One:
    """Stands for the vocabulary where a special string is its own only pre-token."""

    def __init__(self, i: int, whole: Vocabulary):
        self.names, self.decode, self.i = whole.names, whole.decode, i

    def pretokens(self, chunk: str) -> list[str]:
        return [chunk]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(words), self.i, np.int32), np.arange(len(words) + 1)


def encode_chunks(vocabulary: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pre-tokens of each chunk, as ids[bounds[i] : bounds[i + 1]]."""
    split = list(map(vocabulary.pretokens, chunks))
    ids, bounds = vocabulary.encode_words(list(chain.from_iterable(split)))
    return ids, bounds[np.cumsum([0, *map(len, split)])]


def raw_ids(vocabulary: Vocabulary, chunks: list[str]) -> list[bytes]:
    """The ids of each chunk as little-endian 32-bit numbers."""
    ids, bounds = encode_chunks(vocabulary, chunks)
    data, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Remembered:
    """Form of chunks met before, in two generations of bounded size.

    The unknown chunks of a batch are split into pre-tokens, and these are encoded together in one run of merge rounds.
    A full generation becomes the old one, of which chunks in use are taken over: forgetting changes the time only.
    """

    def __init__(self, vocabulary: Vocabulary, form: Callable, size: int = 250_000):
        self.vocabulary, self.form, self.size = vocabulary, form, size
        self.special = {mark: vocabulary.special_form(form, mark) for mark in vocabulary.special}
        self.young, self.old = dict(self.special), {}

    def rows(self, texts: list[str]) -> list[list]:
        """For each text the forms of its chunks, in order."""
        was = gc.isenabled()
        gc.disable()  # millions of strings that hold no cycles: looking through them again and again takes a third of the time
        try:
            return self._rows(texts)
        finally:
            if was:
                gc.enable()

    def _rows(self, texts: list[str]) -> list[list]:
        split = list(map(self.vocabulary.split, texts))
        if len(self.young) > self.size:
            self.young, self.old = dict(self.special), self.young
        unknown = set().union(*split).difference(self.young)
        if self.old:
            kept = unknown.intersection(self.old)
            self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
            unknown -= kept
        fresh = list(unknown)
        for start in range(0, len(fresh), 50_000):
            part = fresh[start : start + 50_000]
            self.young.update(zip(part, self.form(self.vocabulary, part), strict=True))
        known = self.young.__getitem__
        return [list(map(known, chunks)) for chunks in split]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def file_of(name: str) -> str:
    """Place of a public vocabulary file, by the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)
