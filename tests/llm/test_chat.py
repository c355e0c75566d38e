"""Roles of transcripts: Viterbi against all paths, blocks against whole transcripts, known roles of the table."""

import itertools
import random

import numpy as np
import pytest

from ruleloom.llm import op1_chat as chat


def best(seen):
    scores = {}
    for states in itertools.product(range(chat.N), repeat=len(seen)):
        s = chat.START[states[0]] + seen[0][states[0]]
        for a, b, e in zip(states, states[1:], seen[1:], strict=False):
            s += chat.TRANSITION[a, b] + e[b]
        scores[states] = s
    return max(scores.values())


def score(states, seen):
    s = chat.START[states[0]] + seen[0][states[0]]
    for a, b, e in zip(states, states[1:], seen[1:], strict=False):
        s += chat.TRANSITION[a, b] + e[b]
    return s


def test_path_is_the_best_of_all():
    rng = random.Random(1)
    lines = ["User: hi?", "Assistant: yes " + "w " * 100, "plain", "System: be kind", "what?", "w " * 400]
    for _ in range(30):
        seen = [chat.emission(rng.choice(lines), rng.random() < 0.5) for _ in range(5)]
        assert score(chat.path(seen, chat.N, -1), seen) == pytest.approx(best(seen))


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("User: hi", (1, "hi")), ("### Human: a b", (1, "a b")), ("<|assistant|> x", (2, "x")), ("**AI**: x", (2, "x")), ("[system] > y", (0, "y")),
        ("A: b", (2, "b")), ("Useful: no", (-1, "Useful: no")), ("no marker", (-1, "no marker")), ("You - go", (1, "go")),
    ],
)
def test_markers(line, want):
    assert chat.marker(line) == want


def transcript(rng, n):
    parts = []
    for k in range(n):
        name = rng.choice(["User: ", "Assistant: ", "", "", "AI: "])
        parts.append(name + "\n".join("w " * rng.choice([3, 30, 200]) + rng.choice(["", "?"]) for _ in range(rng.randint(1, 3))))
    return parts


def whole(parts):
    lines = chat.lines_of(parts)
    seen = [chat.emission(line, opens) for _, line, opens in lines]
    return lines, seen


def test_blocks_find_a_best_path(spark):
    """Decoded in blocks on several levels, the score is that of the whole transcript decoded at once."""
    rng = random.Random(5)
    texts = {c: transcript(rng, n) for c, n in enumerate([1, 2, 7, 40, 90])}
    rows = [(c, k + (1000 if c == 3 else 0), t) for c, parts in texts.items() for k, t in enumerate(parts)]
    rng.shuffle(rows)
    got = {}
    for r in chat.recover(spark.createDataFrame(rows, "conv_id long, part long, text string"), block=3, fan=2).collect():
        got.setdefault(int(r["conv_id"]), []).append(r)
    for c, parts in texts.items():
        lines, seen = whole(parts)
        segments = sorted(got[c], key=lambda r: (r["part"], r["segment"]))
        roles = []
        for r in segments:
            n = r["text"].count("\n") + 1
            role = chat.ROLES.index(r["role"])
            roles += [role if r["begins"] else 3 + role] + [3 + role] * (n - 1)
        assert len(roles) == len(lines)
        assert score(roles, seen) == pytest.approx(score(chat.path(seen, chat.N, -1), seen))


def test_blocks_are_bounded_by_rows(spark):
    """Many rows without conversation and with one part number: blocks stay small, segments are numbered through."""
    rng = random.Random(7)
    texts = transcript(rng, 100)
    rows = [(None, 0, t) for t in texts[:70]] + [(3, 5, t) for t in texts[70:]] + [(4, k, "User: x") for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string").repartition(3)
    sizes = [r["count"] for r in chat._parts(df, 4).groupBy("conv_key", "block").count().collect()]
    assert max(sizes) <= 4 and sum(sizes) == len(rows)
    got = {}
    for r in chat.recover(df, block=4, fan=2).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for c, parts in ((None, sorted(texts[:70])), ("3", sorted(texts[70:]))):
        lines, seen = whole(parts)
        segments = sorted(got[c], key=lambda r: r["segment"])
        assert [r["segment"] for r in segments] == list(range(len(segments)))
        roles = []
        for r in segments:
            role = chat.ROLES.index(r["role"])
            roles += [role if r["begins"] else 3 + role] + [3 + role] * r["text"].count("\n")
        assert len(roles) == len(lines)
        assert score(roles, seen) == pytest.approx(score(chat.path(seen, chat.N, -1), seen))
    assert len(got["4"]) == 5


def test_roles_of_the_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {(str(r["conv_id"]), r["turn"]): r for r in turns.collect()}
    found = {}
    for r in chat.recover(chat.as_transcript(turns)).collect():
        found.setdefault((r["conv_id"], r["part"]), []).append(r)
    assert set(found) == {k for k, r in truth.items() if (r["text"] or "").strip()}
    right = [len(x) == 1 and x[0]["role"] == truth[k]["role"] for k, x in found.items()]
    assert np.mean(right) > 0.95
    for k, x in found.items():
        if len(x) == 1 and x[0]["begins"]:
            assert x[0]["text"] == "\n".join(line for line in truth[k]["text"].split("\n") if line.strip())
            assert x[0]["rendered"] == f"<|{x[0]['role']}|>\n{x[0]['text']}\n"


def test_odd_transcripts(spark):
    rows = [(None, None, "User: a"), (None, 1, "Assistant: b"), (1, 0, None), (2, 0, " \n\t"), (3, 0, " "), (4, 0, "x"), (4, 0, "x"), (5, 7, "User: " + "w " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, part long, text string, role string")
    got = sorted(((r["conv_id"], r["part"], r["role"]) for r in chat.recover(df).collect()), key=str)
    assert [g[0] for g in got].count(None) == 2 and ("1" not in [g[0] for g in got])
    assert (None, 0, "user") in got and (None, 1, "assistant") in got and ("5", 7, "user") in got
    assert sum(g[0] == "4" for g in got) in (1, 2)
    assert chat.recover(df.where("conv_id = 99")).count() == 0
