"""Chat formatting: roles of raw transcript lines by a hidden Markov model, then canonical turns.

A transcript comes in parts (rows), each with one or more lines. A line is seen as a speaker marker (a word for a role at its
start, in the usual spellings), its length, whether it asks, and whether it opens a part. The states are begin and
continuation of a turn of each role; Viterbi's best path gives every line its role, with or without a marker.

Long transcripts are not decoded in one task. The rows are numbered in the order of conversation, part and text, and blocks
are taken from these numbers, so that a block never has more than BLOCK rows, whatever the part numbers are. Blocks are reduced to best scores from state to state (max-plus
matrices); these are combined level by level in the same way, the best states at all block borders come back down, and each
block is decoded between its borders. The result is the best path of the whole transcript.

Null texts are parts without lines and yield nothing. A null conversation id is a conversation of its own, a null part number
counts as 0. Parts of equal number are ordered by their text; repeated rows are repeated parts. An empty table gives an empty
one; columns other than the three named are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ruleloom.operators.indexing import global_index
from ruleloom.staging import stage

ROLES = ("system", "user", "assistant")
#: Rows in a block, and blocks in a block of the next level.
BLOCK = 64
FAN = 64

# Words that name a speaker, by role.
SPEAKERS = {
    "system": "system sys instruction instructions context",
    "user": "user human you me question q customer student prompter client",
    "assistant": "assistant ai bot gpt chatgpt model answer a agent response chatbot",
}
_ROLE_OF = {w: r for r, ws in enumerate(map(SPEAKERS.get, ROLES)) for w in ws.split()}
_MARKER = re.compile(
    r"^[\s>*_\-\[(<|#]{0,8}(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:[\s\])>|*_]{0,4}(?::|>|\])[*_|>\]]{0,3}|\s*\|>|\s+-\s)\s*", re.I
)

# States: begin of a turn of each role, then its continuation.
N = 2 * len(ROLES)
_L = np.log
_BLANK = " \t\r\n\x0b\x0c"


def _transitions() -> np.ndarray:
    """Log probability from state to state: turns go on, or the other side takes over."""
    step = np.full((N, N), 1e-6)
    turn = np.array([[0.02, 0.93, 0.05], [0.01, 0.05, 0.94], [0.01, 0.93, 0.06]])
    for r in range(3):
        for state in (r, 3 + r):
            step[state, 3 + r] = 0.6
            step[state, :3] = 0.4 * turn[r]
    return _L(step / step.sum(1, keepdims=True))


TRANSITION = _transitions()
START = _L(np.array([0.2, 0.6, 0.15, 0.01, 0.03, 0.01]))
#: Log probability of a line's length class (under 60, 300, 1000 characters, more), by role.
LENGTH = _L(np.array([[0.4, 0.4, 0.15, 0.05], [0.35, 0.4, 0.2, 0.05], [0.3, 0.3, 0.25, 0.15]]))
#: Of a question mark at the end, by role.
ASKS = np.array([0.03, 0.4, 0.1])


def marker(line: str) -> tuple[int, str]:
    """(role number or -1, the line without its marker)."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found[1].lower()], line[found.end() :]) if found else (-1, line)


def emission(line: str, opens: bool) -> np.ndarray:
    """Log probability of what is seen of a line, by state."""
    role, rest = marker(line)
    size = len(rest.strip())
    length = LENGTH[:, 0 if size < 60 else 1 if size < 300 else 2 if size < 1000 else 3]
    asks = _L(ASKS) if rest.rstrip().endswith("?") else _L(1 - ASKS)
    plain = length + asks
    if role >= 0:
        begins, goes_on = np.full(3, _L(0.01)), np.full(3, _L(0.002))
        begins[role] = _L(0.85)
    else:
        begins, goes_on = np.full(3, _L(0.12)), np.full(3, _L(0.99))
    opening = _L(0.9) if opens else _L(0.1)
    staying = _L(0.15) if opens else _L(0.85)
    return np.concatenate([plain + begins + opening, plain + goes_on + staying])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def lines_of(parts: list[str]) -> list[tuple[int, str, bool]]:
    """(part, line, opens the part) of the lines with text."""
    out = []
    for k, text in enumerate(parts):
        opens = True
        for line in text.split("\n"):
            if line.strip(_BLANK):
                out.append((k, line, opens))
                opens = False
    return out


def block_matrix(seen: list[np.ndarray]) -> np.ndarray:
    """Best score from the state before the block to its last state. Row N is the begin of a transcript."""
    best = np.full((N + 1, N), -np.inf)
    best[:N] = np.where(np.eye(N, dtype=bool), 0.0, -np.inf)
    if not seen:
        return best
    first = np.vstack([TRANSITION, START]) + seen[0]
    best = first
    for e in seen[1:]:
        best = (best[:, :, None] + TRANSITION[None]).max(1) + e
    return best


def path(seen: list[np.ndarray], before: int, last: int) -> list[int]:
    """States of the lines of a block, between the state before it (N: none) and its last state (-1: free)."""
    score = (START if before == N else TRANSITION[before]) + seen[0]
    back = []
    for e in seen[1:]:
        all_ = score[:, None] + TRANSITION
        back.append(all_.argmax(0))
        score = all_.max(0) + e
    state = int(score.argmax()) if last < 0 else last
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def _flat(m: np.ndarray) -> list[float]:
    return m.ravel().tolist()


_KEY = "conv_key string, block long"


def _solve(blocks: pd.DataFrame, before: int, last: int) -> list[tuple[int, int]]:
    """(state before, last state) of each block of a sequence, for the best path through all."""
    mats = [np.array(m).reshape(N + 1, N) for m in blocks["matrix"]]
    score = mats[0][before]
    back = []
    for m in mats[1:]:
        all_ = score[:, None] + m[:N]
        back.append(all_.argmax(0))
        score = all_.max(0)
    state = int(score.argmax()) if last < 0 else last
    ends = [state]
    for b in reversed(back):
        state = int(b[state])
        ends.append(state)
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends, strict=True))


def borders(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_key, block, state_before, state_last) of all blocks (conv_key, block, matrix), level by level."""
    levels = [matrices]
    while levels[-1].where(F.col("block") >= fan).limit(1).count():
        upper = levels[-1].withColumn("upper", F.floor(F.col("block") / fan))

        def product(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("block")
            total = None
            for m in group["matrix"]:
                m = np.array(m).reshape(N + 1, N)
                total = m if total is None else np.vstack([times(total[:N], m[:N]), (total[N][:, None] + m[:N]).max(0)])
            return pd.DataFrame({"conv_key": [group["conv_key"].iloc[0]], "block": [group["upper"].iloc[0]], "matrix": [_flat(total)]})

        levels.append(stage(upper.groupBy("conv_key", "upper").applyInPandas(product, f"{_KEY}, matrix array<double>"), "chat-level"))
    schema = f"{_KEY}, state_before int, state_last int"

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        known = "state_before" in group
        found = _solve(group, int(group["state_before"].iloc[0]) if known else N, int(group["state_last"].iloc[0]) if known else -1)
        return pd.DataFrame(
            {"conv_key": group["conv_key"], "block": group["block"], "state_before": [a for a, _ in found], "state_last": [b for _, b in found]}
        )

    found = levels[-1].groupBy("conv_key").applyInPandas(inside, schema)
    for level in reversed(levels[:-1]):
        above = found.withColumnRenamed("block", "upper")
        rows = level.withColumn("upper", F.floor(F.col("block") / fan)).join(above, ["conv_key", "upper"])
        found = rows.groupBy("conv_key", "upper").applyInPandas(inside, schema)
    return found


def _parts(transcripts: DataFrame, block: int) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    part = F.coalesce(F.col("part").cast("long"), F.lit(0))
    rows = transcripts.select(key.alias("conv_key"), part.alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull() & (F.trim(F.translate("text", "\t\r\n\x0b\x0c", "     ")) != ""))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = global_index(rows, [F.asc("conv_key"), F.asc("part"), F.asc("text"), F.asc("tie")], "at").drop("tie")
    return rows.withColumn("block", F.floor(F.col("at") / block))


def _segments_before(turns: DataFrame) -> DataFrame:
    """(conv_key, part, block, before): segments of a part in its earlier blocks. Running sums over a range sort, with offsets
    of its partitions, so that no part is summed in one task."""
    sizes = turns.groupBy("conv_key", "part", "block").agg(F.count("*").alias("n"))
    order = ["conv_key", "part", "block"]
    sorted_ = stage(sizes.orderBy(*order).withColumn("_part", F.spark_partition_id()), "chat-segments")
    totals = sorted_.groupBy("_part").agg(F.sum("n").alias("_total"))
    earlier = (W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(W.orderBy("_part").rowsBetween(*earlier)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("_part").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    running = sorted_.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn("_run", F.col("_inside") + F.col("_offset"))
    first = running.groupBy("conv_key", "part").agg(F.min("_run").alias("_first"))
    return running.join(first, ["conv_key", "part"]).select(*order, (F.col("_run") - F.col("_first")).cast("int").alias("before"))


def recover(transcripts: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id string, part, segment, role, begins, text, rendered): turns of transcripts given as (conv_id, part, text).

    A segment is what one turn has in one part; begins says whether the turn begins there. Speaker markers are taken off.
    The `rendered` strings of a conversation, in order of part and segment, are its canonical form.
    """
    parts = _parts(transcripts, block)

    def ordered(group: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, str, bool]], list[np.ndarray]]:
        group = group.sort_values("at")
        lines = lines_of(group["text"].tolist())
        return group, lines, [emission(line, opens) for _, line, opens in lines]

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        _, _, seen = ordered(group)
        return pd.DataFrame({"conv_key": group["conv_key"].iloc[:1], "block": group["block"].iloc[:1], "matrix": [_flat(block_matrix(seen))]})

    reduced = stage(parts.groupBy("conv_key", "block").applyInPandas(reduce, f"{_KEY}, matrix array<double>"), "chat-blocks")
    # Blocks are numbered from the first one of their conversation.
    found = borders(_dense(reduced), fan).withColumnRenamed("block", "dense")
    named = _dense(reduced, keep=True).select("conv_key", "block", "dense").join(found, ["conv_key", "dense"]).drop("dense")

    def decode(group: pd.DataFrame) -> pd.DataFrame:
        group, lines, seen = ordered(group)
        states = path(seen, int(group["state_before"].iloc[0]), int(group["state_last"].iloc[0]))
        rows: list[list] = []
        numbers = group["part"].tolist()
        at = (-1, -1)
        for (k, line, _), state in zip(lines, states, strict=True):
            role, begins = state % 3, state < 3
            text = marker(line)[1] if begins else line
            if begins or at != (k, role):
                segment = rows[-1][2] + 1 if rows and rows[-1][1] == numbers[k] else 0
                rows.append([group["conv_key"].iloc[0], numbers[k], segment, ROLES[role], begins, text])
            else:
                rows[-1][5] += "\n" + text
            at = (k, role)
        out = pd.DataFrame(rows, columns=["conv_key", "part", "segment", "role", "begins", "text"])
        return out.assign(block=group["block"].iloc[0])

    turns = parts.join(named, ["conv_key", "block"]).groupBy("conv_key", "block").applyInPandas(
        decode, "conv_key string, part long, segment int, role string, begins boolean, text string, block long"
    )
    # A part number that goes on in further blocks has its segments counted through.
    if parts.groupBy("conv_key", "part").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").limit(1).count():
        turns = stage(turns, "chat-turns")
        turns = turns.join(_segments_before(turns), ["conv_key", "part", "block"]).withColumn("segment", F.col("segment") + F.col("before"))
    return turns.select(
        F.when(F.col("conv_key") != "", F.substring("conv_key", 2, 1 << 30)).alias("conv_id"),
        "part", "segment", "role", "begins", "text",
        F.when(F.col("begins"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")))
        .otherwise(F.concat("text", F.lit("\n"))).alias("rendered"),
    )


def _dense(blocks: DataFrame, keep: bool = False) -> DataFrame:
    """Blocks numbered from the first block of their conversation on."""
    first = blocks.groupBy("conv_key").agg(F.min("block").alias("_first"))
    moved = blocks.join(first, "conv_key").withColumn("dense", F.col("block") - F.col("_first")).drop("_first")
    return moved if keep else moved.select("conv_key", F.col("dense").alias("block"), "matrix")


# -- transcripts from turns with known roles ------------------------------------------------------------------------------

#: Spellings of speakers: (system, user, assistant).
STYLES = [
    ("System: ", "User: ", "Assistant: "), ("[system] > ", "Human: ", "AI: "), ("### Instruction: ", "### Question: ", "### Answer: "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "), ("Context: ", "Q: ", "A: "), ("**System**: ", "**Customer**: ", "**Agent**: "),
]
#: Of so many turns one has lost its marker.
UNMARKED = 8


def as_transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, part, text) as a raw log would have turns (conv_id, turn, role, text): speakers in one spelling for each
    conversation, and no marker at all on one turn in UNMARKED (not the first)."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    spelling: Column = F.lit("")
    for s, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            spelling = F.when((style == s) & (F.lower("role") == role), F.lit(name)).otherwise(spelling)
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED)) == 0)
    return turns.select("conv_id", F.col("turn").alias("part"), F.concat(F.when(bare, F.lit("")).otherwise(spelling), F.col("text")).alias("text"))
