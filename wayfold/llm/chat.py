"""Transcript parsing: a hidden Markov model over speaker markers and line features, then canonical turns.

A transcript is plain text in which speakers are named in some style ("User:", "[ASSISTANT]", "Q:"), often not at
all. Its lines are the observations; the hidden state of a line is a role (system, user, assistant) and whether the
line begins a turn or goes on with it. Start, transition and emission probabilities are smoothed counts over
transcripts whose roles are known; Viterbi finds the likeliest states of all lines, and turns are rendered as

    <|role|>
    text

with the markers taken off.

A transcript too long for a row comes as several parts. Each part is summed up as the best scores from any state before
it to any state at its end (6 by 6 numbers); these are chained along the transcript, forwards for the scores at each
part's start, backwards for the state at its end. So the parts' states are the likeliest of the whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Markers by role (fixed values: what transcripts commonly have).
MARKERS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
}
STYLES = (("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("[SYSTEM] ", "[USER] ", "[ASSISTANT] "), ("Context: ", "Q: ", "A: "))
_ROLE_OF = {w: k for k, r in enumerate(ROLES) for w in MARKERS[r]}
_MARK = re.compile(rf"\s*(?:\*\*|#+\s*)?(?:[\[<(|]+\s*({'|'.join(_ROLE_OF)})\s*[\]>)|]+:?|({'|'.join(_ROLE_OF)})\s*(?:\*\*)?:)(?:\*\*)?\s*", re.I)
N_STATES = 2 * len(ROLES)  # role * 2 + (0: begins a turn, 1: goes on)
N_MARKS, N_PLACES, N_LENGTHS, N_ENDS = 4, 3, 5, 4
N_SYMBOLS = N_MARKS * N_PLACES * N_LENGTHS * N_ENDS


def observe(lines: list[str], before: str | None = None) -> np.ndarray:
    """A symbol a line: marker's role or none; first, after a blank, or other; length; how it ends."""
    out = np.zeros(len(lines), np.int64)
    for i, x in enumerate(lines):
        m = _MARK.match(x)
        mark = 1 + _ROLE_OF[(m[1] or m[2]).lower()] if m else 0
        place = 0 if before is None else 1 if not before.strip() else 2
        body = (x[m.end() :] if m else x).strip()
        length = 0 if not body else min(4, 1 + len(body) // 80)
        end = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!" else 3
        out[i] = ((mark * N_PLACES + place) * N_LENGTHS + length) * N_ENDS + end
        before = x
    return out


class Model:
    """Logarithms of start, transition and emission probabilities, from counts smoothed by one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        # a turn that goes on has the role it has
        allowed = np.ones((N_STATES, N_STATES))
        for s in range(N_STATES):
            for t in range(1, N_STATES, 2):
                allowed[s, t] = s // 2 == t // 2
        begin = np.arange(N_STATES) % 2 == 0
        with np.errstate(divide="ignore"):
            self.start = np.log((start + 1) * begin / ((start + 1) * begin).sum())
            p = (move + 1) * allowed
            self.move = np.log(p / p.sum(axis=1, keepdims=True))
        p = emit + 0.05
        self.emit = np.log(p / p.sum(axis=1, keepdims=True))

    def over(self, symbols: np.ndarray, first: bool) -> np.ndarray:
        """The best scores of all states at the end, by the state before (one row if there is none)."""
        best = self.start[None] if first else None
        for k, o in enumerate(symbols):
            if k or not first:
                best = self.move.copy() if best is None else (best[:, :, None] + self.move).max(axis=1)
            best = best + self.emit[:, o]
        return np.eye(N_STATES) * 0 if best is None else best

    def viterbi(self, symbols: np.ndarray, enter: np.ndarray | None = None, leave: int | None = None) -> np.ndarray:
        """The likeliest states; of ties the lowest state. ``enter``: scores of the states before, ``leave``: the last state."""
        if not len(symbols):
            return np.zeros(0, np.int64)
        score = (self.start if enter is None else (enter[:, None] + self.move).max(axis=0)) + self.emit[:, symbols[0]]
        back = np.zeros((len(symbols), N_STATES), np.int8)
        for i in range(1, len(symbols)):
            both = score[:, None] + self.move
            back[i] = both.argmax(axis=0)
            score = both.max(axis=0) + self.emit[:, symbols[i]]
        states = np.zeros(len(symbols), np.int64)
        states[-1] = score.argmax() if leave is None else leave
        for i in range(len(symbols) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return states


def turns_of(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn; blank lines at a turn's ends go, and turns without text too."""
    turns: list[tuple[str, list[str]]] = []
    for x, s in zip(lines, states):
        m = _MARK.match(x)
        body = x[m.end() :] if m and s % 2 == 0 else x
        if s % 2 == 0 or not turns:
            turns.append((ROLES[s // 2], [body]))
        else:
            turns[-1][1].append(body)
    merged: list[tuple[str, str]] = []
    for role, body in turns:
        text = "\n".join(body).strip()
        if text:
            merged.append((role, text))
    return merged


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n" for role, text in turns)


def fit(labelled: DataFrame) -> Model:
    """A model from (text, states): transcripts and each line's state. Counts are added up by Spark; 6 * 246 numbers reach the driver."""
    width = 1 + N_STATES + N_SYMBOLS

    def count(batches):
        for b in batches:
            n = np.zeros((N_STATES, width))
            for text, states in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s, o = np.array(states, np.int64), observe(text.split("\n"))
                if len(s):
                    n[s[0], 0] += 1
                    np.add.at(n, (s[:-1], 1 + s[1:]), 1)
                    np.add.at(n, (s, 1 + N_STATES + o), 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.reshape(-1)[at])], ["cell", "n"])

    cells = labelled.select("text", "states").mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(N_STATES * width)
    total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    total = total.reshape(N_STATES, width)
    return Model(total[:, 0], total[:, 1 : 1 + N_STATES], total[:, 1 + N_STATES :])


def _lines(text: str | None, first: bool) -> list[str]:
    """A part's lines; one that isn't the first begins with the blank line that parts it from the one before."""
    own = text.split("\n") if text else []
    return own if first else ["", *own]


def _chained(parts: DataFrame, model: Model, kind: str) -> DataFrame:
    """Of the parts (k, p, text, first) of transcripts with several: (k, p, enter, leave). A row of 36 numbers a part is gathered for each."""

    def sum_up(batches):
        for b in batches:
            best = []
            for x, first in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                best.append(model.over(observe(_lines(x, first), None if first else "x"), first).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.list_(pa.float64()))], ["k", "p", "best"])

    def chain(batches):
        for b in batches:
            keys, at, enters, leaves = [], [], [], []
            for i, parts in enumerate(b.column(1).to_pylist()):
                best = [np.array(x["best"]).reshape(-1, N_STATES) for x in parts]
                ends = [best[0][0]]
                for x in best[1:]:
                    ends.append((ends[-1][:, None] + x).max(axis=0))
                leave = [int(ends[-1].argmax())]
                for k in range(len(best) - 1, 0, -1):
                    leave.append(int((ends[k - 1] + best[k][:, leave[-1]]).argmax()))
                keys += [i] * len(parts)
                at += [x["p"] for x in parts]
                enters += [None, *[e.tolist() for e in ends[:-1]]]
                leaves += leave[::-1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(at, pa.int64()), pa.array(enters, pa.list_(pa.float64())), pa.array(leaves, pa.int64())], ["k", "p", "enter", "leave"])

    summed = common.arrow_map(parts, sum_up, f"k {kind}, p bigint, best array<double>")
    return common.arrow_map(summed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "best"))).alias("x")), chain, f"k {kind}, p bigint, enter array<double>, leave bigint")


def parse(transcripts: DataFrame, model: Model, *, id_col: str = "id", text_col: str = "text", series: Column | None = None, part: Column | None = None) -> DataFrame:
    """(id, states, turns, rendered) of each row: each line's state, the turns (role, text) and their canonical text.

    Rows with one ``series`` are the parts of one transcript in the order of ``part``, a blank line between them; the
    first turn of a later part may go on with the one before, and then renders without its role, so that the
    rendered parts in a row are the whole's. A null or empty text has no turns and renders as ''. Lines are \\n-split;
    repeated rows are parsed alike, parts mustn't repeat. An empty table gives an empty result; other columns don't
    matter, whatever their names.
    """
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    d = transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(0) if series is None else series).alias("k"), (F.lit(0) if part is None else part).cast("bigint").alias("p"))
    kinds = dict(d.dtypes)
    if series is None:
        d = d.select("id", "text", F.lit(True).alias("first"), F.lit(None).cast("array<double>").alias("enter"), F.lit(None).cast("bigint").alias("leave"))
    else:
        sizes = d.groupBy(F.col("k").alias("_k")).agg(F.min("p").alias("_p"), F.count(F.lit(1)).alias("_n"))
        d = d.join(sizes, F.col("k").eqNullSafe(F.col("_k"))).withColumn("first", F.col("p") == F.col("_p"))
        known = _chained(d.filter("_n > 1").select("k", "p", "text", "first"), model, kinds["k"]).select(F.col("k").alias("_k2"), F.col("p").alias("_p2"), "enter", "leave")
        d = d.join(known, F.col("k").eqNullSafe(F.col("_k2")) & (F.col("p") == F.col("_p2")), "left").select("id", "text", "first", "enter", "leave")

    def run(batches):
        for b in batches:
            states, turns, texts = [], [], []
            for x, first, enter, leave in zip(*[b.column(c).to_pylist() for c in range(1, 5)]):
                lines = _lines(x, first)
                s = model.viterbi(observe(lines, None if first else "x"), None if enter is None else np.array(enter), leave)
                if not first:
                    lines, s = lines[1:], s[1:]
                t = turns_of(lines, s)
                states.append(s.tolist())
                turns.append([{"role": r, "text": y} for r, y in t])
                goes_on = not first and len(s) and s[0] % 2 == 1 and t
                texts.append(f"\n{t[0][1]}\n{render(t[1:])}" if goes_on else render(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.list_(pa.int64())), pa.array(turns, turn), pa.array(texts, pa.string())], ["id", "states", "turns", "rendered"])

    return common.arrow_map(d, run, f"id {kinds['id']}, states array<bigint>, turns array<struct<role: string, text: string>>, rendered string")


def transcribe(conversations: DataFrame, *, most_turns: int = 512, unmarked: int = 4) -> DataFrame:
    """Transcripts of a table of turns: (conv_id, part, text, states, n_turns), with each line's true state.

    A conversation's style of markers follows a hash of its id; about one turn in ``unmarked``, by a hash, has none. A
    blank line parts turns. Conversations are cut into parts of ``most_turns`` turn numbers, so that none is gathered
    whole however long it is (parse() knows the parts as one transcript); a repeated row counts once, null ids and turns are values like others, null texts are empty, and rows of other roles
    than the three count as user's. Turns of one number are in the order of role and text.
    """
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim("role"))), F.lit(0)).cast("int")
    role = F.when(role == 0, 1).otherwise(role - 1)
    c = conversations.select("conv_id", "turn", role.alias("r"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    mark = F.when(F.pmod(F.xxhash64(F.lit(3), "conv_id", "turn"), F.lit(unmarked)) == 0, "").otherwise(F.get(F.get(marks, style), F.col("r")))
    lines = F.size(F.split("t", "\n"))
    # the blank line before a turn goes on with the turn before it; a first turn has none
    state = F.concat(F.array(F.col("r") * 2), F.array_repeat(F.col("r") * 2 + 1, lines))
    c = c.select("conv_id", F.floor(F.coalesce("turn", F.lit(0)) / most_turns).cast("long").alias("part"), F.struct("turn", "r", "t", F.concat(mark, "t").alias("x"), state.alias("s")).alias("m"))
    g = c.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    states = F.flatten(F.transform("m", lambda m, i: F.when(i < F.size("m") - 1, m["s"]).otherwise(F.slice(m["s"], 1, F.size(m["s"]) - 1))))
    return g.select("conv_id", "part", F.array_join("m.x", "\n\n").alias("text"), states.cast("array<bigint>").alias("states"), F.size("m").cast("long").alias("n_turns"), F.col("m.r").alias("roles"))
