"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is plain text in which turns begin with speaker markers of any style ("User:", "[bot]",
"Q:", a name). Each line is reduced to features: the kind of its marker, which of the transcript's
distinct speakers it names, its length, its end. The hidden states are a role's first line and its
further lines. Transition and emission counts are taken from a bounded sample of labelled
conversations, rendered in every style; Viterbi finds the roles, and turns are rendered canonically.
Parsing is a map over the transcripts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

ROLES = ("system", "user", "assistant")
#: State 2r is the first line of role r, 2r + 1 a further line.
STATES = 2 * len(ROLES)
MARKER = re.compile(r"^\s*(?:[>#*_-]+\s*)?(?:[\[(<|*]{1,2})?\s*([^\W\d_][\w .'-]{0,30}?)\s*(?:[\])>|*]{1,2}\s*:?|:\s?)(?:[*]{1,2})?\s*")
KINDS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "q", "question", "me", "you", "customer", "client", "prompt"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "support", "response", "gpt"),
}
KIND = {word: role for role, words in KINDS.items() for word in words}
#: Markers for system, user and assistant, as transcripts have them; "\n" between marker and text where it ends with it.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("Instructions: ", "Q: ", "A: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("**System:** ", "**User:** ", "**Bot:** "),
    ("### System:\n", "### Human:\n", "### Assistant:\n"),
    ("<system> ", "<client> ", "<agent> "),
    ("System: ", "Maria: ", "Jonas: "),
)
#: Styles that no model is fitted on; op10_chat judges it by them, too.
UNSEEN = (
    ("SYS: ", "Customer: ", "Support: "),
    ("# Context:\n", "**Human:** ", "**Agent:** "),
    ("System: ", "Zoe: ", "Karl: "),
    ("(system) ", "(me) ", "(bot) "),
    ("> Instructions: ", "> Question: ", "> Answer: "),
    ("|sys| ", "|client| ", "|model| "),
)
TURNS = "conv_id long, turn long, role string, text string, rendered string"


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]
    values: list[dict] = field(default_factory=list)


def marker(line: str) -> tuple[str, int]:
    """The lower-cased speaker of a line's marker and where the marker ends; "" and 0 if it has none."""
    m = MARKER.match(line)
    if not m or not m.end() or len(m.group(1).split()) > 3:
        return "", 0
    return m.group(1).strip().lower(), m.end()


def features(lines: list[str]) -> list[tuple]:
    """For each line: kind of marker, number of the speaker among those not known by kind, length, end, whether it's the first."""
    found = [marker(x)[0] for x in lines]
    seen = Counter(s for s in found if s)
    number: dict[str, int] = {}
    out = []
    for i, (line, s) in enumerate(zip(lines, found)):
        kind = KIND.get(s, "name" if s else "none")
        # a name that comes once is more likely part of the text
        which = number.setdefault(s, min(3, len(number))) if kind == "name" and (seen[s] > 1 or i == 0 or number) else -1
        n = len(line)
        end = line.rstrip()[-1:]
        out.append(((kind, which), 0 if n == 0 else 1 + min(4, int(math.log(n, 4))), "?" if end == "?" else ":" if end == ":" else "." if end in (".", "!") else "-", i == 0))
    return out


def train(convs: list[list[tuple[str, str]]], smooth: float = 0.01, smooth_moves: float = 1.0) -> Model:
    """A model of conversations given as turns (role, text), each rendered in every style.

    Moves are smoothed more than what lines look like: an explicit marker outweighs an odd order of turns.
    """
    start, move = np.full(STATES, smooth_moves), np.full((STATES, STATES), smooth_moves)
    counts: list[dict] = [{}, {}, {}, {}]
    for conv in convs:
        for style in STYLES:
            lines, states = [], []
            for role, text in conv:
                r = ROLES.index(role)
                own = f"{style[r]}{text}".split("\n")
                lines += own
                states += [2 * r] + [2 * r + 1] * (len(own) - 1)
            if not states:
                continue
            start[states[0]] += 1
            for a, b in zip(states, states[1:]):
                move[a, b] += 1
            for s, f in zip(states, features(lines)):
                for c, value in zip(counts, f):
                    c.setdefault(value, np.full(STATES, smooth))[s] += 1
    # a further line belongs to its own role
    for r in range(len(ROLES)):
        for s in range(STATES):
            if s // 2 != r:
                move[s, 2 * r + 1] = 1e-12
                start[2 * r + 1] = 1e-12
    emit, values = [], []
    for c in counts:
        unseen = np.full(STATES, smooth)
        table = np.stack([*c.values(), unseen])
        emit.append(np.log(table / table.sum(0)))
        values.append({v: i for i, v in enumerate(c)})
    return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), emit, values)


def viterbi(model: Model, seen: list[tuple]) -> list[int]:
    """The likeliest states of lines given by features."""
    score = np.zeros((len(seen), STATES))
    for j, (emit, values) in enumerate(zip(model.emit, model.values)):
        score += emit[[values.get(f[j], len(values)) for f in seen]]
    back = np.zeros((len(seen), STATES), dtype=np.int8)
    now = model.start + score[0]
    for i in range(1, len(seen)):
        step = now[:, None] + model.move
        back[i] = step.argmax(0)
        now = step.max(0) + score[i]
    out = [int(now.argmax())]
    for i in range(len(seen) - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def parse(model: Model, transcript: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript; markers are taken off first lines."""
    lines = transcript.split("\n")
    states = viterbi(model, features(lines))
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states):
        if s % 2 == 0 or not turns:
            rest = line[marker(line)[1] :]
            turns.append((ROLES[s // 2], [rest]))
        else:
            turns[-1][1].append(line)
    out = []
    for role, own in turns:
        if len(own) > 1 and own[0] == "":
            own = own[1:]
        out.append((role, "\n".join(own)))
    return out


def render(role: str, text: str) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n{text}\n<|end|>"


def transcripts(convs: DataFrame, styles: tuple[tuple[str, str, str], ...] = STYLES) -> DataFrame:
    """(conv_id, transcript) of conversations (conv_id, turn, role, text), in one of the styles by hash of the id.

    Rows without conv_id are left out, null texts are empty, turns go by number, then role and text;
    null and unknown roles count as user. Repeated rows are turns of their own, and texts of any length
    are taken whole. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles))).cast("int")
    table = F.array(*[F.create_map(*[x for r, m in zip(ROLES, s) for x in (F.lit(r), F.lit(m))]) for s in styles])
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = convs.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(F.element_at(F.get(table, style), t["role"]), t["text"]))
    return one.select("conv_id", F.array_join(lines, "\n").alias("transcript"))


def fit(convs: DataFrame, fit_conversations: int = 1000) -> Model:
    """A model of at most ``fit_conversations`` labelled conversations, those of the lowest hash of conv_id.

    Rows with a null conv_id or text, or without a known role, are left out; repeated rows count as
    often as they come, extra columns are ignored. Without any row the model still parses, by its smoothing alone.
    """
    good = convs.where(F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES) & F.col("text").isNotNull()).select("conv_id", "turn", "role", "text")
    ids = good.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(fit_conversations)
    rows = good.join(F.broadcast(ids), "conv_id").toPandas().sort_values(["conv_id", "turn", "role", "text"], kind="stable")
    return train([list(zip(g["role"], g["text"])) for _, g in rows.groupby("conv_id")])


def parsed(texts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, role, text, rendered) of transcripts (conv_id, transcript).

    Null transcripts have no turns, an empty one has a single empty turn. Repeated rows come out as
    often as they went in, transcripts of any length are parsed whole, and of equally likely states the
    first counts. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            rows = [(conv, i, role, text, render(role, text)) for conv, t in zip(b["conv_id"].tolist(), b["transcript"].tolist()) for i, (role, text) in enumerate(parse(m, t))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "rendered"])

    return texts.where("conv_id is not null and transcript is not null").select("conv_id", "transcript").mapInPandas(scan, TURNS)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, recovered from transcripts in STYLES and UNSEEN.

    The model is fitted on conversations of one half by hash of their id, in STYLES only; the other
    half, and the transcripts in UNSEEN, are held out. Odd rows as in transcripts and parsed.
    """
    convs = common.read(spark, sf_dir, "conversations")
    half = F.pmod(F.xxhash64(F.lit("split"), "conv_id"), F.lit(2)) == 0
    return parsed(transcripts(convs, STYLES + UNSEEN), fit(convs.where(half)))


#: The round trip gives the table back.
ORACLE = """
SELECT conv_id, turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' AS rendered FROM conversations
"""
