"""Chat formatting: roles are recovered from raw transcripts by a hidden Markov model, and turns are
rendered canonically.

A transcript is text; a line may start with a speaker marker ("User:", "<|assistant|>", "### Human",
"> bot -") and often doesn't. Hidden states are roles, as first or later line of a turn.
A line emits the marker it shows (its class, or none), its length, how it ends, whether it starts in
upper case and its place in the transcript. Viterbi finds the likeliest states, which say where turns
begin and who speaks. Adjacent lines of one turn are joined, markers are stripped and the turns
are rendered as "<|role|>\\ntext<|end|>" with one line feed between them.

Emissions and transitions are counts with smoothing over the turns of conversations with known roles, once
with most turns marked and once with none. A transcript that shows any marker is read by the first
counts, others by form and order alone. The sample of labelled rows is bounded: at most
TRAIN_CONVERSATIONS conversations, those with the least hash of their id, of each the turns numbered
under TRAIN_TURNS, and only turns of at most TRAIN_CHARS characters; conversations with
crc32(conv_id as text) mod 4 = 2 are held out. Decoding has no bound: a transcript's lines are decoded
whole, with six bytes of back pointers a line.

Cases: null or blank text is a transcript without turns, rendered as empty; markers of unknown
speakers are text; turns of roles other than system, user and assistant take no part in training, and are found as
turns of these three or as text of the turn before; turns with equal numbers are read in the order of their lines; rows without conv_id are one conversation; a marker inside a line is text; very long transcripts are read whole; repeated rows fare alike; an
empty table gives an empty result; other columns pass through, columns named like the added ones are
replaced."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("system", "user", "assistant")
#: The names under which a role appears in transcripts.
NAMES = {
    "system": "system sys context instructions instruction prompt",
    "user": "user human you me question q customer client",
    "assistant": "assistant bot ai agent answer a model chatbot support",
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(r"^\s*(?:[#>*\-\[<|]+\s*)*(%s)\s*(?:\d+\s*)?(?:[\]>|*]+\s*:?|:|\s-\s|(?<=\w)$)\s*" % "|".join(sorted(ROLE_OF, key=len, reverse=True)), re.I)
#: Bounds of the training sample: conversations, turns of each by number, characters of a turn.
TRAIN_CONVERSATIONS, TRAIN_TURNS, TRAIN_CHARS = 1000, 64, 20_000
#: In training every so many turns lose their marker.
FORGOTTEN = 10
MARKER_ELSEWHERE = 1e-6
STATES = [(role, first) for role in ROLES for first in (True, False)]


def marker(line: str) -> tuple[str | None, str]:
    """The role that a line's speaker marker names, and the line without it."""
    m = MARKER.match(line)
    if not m or line[: m.end()].strip().lower() in ("a", "me", "you", "q"):
        return None, line
    return ROLE_OF[m.group(1).lower()], line[m.end() :]


def features(line: str, place: int) -> list[tuple[str, object]]:
    role, rest = marker(line)
    n = len(rest)
    size = next((i for i, most in enumerate((0, 20, 60, 120, 250, 500, 1000)) if n <= most), 7)
    end = rest[-1:] if rest[-1:] in ".?!:," else "-"
    return [("marker", role), ("size", size), ("end", end), ("upper", rest[:1].isupper()), ("place", min(place, 2))]


class Model:
    """Log probabilities of starts, transitions and emissions; emissions for transcripts that show
    markers and for those that show none."""

    def __init__(self, conversations: list[list[tuple[str, str]]], smooth: float = 0.1):
        start, move, emit, total = Counter(), Counter(), Counter(), Counter()
        kinds: dict[str, set] = {"marker": {None, *ROLES}}
        for number, turns in enumerate(conversations):
            before, place = None, 0
            for turn, (role, text) in enumerate(x for x in turns if x[0] in ROLES):
                for i, line in enumerate((text or "").split("\n")):
                    state = STATES.index((role, i == 0))
                    # A few turns go without their marker, as in transcripts that forget some.
                    named = i == 0 and (turn == 0 or (number + turn) % FORGOTTEN)
                    for shown in (True, False):
                        for kind, value in features(f"{role.capitalize()}: {line}" if shown and named else line, place):
                            emit[shown, state, kind, value] += 1
                            total[shown, state, kind] += 1
                            kinds.setdefault(kind, set()).add(value)
                    if before is None:
                        start[state] += 1
                    else:
                        move[before, state] += 1
                    before, place = state, place + 1
        n = len(STATES)
        s = np.array([start[i] + (smooth if STATES[i][1] else 1e-6) for i in range(n)])
        m = np.array([[move[i, j] + (smooth if STATES[j][1] or STATES[i][0] == STATES[j][0] else 1e-9) for j in range(n)] for i in range(n)])
        self.start, self.move = np.log(s / s.sum()), np.log(m / m.sum(axis=1, keepdims=True))

        def share(w, i, k, v):
            if k == "marker" and v is not None and STATES[i] != (v, True):
                return MARKER_ELSEWHERE  # a marker names its role, and starts a turn, nearly beyond doubt
            return (emit[w, i, k, v] + smooth) / (total[w, i, k] + smooth * len(kinds[k]))

        self.emit = {(w, k, v): np.log(np.array([share(w, i, k, v) for i in range(n)])) for w in (True, False) for k, values in kinds.items() for v in values}
        self.known: dict = {}

    def emissions(self, line: str, place: int, shown: bool) -> np.ndarray:
        key = (shown, *features(line, place))
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 10_000:
                self.known.clear()
            got = self.known[key] = sum(self.emit[shown, *f] for f in key[1:] if (shown, *f) in self.emit)
        return got

    def viterbi(self, lines: list[str]) -> list[tuple[str, bool]]:
        """Role, and whether a turn starts, of each line."""
        shown, n = any(marker(x)[0] for x in lines), len(STATES)
        back = np.empty((len(lines), n), dtype=np.uint8)
        score = self.start + self.emissions(lines[0], 0, shown)
        for i, line in enumerate(lines[1:], 1):
            steps = score[:, None] + self.move
            back[i] = best = steps.argmax(axis=0)
            score = steps[best, np.arange(n)] + self.emissions(line, i, shown)
        state = int(score.argmax())
        out = [STATES[state]]
        for i in range(len(lines) - 1, 0, -1):
            state = int(back[i, state])
            out.append(STATES[state])
        return out[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """Role and text of the turns of a transcript."""
        lines = [x for x in (text or "").replace("\r\n", "\n").split("\n") if x.strip()]
        found: list[tuple[str, list[str]]] = []
        for (role, first), line in zip(self.viterbi(lines) if lines else [], lines):
            named, rest = marker(line)
            if first or named or not found or found[-1][0] != role:
                found.append((role, []))
            if (body := (rest if named else line).strip()):
                found[-1][1].append(body)
        return [(role, "\n".join(body)) for role, body in found]


def render(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}<|end|>" for role, text in turns)


def held_out(id: str = "conv_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def train(conversations: DataFrame) -> Model:
    """From conversations(conv_id, turn, role, text), of those that aren't held out."""
    ids = conversations.select("conv_id").filter(F.col("conv_id").isNotNull() & ~held_out()).distinct().orderBy(F.xxhash64("conv_id")).limit(TRAIN_CONVERSATIONS)
    rows = conversations.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "role", "text")
    rows = rows.filter((F.col("turn") < TRAIN_TURNS) & (F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS)).orderBy("conv_id", "turn").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return Model(list(by.values()))


def _format(sent, text: str):
    def run(batches):
        model = sent.value
        for batch in batches:
            turns = [model.turns(x) for x in batch.column(text).to_pylist()]
            new = {
                "roles": pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())),
                "texts": pa.array([[x for _, x in t] for t in turns], pa.list_(pa.string())),
                "rendered": pa.array([render(t) for t in turns], pa.string()),
            }
            keep = [i for i, n in enumerate(batch.schema.names) if n not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new.values()], [*(batch.schema.names[i] for i in keep), *new])

    return run


def format_chats(transcripts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """transcripts with roles and texts of the turns found, and the canonical rendering."""
    kept = [f for f in transcripts.schema.fields if f.name not in ("roles", "texts", "rendered")]
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([*kept, T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("rendered", T.StringType())])
    return transcripts.mapInArrow(_format(transcripts.sparkSession.sparkContext.broadcast(model), text), schema)


def transcripts_of(conversations: DataFrame, style: str = "mixed") -> DataFrame:
    """conv_id, text, truth: conversations written out as raw transcripts. Style: "marked" gives every turn a
    marker, "mixed" leaves it out of every fifth turn but the first, "plain" of all."""
    spoken = F.initcap(F.coalesce("role", F.lit("user")))
    bare = F.lit(True) if style == "plain" else F.lit(False) if style == "marked" else (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 3) & (F.col("turn") > 0)
    body = F.coalesce("text", F.lit(""))
    line = F.when(bare, body).otherwise(F.concat(spoken, F.lit(": "), body))
    turns = conversations.select("conv_id", F.struct("turn", line.alias("line"), F.coalesce("role", F.lit("user")).alias("role")).alias("t"))
    # A conversation is one document; its rows meet in one row whatever its length.
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return packed.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"), F.transform("t", lambda x: x["role"]).alias("truth"))
