"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript's lines are observed: the kind of speaker marker, whether a blank line goes before,
a question mark at the end, the length, a quotation mark. A transcript marks a role in one way: of
the ways in which it does, the one most used (the first, where two are equal) is the role's marker, any other is
an alias, as text that only looks like a marker is. The hidden state of a line is
its role (system, user, assistant) and whether a turn begins. Start, transition and emission
probabilities are counted, with one added (to emissions in the shares that all roles together have), on at most
SAMPLE labelled conversations, those with the least hashed ids; a share NOISE of each feature is taken to be
random, such as marker words within turns, and PARAGRAPHS of the lines within turns to follow a blank one. Viterbi finds the likeliest states of a whole transcript. A marker
is taken off only where a turn of its role begins; all else is kept as it stands, with its indentation and blank
lines, but for blank lines where a turn begins or ends. Each turn is rendered as <|role|>, its text and <|end|>
on lines of their own. Lines end at a line feed, and blank ones have blanks, tabs and carriage returns only.

Defined cases: a null, empty or blank transcript has no turn and renders as an empty text; one
line alone is one turn; equal likelihoods go to the first state in the order of STATES; a text's
own "<|" is written "< |"; in :func:`transcripts` rows with a null conversation are left out, null
texts count as empty, a null role as user, turns of equal number are ordered by role and text,
and repeated rows count once; names that clash get underscores appended; texts are used whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.shared import free_name, own, prepare

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]
SAMPLE = 400
#: Share of lines of which a feature is drawn at random: training transcripts are tidier than others.
NOISE = 0.02
#: Share of lines within turns that begin a paragraph: the texts that models are fitted on have one each.
PARAGRAPHS = 0.05
BLANK = " \t\r"
MARKER = re.compile(
    r"(?P<open>#{1,6}[ \t]{0,4}|\*{1,2}|[\[(<{]\|?\s{0,2}(?:im_start\|>)?|>\s{0,4})?(?P<name>[^\W\d_][\w ]{0,24}?)(?:\s{0,2}\d{1,2})?(?:\s{0,2}(?P<close>\|?[\])>}]|\*{1,2}))?(?:\s{0,2}(?P<colon>:\*{0,2}|[-–—](?=\s)|\|))?(?=\s|\Z)"
)
NAMES = {
    "system": frozenset("system sys context note preamble system prompt instructions".split()) | {"system prompt", "system message"},
    "user": frozenset("user human you customer question q instruction prompt me client student usuario utilisateur benutzer nutzer input".split()),
    "assistant": frozenset("assistant ai bot model response answer a agent expert output reply asistente assistent chatbot machine".split()),
}
KINDS = ("none", "other", "alias", *ROLES)
#: How many values each observed feature has.
SIZES = (len(KINDS), 3, 2, 4, 2)
#: (markers by role, marker on a line of its own, blank line between turns)
STYLES = (
    ({"system": "System:", "user": "User:", "assistant": "Assistant:"}, False, False),
    ({"system": "### System:", "user": "### Instruction:", "assistant": "### Response:"}, True, True),
    ({"system": "Note:", "user": "Q:", "assistant": "A:"}, False, True),
    ({"system": "[SYSTEM]", "user": "[USER]", "assistant": "[BOT]"}, False, False),
    ({"system": "**System:**", "user": "**Human:**", "assistant": "**AI:**"}, False, True),
    ({"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}, True, False),
)
#: Of so many turns after the first, one has lost its marker and has a blank line instead.
LOST = 9


def marker(line: str) -> tuple[str, str, tuple[str, ...]]:
    """(kind of marker, rest of the line, way of marking)."""
    plain = line.lstrip()
    m = MARKER.match(plain)
    opened = (m["open"] or "").strip() if m else ""
    if not m or not (m["colon"] or m["close"] and opened or "im_start" in opened):
        return "none", line, ()
    name = " ".join(m["name"].lower().split())
    for role, names in NAMES.items():
        if name in names:
            rest = plain[m.end() :]
            return role, rest[1:] if rest[:1] in (" ", "\t") else rest, (opened, name, m["close"] or "", m["colon"] or "")
    return ("other" if m["colon"] == ":" else "none"), line, ()


@dataclass
class Lines:
    """A transcript's lines: ``at`` are those that aren't blank, ``seen`` their features, ``rest`` what follows a marker (None: no marker)."""

    all: list[str]
    at: list[int]
    seen: np.ndarray
    rest: list[str | None]


def observe(text: str) -> Lines:
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(BLANK)]
    marks = [marker(lines[i]) for i in at]
    ways = {r: Counter(way for kind, _, way in marks if kind == r) for r in ROLES}
    way_of = {r: max(c, key=c.get) for r, c in ways.items() if c}  # of equal ones the first met
    rows, before = [], -1
    for i, (kind, rest, way) in zip(at, marks):
        mine = rest if way else lines[i]
        blank = 2 if not rows else int(i > before + 1)
        kind = kind if not way or way_of[kind] == way else "alias"
        mine = mine.strip()
        rows.append((KINDS.index(kind), blank, mine.endswith(("?", "¿", "？")), int(np.searchsorted((1, 80, 300), len(mine), "right")), lines[i].lstrip().startswith((">", "|"))))
        before = i
    return Lines(lines, at, np.array(rows, np.int64).reshape(-1, len(SIZES)), [rest if way else None for _, rest, way in marks])


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def viterbi(self, seen: np.ndarray) -> np.ndarray:
        n = len(seen)
        if not n:
            return np.zeros(0, np.int64)
        score = sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T
        best, back = self.start + score[0], np.zeros((n, len(STATES)), np.int64)
        for i in range(1, n):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways[back[i], np.arange(len(STATES))] + score[i]
        path = np.zeros(n, np.int64)
        path[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def train(examples: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Smoothed counts over (features, states) of labelled transcripts."""
    n = len(STATES)
    start, step, emit = np.ones(n), np.ones((n, n)), [np.zeros((n, s)) for s in SIZES]
    begins = np.array([b for _, b in STATES])
    for i, (role, _) in enumerate(STATES):
        if not begins[i]:
            start[i] = 1e-6
        for j, (other, b) in enumerate(STATES):
            if not b and other != role:
                step[i, j] = 1e-6  # a turn goes on in its own role only
    for seen, states in examples:
        if len(states):
            start[states[0]] += 1
            np.add.at(step, (states[:-1], states[1:]), 1)
            for k, e in enumerate(emit):
                np.add.at(e, (states, seen[:, k]), 1)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    for e in emit:
        for kind in (begins, ~begins):
            e[kind] += share(e[kind].sum(axis=0) + 1)
    blank = emit[1][~begins]
    emit[1][~begins] = share(blank) * (1 - PARAGRAPHS) + PARAGRAPHS * np.eye(3)[1]
    return Model(np.log(share(start)), np.log(share(step)), [np.log((1 - NOISE) * share(e) + NOISE / e.shape[1]) for e in emit])


def turns(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    lines = observe(text or "")
    out: list[tuple[str, list[str]]] = []
    before = 0
    for i, s, kind, rest in zip(lines.at, model.viterbi(lines.seen), lines.seen[:, 0], lines.rest):
        role, begins = STATES[s]
        line = lines.all[i]
        if begins or not out or out[-1][0] != role:
            out.append((role, []))
            if KINDS[kind] == role:
                line = rest
        if out[-1][1]:
            out[-1][1].extend(lines.all[before + 1 : i])
        if line.strip(BLANK):
            out[-1][1].append(line)
        before = i
    return [(r, "\n".join(t)) for r, t in out]


def render(parts: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in parts)


def transcripts(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, transcript, labels): each conversation as a raw text, in a style chosen by its id, with
    some markers lost; labels has (role, lines that aren't blank) of each turn."""
    rows = own(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv is not null")
    rows = rows.select("conv", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("t"))
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))

    def pick(role: Column, of) -> Column:
        by_style = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("style") + 1).cast("int"))
        return F.when(role == "system", by_style([of(s, "system") for s in STYLES])).when(role == "assistant", by_style([of(s, "assistant") for s in STYLES])).otherwise(by_style([of(s, "user") for s in STYLES]))

    def turn(t: Column, i: Column) -> Column:
        lost = (i > 0) & (F.pmod(F.hash(F.col("conv"), i), F.lit(LOST)) == 0)
        mark = pick(t["role"], lambda s, r: s[0][r] + ("\n" if s[1] else " "))
        gap = pick(t["role"], lambda s, r: "\n" if s[2] else "")
        return F.concat(F.when(i == 0, F.lit("")).when(lost, F.lit("\n")).otherwise(gap), F.when(lost, F.lit("")).otherwise(mark), t["text"])

    lines = lambda t, i: F.size(F.filter(F.split(t["text"], "\n"), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    return whole.select("conv", "t", style.alias("style")).select(F.col("conv").alias("conv_id"), F.array_join(F.transform("t", turn), "\n").alias("transcript"), F.transform("t", lambda t, i: F.struct(t["role"].alias("role"), lines(t, i).alias("lines"))).alias("labels"))


def labelled(text: str, labels: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, states) of a transcript whose turns are known; None if its lines don't add up."""
    lines = observe(text)
    states, at = [], 0
    for role, n in labels:
        role = role if role in ROLES else "user"
        if at < len(lines.at) and KINDS[lines.seen[at, 0]] == role and not lines.rest[at].strip(BLANK):
            n += 1  # a marker on a line of its own
        states += [STATES.index((role, k == 0)) for k in range(n)]
        at += n
    return (lines.seen, np.array(states, np.int64)) if len(states) == len(lines.at) else None


def fit(raw: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of :func:`transcripts`; only those are built."""
    ids = [r[0] for r in raw.select("conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample).collect()]
    got = sorted(raw.filter(F.col("conv_id").isin(ids)).collect(), key=lambda r: r.conv_id) if ids else []
    found = [labelled(r.transcript, [(x.role, x.lines) for x in r.labels]) for r in got]
    return train([f for f in found if f])


def format_chats(raw: DataFrame, model: Model, text_col: str = "transcript") -> DataFrame:
    """``raw`` with ``turns`` (role, text), and ``chat``, their canonical rendering."""
    prepare(raw.sparkSession)

    @F.pandas_udf("turns array<struct<role:string,text:string>>, chat string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        found = [turns(t, model) for t in texts]
        return pd.DataFrame({"turns": [[{"role": r, "text": t} for r, t in f] for f in found], "chat": [render(f) for f in found]})

    name = free_name(raw, "__parsed")
    out = raw.withColumn(name, parsed(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in raw.columns], *[F.col(f"{name}.{c}").alias(free_name(raw, c)) for c in ("turns", "chat")])
