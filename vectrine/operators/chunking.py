"""Chunks of documents: split by ever finer separators, packed to a target, with overlap.

Packing depends on what came before, so each document is packed in order, and documents side by side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.schema import check

SEPARATORS = {
    "recursive": ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "),
    "paragraph": ("\n\n", "\n", " "),
    "sentence": (". ", "! ", "? ", "; ", "\n", " "),
}
RUN = re.compile(r"(?:[^\W_]|['’_])+|\S")
CHUNK = "sequence int, text string, estimated_tokens int, section_sequences array<int>, locations array<string>, heading string"

CHUNKS = pa.list_(pa.struct([("sequence", pa.int32()), ("text", pa.string()), ("estimated_tokens", pa.int32()), ("section_sequences", pa.list_(pa.int32())), ("locations", pa.list_(pa.string())), ("heading", pa.string())]))
#: Documents that are chunked before their chunks become Arrow's.
TOGETHER = 64


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 90
    maximum: int = 120
    overlap: int = 18
    minimum: int = 8
    strategy: str = "recursive"

    def validate(self) -> None:
        check(self.target >= 8 and self.maximum >= self.target and 0 <= self.overlap < self.target and 0 <= self.minimum <= self.target and self.strategy in SEPARATORS, "invalid_chunking_options")


def count_tokens(text: str) -> int:
    return sum((len(r) + 3) // 4 for r in RUN.findall(text))


@lru_cache(None)
def _kinds() -> np.ndarray:
    """Of each code point: 0 for white space, 1 for what words are of, 2 for a mark."""
    out = np.full(0x110000, 2, np.uint8)
    for plane in range(0, len(out), 1 << 16):
        every = "".join(map(chr, range(plane, plane + (1 << 16))))
        for kind, pattern in ((0, r"\s+"), (1, r"(?:[^\W_]|['’_])+")):
            for m in re.finditer(pattern, every):
                out[plane + m.start() : plane + m.end()] = kind
    return out


class _Costs:
    """Tokens of any part of a text that doesn't begin or end within one, from one pass over it."""

    def __init__(self, text: str) -> None:
        kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.concatenate([[False], kind == 1, [False]])
        begin, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        marks = np.flatnonzero(kind == 2)
        start, cost = np.concatenate([begin, marks]), np.concatenate([(end - begin + 3) // 4, np.ones(len(marks), np.int64)])
        order = np.argsort(start, kind="stable")
        self.start, self.sum = start[order].tolist(), [0, *np.cumsum(cost[order]).tolist()]

    def __call__(self, a: int, b: int) -> int:
        return self.sum[bisect_left(self.start, b)] - self.sum[bisect_left(self.start, a)]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    return a, b


def _pieces(text: str, separators: Sequence[str], maximum: int) -> list[tuple[str, int]]:
    """Leaves of the split, depth first, and what they cost. All separators hold white space, so that no token is split."""
    cost = _Costs(text)
    out, stack = [], [(0, len(text), 0)]
    while stack:
        a, b, level = stack.pop()
        if (n := cost(a, b)) <= maximum:
            out.append((text[a:b], n))
        elif level == len(separators):
            out += _cut(text, a, b, cost, maximum)
        else:
            s, parts, at = separators[level], [], a
            while (k := text.find(s, at, b)) >= 0:
                parts.append(_trim(text, at, k + len(s)))
                at = k + len(s)
            parts.append(_trim(text, at, b))
            stack += [(x, y, level + 1) for x, y in reversed(parts) if x < y]
    return out


def _cut(text: str, a: int, b: int, cost: _Costs, maximum: int) -> list[tuple[str, int]]:
    """Words packed up to the limit; a longer word in windows of three characters a token. No token spans two words,
    so what words cost adds up."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    size, step = 0, max(1, 3 * maximum)
    for m in re.compile(r"\S+").finditer(text, a, b):
        n = cost(*m.span())
        if held and size + n > maximum:
            out.append((" ".join(held), size))
            held, size = [], 0
        if n > maximum:
            out += [(w, count_tokens(w)) for w in (m[0][i : i + step] for i in range(0, len(m[0]), step))]
        else:
            held.append(m[0])
            size += n
    return out + [(" ".join(held), size)] * bool(held)


def _tail(texts: list[str], limit: int) -> tuple[str, int] | None:
    """Longest suffix of words that costs at most ``limit``, one word at least; and what it costs."""
    taken: list[str] = []
    size = 0
    if limit:
        for t in reversed(texts):
            for w in reversed(t.split()):
                n = count_tokens(w)
                if taken and size + n > limit:
                    return " ".join(reversed(taken)), size
                taken.append(w)
                size += n
    return (" ".join(reversed(taken)), size) if size else None


def chunk_sections(sections: Sequence[dict], o: ChunkOptions = ChunkOptions()) -> list[dict]:
    """Chunks of (sequence, location, heading, text) sections."""
    o.validate()
    units = []
    for s in sections:
        text = (s["text"] or "").strip()
        if text:
            units += [(p, n, s["sequence"], s["location"], s.get("heading")) for p, n in _pieces(text, SEPARATORS[o.strategy], o.maximum) if n]
    packs: list[list[tuple]] = []
    held: list[tuple] = []
    size = 0
    for u in units:
        if held and (size + u[1] > o.maximum or size >= o.target):
            packs.append(held)
            tail, n = _tail([x[0] for x in held], o.overlap) or (None, 0)
            held, size = ([(tail, n, *held[-1][2:])], n) if tail and n + u[1] <= o.maximum else ([], 0)
        held.append(u)
        size += u[1]
    packs += [held] * bool(held)
    chunks = []
    for p in packs:
        text = "\n\n".join(u[0] for u in p).strip()
        if text:
            chunks.append({"sequence": len(chunks), "text": text, "estimated_tokens": sum(u[1] for u in p), "section_sequences": list(dict.fromkeys(u[2] for u in p)), "locations": list(dict.fromkeys(u[3] for u in p)), "heading": next((u[4] for u in p if u[4] and u[4].strip()), None)})
    if len(chunks) > 1 and chunks[-1]["estimated_tokens"] < o.minimum:
        a, b = chunks[-2], chunks[-1]
        text = f"{a['text']}\n\n{b['text']}"
        if (n := a["estimated_tokens"] + b["estimated_tokens"]) <= o.maximum:
            a |= {"text": text, "estimated_tokens": n, "section_sequences": list(dict.fromkeys(a["section_sequences"] + b["section_sequences"])), "locations": list(dict.fromkeys(a["locations"] + b["locations"]))}
            chunks.pop()
    return chunks


def chunk(docs: DataFrame, options: ChunkOptions = ChunkOptions(), sections_col: str = "sections") -> DataFrame:
    """``docs`` with one row a chunk, its columns in place of ``sections`` (array of sequence, location, heading, text)."""
    options.validate()

    @F.arrow_udf(f"array<struct<{CHUNK.replace(' array', ':array').replace(' int', ':int').replace(' string', ':string')}>>")
    def packed(sections: pa.Array) -> pa.Array:
        # some documents at a time, so that few chunks are Python's objects at once
        parts = [pa.array([chunk_sections(s, options) if s is not None else [] for s in sections.slice(at, TOGETHER).to_pylist()], CHUNKS) for at in range(0, len(sections), TOGETHER)]
        return pa.concat_arrays(parts) if parts else pa.array([], CHUNKS)

    keep = [c for c in docs.columns if c != sections_col]
    return docs.withColumn("__chunk", F.explode(packed(F.col(sections_col)))).select(*keep, "__chunk.*")
