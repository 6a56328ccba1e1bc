"""Text functions as Columns: tokens, normal form, approximate token counts, ids and hashes; and, for scans, tokens of Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import PurePath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}]+"


def tokenize(text: Column) -> Column:
    """Runs of letters and decimal digits, lower-cased; no stop words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@lru_cache(None)
def token_characters() -> np.ndarray:
    """Whether each code point is a letter or a decimal digit."""
    out = np.zeros(0x110000, bool)
    for plane in range(0, len(out), 1 << 16):
        every = "".join(map(chr, range(plane, plane + (1 << 16))))
        if re.search(r"[^\W_]", every):  # most planes have nothing assigned
            out[plane : plane + (1 << 16)] = [k[0] == "L" or k == "Nd" for k in map(unicodedata.category, every)]
    return out


@dataclass
class Tokens:
    """Tokens of the texts ``first`` to ``first + texts``: their places in ``lower`` (all texts, lower-cased, a line feed
    between them), and the index of each text's first token and the end."""

    first: int
    texts: int
    lower: str
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def token_blocks(texts: pa.Array, characters: int = 1 << 20) -> Iterator[Tokens]:
    """:func:`tokenize` of a batch, a block of about so many characters at a time; a null text has no token."""
    is_token = token_characters()
    held, size, first = [], 0, 0
    for i in range(len(texts) + 1):
        if i < len(texts):
            held.append((texts[i].as_py() or "").lower())
            size += len(held[-1])
        if held and (size >= characters or i >= len(texts) - 1):
            lower = "\n".join(held) + "\n"
            points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = is_token[points]
            edge = np.flatnonzero(np.diff(inside, prepend=False).astype(bool))  # the last character is never inside
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])])
            yield Tokens(first, len(held), lower, points, edge[::2], edge[1::2], np.searchsorted(edge[::2], begin))
            first, held, size = first + len(held), [], 0


def term_counts(texts: pa.Array, terms: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, how often each of ``terms`` is one of them)."""
    length, counts = np.zeros(len(texts), np.int32), np.zeros((len(texts), len(terms)), np.int32)
    for b in token_blocks(texts):
        rows = slice(b.first, b.first + b.texts)
        length[rows] = np.diff(b.at)
        size = b.end - b.start
        for j, term in enumerate(terms):
            some = np.flatnonzero(size == len(term))
            for k, c in enumerate(term):
                some = some[b.points[b.start[some] + k] == ord(c)]
            counts[rows, j] = np.bincount(np.searchsorted(b.at, some, "right") - 1, minlength=b.texts)
    return length, counts


def normalize_text(text: Column) -> Column:
    """LF line ends, single blanks, none before a line end, at most one empty line, trimmed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r" +\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


WORDLIKE = r"[\p{L}\p{Nd}'’_]+"


def approximate_tokens(text: Column) -> Column:
    """A run of letters, digits, ' ’ or _ costs a quarter of its length, rounded up; any other mark costs 1."""
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(WORDLIKE), F.lit(0)), F.lit(0), lambda s, w: s + F.floor((F.length(w) + 3) / 4).cast("int"))
    return (runs + F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}'’_\s]", ""))).cast("bigint")


def stable_index(value: Column, n: int) -> Column:
    """First four bytes of SHA-256, little-endian, modulo n."""
    return stable_index_of(F.encode(value, "UTF-8"), n)


def stable_index_of(data: Column, n: int) -> Column:
    h = F.sha2(data, 256)
    little = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    return F.pmod(F.conv(little, 16, 10).cast("bigint"), F.lit(n)).cast("int")


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(name.rlike(r"^.*\.[^.]*$"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return form(c)


def document_id(path: Column, digest: Column) -> Column:
    """Safe name of at most 96 characters, a colon and 16 characters of the content's hash.

    Only a name with a character beyond ASCII goes through Python, for its compatibility form."""
    stem = file_stem(path)
    form = F.when(stem.rlike(r"[^\x00-\x7f]"), nfkc(stem)).otherwise(stem)
    safe = F.regexp_replace(F.substring(form, 1, 96), r"[^\p{L}\p{Nd}\-_.]", "-")
    safe = F.regexp_replace(safe, r"^[-._]+|[-._]+$", "")
    return F.concat(F.when(safe == "", "document").otherwise(safe), F.lit(":"), F.substring(digest, 1, 16))


def chunk_id(document: Column, sequence: Column) -> Column:
    return F.concat(document, F.lit(":"), F.when(sequence < 100_000, F.lpad(sequence.cast("string"), 5, "0")).otherwise(sequence.cast("string")))


def token_windows(ids: Column, maximum: int) -> Column:
    """Windows of an id list with its first and last (special) ids around each; one window if it fits."""
    inner = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0)))
    width = maximum - 2
    many = F.greatest(F.ceil(F.size(inner) / F.lit(width)).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.concat(F.slice(ids, 1, 1), F.slice(inner, i * width + 1, F.lit(width)), F.slice(ids, -1, 1)))
    return F.when(F.size(ids) <= maximum, F.array(ids)).otherwise(cut)


def extension(path: str) -> str:
    return PurePath(path).suffix.lower()
