"""Language identification in two levels: first the family, then the language within it.

Linear support vector machines, one for each pair of families and one for each pair of languages
of a family, vote; the winner of a level is the class with most votes, ties going to the larger
summed margin, then the alphabet. Features are the shares of hashed runs of one to three letters
(a word's edge counts as one) in the whole text. As shares are linear, a text's score is the
mean weight of its runs, and no feature vector is built to predict.

The machines are fitted here, on at most PER_LANGUAGE labelled rows of each language, those with
the least hashed ids: the bound is the only thing that does not grow with the corpus.

A text is rejected (``kept`` false) if it has no letter, or if the family is not clear: the margin
of the winning family against its runner-up is below MIN_MARGIN.

Defined cases: a null or empty text, or one without letters, has no language and is rejected; rows
with a null label are predicted but not fitted on; where no two languages have labelled rows
nothing can be told, so every text with a letter is kept, with no language; repeated rows are
predicted each; null ids are kept as they are; a name that clashes gets underscores appended.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.kernel import blocks, code_points, tables, text_array
from vectrine.llm.shared import free_name, own, prepare

FAMILIES: Mapping[str, tuple[str, ...]] = {"germanic": ("de", "en"), "romance": ("es", "fr")}
PER_LANGUAGE = 300
FEATURES = 1 << 12
MIN_MARGIN = 0.01
RESULT = "pred_family string, pred_lang string, margin double, kept boolean"


def runs(a: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of 1, 2 and 3: (hashes, offsets by text); and whether each text has a letter."""
    lower, word = tables()
    cp, at = code_points(a)
    letter = word[cp] & ~((cp >= 48) & (cp <= 57))
    c = np.where(letter, lower[cp], np.uint32(32))
    n = len(c)
    has = np.diff(np.concatenate([[0], np.cumsum(letter)])[at]) > 0
    out, end = [], np.repeat(at[1:], np.diff(at))
    h = np.zeros(n, np.uint32)
    some = np.zeros(n, bool)
    for k in range(3):
        m = n - k
        if m <= 0:
            out.append((np.zeros(0, np.uint32), np.zeros(len(at), np.int64)))
            continue
        h, some = h[:m] * np.uint32(0x01000193) + c[k:], some[:m] | letter[k:]
        ok = np.flatnonzero(some & (np.arange(m) + k < end[:m]))
        bucket = ((h[ok] + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
        out.append((bucket, np.searchsorted(ok, at)))
    return out, has


def features(a: pa.Array) -> np.ndarray:
    """Shares of hashed runs, a row for each text; the three lengths weigh alike."""
    got, _ = runs(a)
    x = np.zeros((len(a), FEATURES), np.float32)
    for bucket, off in got:
        for i in range(len(a)):
            if (m := off[i + 1] - off[i]) > 0:
                x[i] += np.bincount(bucket[off[i] : off[i + 1]], minlength=FEATURES) / m
    return x


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 squared-hinge machine by dual coordinate descent; y is 1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - g / square[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Pairs of classes with their machines; ``langs`` by family. A level of one class has no pair."""

    langs: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # (family or "", first, second)
    weight: np.ndarray
    bias: np.ndarray

    def predict(self, a: pa.Array) -> tuple[list, list, np.ndarray, np.ndarray]:
        """(family, language, family margin, has a letter) of each text."""
        got, has = runs(a)
        score = np.tile(self.bias, (len(a), 1))
        for bucket, off in got:
            m = np.diff(off)
            for p in range(len(self.pairs)):
                some = np.flatnonzero(m)
                score[some, p] += np.add.reduceat(self.weight[p][bucket], off[some], dtype=np.float64) / m[some] if len(some) else 0.0
        family, margin = self._level(score, "", sorted(self.langs))
        fam, lang = [None] * len(a), [None] * len(a)
        by = {f: self._level(score, f, self.langs[f])[0] for f in self.langs}
        for i in np.flatnonzero(has):
            fam[i] = sorted(self.langs)[family[i]]
            lang[i] = self.langs[fam[i]][by[fam[i]][i]]
        return fam, lang, margin, has

    def _level(self, score: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        votes, total = np.zeros((len(score), len(names))), np.zeros((len(score), len(names)))
        between = np.full((len(score), len(names), len(names)), np.inf)
        for p, (f, a, b) in enumerate(self.pairs):
            if f == level and a in names and b in names:
                i, j = names.index(a), names.index(b)
                s = score[:, p]
                votes[:, i] += s > 0
                votes[:, j] += s <= 0
                total[:, i] += s
                total[:, j] -= s
                between[:, i, j], between[:, j, i] = s, -s
        best = np.lexsort((-np.tile(np.arange(len(names)), (len(score), 1)), total, votes), axis=1)[:, -1] if len(names) > 1 else np.zeros(len(score), int)
        return best, between[np.arange(len(score)), best].min(axis=1)


def fit(docs: DataFrame, families: Mapping[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Machines from at most ``per_language`` labelled rows of each language; None if no two have any."""
    prepare(docs.sparkSession)
    known = sorted(x for v in families.values() for x in v)
    rows = own(docs, id=id_col, text=text_col, label=label_col).filter(F.col("label").isin(known) & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    ids = own(docs, id=id_col, label=label_col).filter(F.col("label").isin(known) & F.col("id").isNotNull()).select("id", "label", rank.alias("r")).filter(F.col("r") <= per_language)
    picked = [r.id for r in ids.select("id").distinct().collect()]

    def vectors(batches):
        for batch in batches:
            text = text_array(batch.column(1))
            for i, j in blocks(text):
                x = features(text.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "x"])

    got = rows.filter(F.col("id").isin(picked)).select("label", "text").mapInArrow(vectors, "label string, x binary").collect() if picked else []
    got = sorted((r.label, bytes(r.x)) for r in got)
    x, label = np.array([np.frombuffer(b, np.float32) for _, b in got]), np.array([a for a, _ in got])
    langs = {f: [v for v in sorted(vs) if v in set(label)] for f, vs in families.items()}
    langs = {f: v for f, v in langs.items() if v}
    if sum(map(len, langs.values())) < 2:
        return None
    scale = 1 / (x.std(axis=0) + 1e-4)
    scale /= np.sqrt(((x * scale) ** 2).sum(axis=1)).mean()
    of = {v: f for f, vs in langs.items() for v in vs}
    level = [("", a, b, np.array([of[v] for v in label])) for a, b in combinations(sorted(langs), 2)] + [(f, a, b, label) for f, vs in langs.items() for a, b in combinations(vs, 2)]
    weight, bias = [], []
    for _, a, b, names in level:
        rows_ = (names == a) | (names == b)
        w, c = linear_svm(x[rows_] * scale, np.where(names[rows_] == a, 1.0, -1.0))
        weight.append((w * scale).astype(np.float32))
        bias.append(c)
    return Model(langs, [t[:3] for t in level], np.array(weight), np.array(bias))


def identify(docs: DataFrame, model: Model | None, min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of RESULT."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{RESULT.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>")
    def predict(texts: pa.Array) -> pa.Array:
        own_model, a = shared.value, text_array(texts)
        family, lang, margins, keep = [], [], [np.zeros(0)], [np.zeros(0, bool)]
        for i, j in blocks(a):
            part = a.slice(i, j - i)
            if own_model is None:
                has = runs(part)[1]
                fam, names, margin = [None] * len(part), [None] * len(part), np.zeros(len(part))
                kept = has
            else:
                fam, names, margin, has = own_model.predict(part)
                margin = np.where(has, np.minimum(margin, 1e9), 0.0)
                kept = has & (margin >= min_margin)
            family += fam
            lang += names
            margins.append(margin)
            keep.append(kept)
        columns = [pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(np.concatenate(margins)), pa.array(np.concatenate(keep))]
        return pa.StructArray.from_arrays(columns, ["pred_family", "pred_lang", "margin", "kept"])

    name = free_name(docs, "__language")
    out = docs.withColumn(name, predict(F.col(f"`{text_col}`")))
    for c in ("pred_family", "pred_lang", "margin", "kept"):
        out = out.withColumn(free_name(docs, c), F.col(f"{name}.{c}"))
    return out.drop(name)


def keep_identified(docs: DataFrame, families: Mapping[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without the texts whose language is not clear."""
    found = identify(docs, fit(docs, families, per_language, id_col, text_col, label_col), min_margin, text_col)
    return found.filter(F.col(free_name(docs, "kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])

