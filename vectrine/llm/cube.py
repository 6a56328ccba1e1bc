"""Mixing sources to target weights by the cube method of balanced sampling.

Inclusion probabilities: source s is to give the share w_s of a token budget. Where that is more
than the source holds, it is taken whole and the rest is spread over the others by weight.
All documents of a source have one probability.

Flight: the vector of probabilities moves through the null space of the balancing constraints
(documents and tokens), by a random step that keeps every expectation, until an entry is 0 or 1.
Three free documents are enough for two constraints, so each step is a cross product. The flight
runs in groups of a source's documents side by side, then over what each group left (two at
most), then over what each source left (in groups of sources first, where these are many), which holds the totals over
all sources. Only the rates of the sources are found in one task, from one row each.
Landing: at most two documents remain; their joint draw is the one, of all with these
probabilities, that has the least expected squared deviation of the totals (a linear programme
with its optimum at an end of an interval).

Draws are seeded by source and group, so a task that runs again draws the same.

Defined cases: rows with a null id cannot be drawn and are left out; a null source is one source
of its own; rows that repeat an id are one unit, with the tokens of its longest and the least
source, and go in or out together; null and empty texts count 0 tokens; an empty table gives an
empty result; ids are numbers or cast to them; other columns are ignored, and kept by :func:`mix`.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.shared import free_name, materialise, own, prepare

SHARE = 0.5
TEMPERATURE = 0.5
#: Documents that fly together, and groups whose leftovers do.
GROUP = 4096
EPS = 1e-9


def flight(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities p along null directions of (1, t) until at most two are fractional."""
    p = p.astype(np.float64).copy()
    free = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    scale = float(np.abs(t).max()) or 1.0
    t = t / scale
    draw = iter(rng.random(len(free) + 8).tolist())
    hold: list[int] = []
    at = 0
    values, size = p.tolist(), t.tolist()
    while True:
        while len(hold) < 3 and at < len(free):
            hold.append(free[at])
            at += 1
        if len(hold) < 3:
            if len(hold) == 2 and size[hold[0]] == size[hold[1]]:
                u = (1.0, -1.0)
            else:
                break
        else:
            a, b, c = (size[i] for i in hold)
            u = (b - c, c - a, a - b)
            if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
                u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, d in zip(hold, u):
            if d > 0:
                up, down = min(up, (1 - values[i]) / d), min(down, values[i] / d)
            elif d < 0:
                up, down = min(up, values[i] / -d), min(down, (1 - values[i]) / -d)
        step = up if next(draw, 0.5) * (up + down) < down else -down
        for i, d in zip(hold, u):
            v = values[i] + step * d
            values[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        hold = [i for i in hold if 0 < values[i] < 1]
    return np.array(values)


def landing(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw what the flight left (two at most), with the least expected squared deviation of the totals."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) > 2:
        raise ValueError("the flight leaves two at most")
    if len(left) == 1:
        p[left] = rng.random() < p[left[0]]
    elif len(left) == 2:
        a, b = p[left]
        size = t[left] / max(float(np.abs(t[left]).max()), 1.0)
        cost = lambda x, y: (x + y - a - b) ** 2 + (size @ (x - a, y - b)) ** 2
        slope = cost(1, 1) + cost(0, 0) - cost(1, 0) - cost(0, 1)
        both = max(0.0, a + b - 1) if slope > 0 else min(a, b)
        r = rng.random()
        p[left] = (1, 1) if r < both else (1, 0) if r < a else (0, 1) if r < a + b - both else (0, 0)
    return p


def probabilities(units: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, pi, docs) by source of ``units`` (id, source, tokens). Without ``weights`` a source's
    weight is its tokens to the power of ``temperature``; a source that ``weights`` lacks has none."""
    total = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    if weights is None:
        weighed = total.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(float(temperature))))
    else:
        named = units.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighed = total.join(F.broadcast(named) if len(weights) < 10_000 else named, total["source"].eqNullSafe(named["source"]), "left").select(total["*"], F.coalesce("w", F.lit(0.0)).alias("w"))
    # Sources in the order in which they fill up; one row a source, so one partition will do.
    line = Window.orderBy(F.col("tokens") / F.col("w"), F.col("source").asc_nulls_first())
    real = weighed.filter("w > 0 and tokens > 0")
    full = real.select("*", F.coalesce(F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    budget = weighed.agg((F.sum("tokens") * F.lit(float(share))).alias("budget"))
    rate = full.crossJoin(F.broadcast(budget)).select("source", (F.greatest(F.col("budget") - F.col("before"), F.lit(0.0)) / F.col("rest") * F.col("w") / F.col("tokens")).alias("pi"), F.col("tokens").alias("size"), F.col("w").alias("weight"))
    # A source is full if its own rate is 1 or more; the first that is not fixes the rate of all after it.
    # (The rates after it would be less, as it takes less than it holds.)
    level = rate.agg(F.max(F.when(F.col("pi") < 1, F.col("pi") * F.col("size") / F.col("weight"))).alias("level"))
    lam = rate.crossJoin(F.broadcast(level)).select("source", F.when(F.col("pi") >= 1, 1.0).otherwise(F.least(F.col("level") * F.col("weight") / F.col("size"), F.lit(1.0))).alias("pi"))
    return weighed.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("pi", F.lit(0.0)).alias("pi"), "docs")


def balanced_sample(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, pi, selected) of every document."""
    spark = prepare(docs.sparkSession)
    rows = own(docs, id=id_col, source=source_col, text=text_col).filter("id is not null")
    rows = rows.select(F.col("id").cast("bigint"), "source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"))
    units = materialise(rows.groupBy("id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")), "cube-units")
    rates = materialise(probabilities(units, weights, share, temperature), "cube-rates")
    r = rates.select(F.col("source").alias("s"), "pi", F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP)).cast("bigint").alias("groups"))
    state = units.join(r, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "tokens", "pi", F.col("pi").alias("p"), F.pmod(F.xxhash64("id"), "groups").alias("g"))
    schema = "id bigint, source string, tokens bigint, pi double, p double, g bigint"

    def fly(last: bool, over: str = ""):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
            name = "" if last else f"{over}:{pdf.g[0]}" if over else f"{pdf.source[0]!r}:{pdf.g[0]}"
            rng = np.random.default_rng([seed, zlib.crc32(name.encode()), last])
            # Long documents fly first, so that what is left to land is short.
            pdf = pdf.iloc[rng.permutation(len(pdf))].sort_values("tokens", ascending=False, kind="stable").reset_index(drop=True)
            t = pdf.tokens.to_numpy(np.float64)
            p = flight(pdf.p.to_numpy(), t, rng)
            pdf["p"] = landing(p, t, rng) if last else p
            return pdf

        return run

    most, sources = rates.agg(F.max(F.ceil(F.col("docs") / GROUP)), F.count("*")).first()
    most = most or 0
    done = spark.createDataFrame([], schema)
    while True:
        flown = materialise(state.groupBy("source", "g").applyInPandas(fly(False), schema), "cube-flown")
        done = done.union(flown.filter("p = 0 or p = 1"))
        state = flown.filter("p > 0 and p < 1")
        if most <= 1:
            break
        most = -(-most // GROUP)
        state = state.withColumn("g", F.floor(F.col("g") / GROUP).cast("bigint"))
    # Two documents a source are left at most. Where sources are many, groups of them fly before all do.
    while 2 * sources > GROUP:
        sources = -(-2 * sources // GROUP)
        state = state.withColumn("g", F.pmod(F.xxhash64("source"), F.lit(sources)))
        flown = materialise(state.groupBy("g").applyInPandas(fly(False, str(sources)), schema), "cube-flown")
        done, state = done.union(flown.filter("p = 0 or p = 1")), flown.filter("p > 0 and p < 1")
    done = done.union(state.groupBy().applyInPandas(fly(True), schema))
    return done.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "pi", (F.col("p") == 1).alias("selected"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` that the sample takes."""
    taken = materialise(balanced_sample(docs, weights, share, temperature, seed, id_col, text_col, source_col).filter("selected").select("doc_id"), "cube-taken")
    key = free_name(docs, "__taken")
    # What is taken follows the corpus, so it is never broadcast.
    taken = taken.toDF(key).hint("merge")
    return docs.join(taken, docs[f"`{id_col}`"] == taken[key], "left_semi")
