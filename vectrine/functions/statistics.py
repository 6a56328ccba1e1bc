"""Distributions of measurements: percentiles that enough values stand behind, and intervals of the median."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Values that a percentile needs.
REQUIRED = ((0.99, 100), (0.95, 20), (0.0, 2))


def required(p: float) -> int:
    return next(n for least, n in REQUIRED if p >= least)


def qualified_percentile(value: Column, p: float) -> Column:
    """Interpolated percentile of a group; null where the group has too few values for it."""
    return F.when(F.count(value) >= required(p), F.percentile(value, F.lit(float(p))))


def bootstrap_median(values: Sequence[float], draws: int = 10_000, seed: int = 20260719) -> tuple[float, float]:
    """95 % interval of the median of a few measurements (such as a bench's runs), by resampling them."""
    x = np.asarray(values, np.float64)
    medians = np.median(x[np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))], axis=1)
    return float(np.percentile(medians, 2.5)), float(np.percentile(medians, 97.5))


def is_regression(current: Sequence[float], baseline: Sequence[float], relative: float, absolute: float, lower_is_better: bool = True) -> bool:
    """Whether the intervals are apart, and the medians by more than both thresholds, in the wrong direction."""
    if not len(current) or not len(baseline):
        return False
    (a, b), (c, d) = bootstrap_median(current), bootstrap_median(baseline)
    if a <= d and c <= b:
        return False
    now, then = float(np.median(current)), float(np.median(baseline))
    worse = now - then if lower_is_better else then - now
    return worse > absolute and (abs(then) < 1e-300 or worse / abs(then) > relative)


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df``, and the counters that its next action fills: ``rows`` and, of each condition, how many rows meet it."""
    counters = Observation(name)
    return df.observe(counters, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), counters
