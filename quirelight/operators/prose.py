"""Prose told by its letters: two-sample Kolmogorov-Smirnov statistic against a sample of prose."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import join_wrapped, strip

#: Characters of the sample of prose and how often each stands in it (fixed values).
SAMPLE = {
    " ": 198, ",": 6, ".": 8, ":": 1, "a": 58, "b": 11, "c": 29, "d": 37, "e": 114, "f": 24, "g": 15, "h": 38, "i": 60, "k": 3, "l": 28, "m": 16, "n": 59,
    "o": 70, "p": 9, "r": 43, "s": 58, "t": 74, "u": 21, "v": 9, "w": 14, "x": 2, "y": 13,
}
#: A text is prose if the chance of its distance is above this; paragraphs of this mean length are wrapped; length of a result.
THRESHOLD, WRAPPED_FROM, LENGTH_LIMIT = 0.001, 80, 20_000

_POINTS = np.array([ord(c) for c in SAMPLE])
_SHARES = np.concatenate([[0.0], np.cumsum(list(SAMPLE.values())) / sum(SAMPLE.values())])


def critical(threshold: float = THRESHOLD) -> float:
    """The distance times sqrt(n m / (n + m)) whose two-sided asymptotic chance is the threshold."""
    return float(np.sqrt(-0.5 * np.log(threshold / 2)))


def distances(texts: pd.Series) -> np.ndarray:
    """Largest difference between the two distributions of characters, for each text; NaN for null and empty ones.

    Between neighbouring points of the sample its distribution is level, so a text is needed only as counts at and between these points.
    """
    sizes = texts.str.len().fillna(0).astype(int).to_numpy()
    codes = np.frombuffer("".join(texts.fillna("")).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = len(_POINTS)
    at = np.searchsorted(_POINTS, codes, "left") + np.searchsorted(_POINTS, codes, "right")  # even: between, odd: at a point
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * (2 * k + 1) + at, minlength=len(sizes) * (2 * k + 1)).reshape(len(sizes), 2 * k + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        own = counts.cumsum(axis=1) / sizes[:, None]
    before = np.abs(own[:, 0::2] - _SHARES)  # just before each point, and at the end
    at_point = np.abs(own[:, 1::2] - _SHARES[1:])
    return np.maximum(before.max(axis=1), at_point.max(axis=1))


def exact_chance(n: int, m: int, h: int) -> float:
    """The chance that two samples of ``n`` and ``m`` from one distribution without ties are ``h / (n m)`` or more apart: counted paths.

    A path is an order of the two samples; the share of paths to (i, j) that stay within the distance is carried on from one
    i + j to the next, over the few i that are within it.
    """
    if n > m:
        n, m = m, n
    inside = np.zeros(n + 3)
    inside[1] = 1.0
    for s in range(1, n + m + 1):
        low, high = max(0, s - m, (n * s - h) // (n + m) + 1), min(n, s, -((-(n * s + h)) // (n + m)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        inside[low + 1 : high + 2] = (inside[low : high + 1] * i + inside[low + 1 : high + 2] * (s - i)) / s
        inside[low] = inside[high + 2] = 0.0
    return 1.0 - float(inside[n + 1])


#: Texts up to this length are judged by counted paths, longer ones by the asymptotic chance.
EXACT_UP_TO = 10_000


@lru_cache(100_000)
def _exactly(n: int, h: int, threshold: float) -> bool:
    return exact_chance(n, sum(SAMPLE.values()), h) > threshold


def prose_like(texts: pd.Series, threshold: float = THRESHOLD) -> np.ndarray:
    """Of each text whether it may be drawn from prose; false for null and empty ones.

    The asymptotic chance is above the exact one, and close to it for long texts; so paths are counted only where the first is above the threshold.
    """
    d, n, m = distances(texts), texts.str.len().fillna(0).astype(int).to_numpy(), sum(SAMPLE.values())
    with np.errstate(invalid="ignore"):
        z = d * np.sqrt(n * m / (n + m))
    keep = (n > 0) & (z < critical(threshold))
    # below this the exact chance is above the threshold, too
    least = np.select([n < 5, n < 20, n < 50, n < 300], [0.65, 0.88, 0.955, 0.975], 0.985) * critical(threshold)
    for k in np.flatnonzero(keep & (n <= EXACT_UP_TO) & (z > least)):
        keep[k] = _exactly(int(n[k]), round(d[k] * n[k] * m), threshold)
    return keep


def ks_distance(text: Column) -> Column:
    """``distances`` as a column; null for null and empty texts."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(distances(texts)).replace({np.nan: None})

    return run(text)


def is_prose(text: Column, threshold: float = THRESHOLD) -> Column:
    """``prose_like`` as a column."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(prose_like(texts, threshold))

    return run(text)


def paragraphs(documents: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_no, paragraph)``: texts cut at empty lines; where the mean length says so, wrapped lines joined."""
    cut = documents.where("text is not null").select("doc_id", F.split("text", "\n\n").alias("ps"))
    mean = F.aggregate("ps", F.lit(0), lambda s, p: s + F.length(p)) / F.size("ps")
    return cut.select("doc_id", F.posexplode(F.when(mean > WRAPPED_FROM, F.transform("ps", join_wrapped)).otherwise(F.col("ps"))).alias("paragraph_no", "paragraph"))


def prose_paragraphs(documents: DataFrame) -> DataFrame:
    """``paragraphs`` with ``n_chars`` and ``keep``."""
    rows = paragraphs(documents).withColumn("n_chars", F.length("paragraph"))
    return rows.withColumn("keep", is_prose(F.col("paragraph")))


def prose_text(documents: DataFrame, limit: int = LENGTH_LIMIT) -> DataFrame:
    """``(doc_id, prose)``: the prose paragraphs joined by blanks, stripped, up to ``limit`` characters; empty without any."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("paragraph_no", "paragraph", "keep"))), lambda p: p["keep"])
    return prose_paragraphs(documents).groupBy("doc_id").agg(F.left(strip(F.array_join(F.transform(kept, lambda p: p["paragraph"]), " ")), F.lit(limit)).alias("prose"))
