"""Similarities of strings and sequences that have no built-in function, over Arrow columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; the rows of the table are the bits of an integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (m + n); 1 for two empty strings, null where one is null."""
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


@F.pandas_udf(DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Probability of k or more."""
    return pd.Series([1 - binomial_cdf(int(x) - 1, int(y), float(q)) for x, y, q in zip(k, n, p)], dtype="float64")


def convolved(parts: list[np.ndarray]) -> np.ndarray:
    """Distribution of the sum of independent counts: neighbours are joined, shortest first, long ones by Fourier transforms."""
    queue = sorted(parts, key=len) or [np.ones(1)]
    while len(queue) > 1:
        joined = [_convolve(a, b) for a, b in zip(queue[::2], queue[1::2])]
        queue = sorted(joined + queue[len(joined) * 2 :], key=len)
    return queue[0]


def _convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if min(len(a), len(b)) < 256:
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)


def hypergeometric_tail(strata: pd.DataFrame) -> tuple[float, float]:
    """(lower, upper) tail of the summed count over strata (a, m1, k, n), by convolving exact distributions."""
    m1, k, n = (strata[c].to_numpy(np.int64) for c in ("m1", "k", "n"))
    logs = np.array([math.lgamma(i + 1) for i in range(int(n.max(initial=0)) + 1)])
    log_choose = lambda n, k: logs[n] - logs[k] - logs[n - k]
    parts, seen, low_sum = [], int(strata["a"].sum()), 0
    for m1, k, n in zip(m1.tolist(), k.tolist(), n.tolist()):
        low, high = max(0, m1 + k - n), min(m1, k)
        low_sum += low
        if high > low:
            x = np.arange(low, high + 1)
            pmf = np.exp(log_choose(k, x) + log_choose(n - k, m1 - x) - log_choose(n, m1))
            parts.append(pmf / pmf.sum())
    dist = convolved(parts)
    at = seen - low_sum
    return min(1.0, math.fsum(dist[: at + 1])), min(1.0, math.fsum(dist[at:]))
