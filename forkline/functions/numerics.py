"""Tails of distributions on arrays, and the counting table of rank sums; small helpers inside tasks."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd

_ERFC = np.vectorize(math.erfc, otypes=[float])


def chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for a chi-square of a whole number of degrees: a finite sum, with erfc for odd ones."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, int))
    out = np.full(x.shape, np.nan)
    for k in np.unique(df[np.isfinite(x)]):
        at = (df == k) & np.isfinite(x)
        h = np.maximum(x[at], 0) / 2
        if k % 2 == 0:
            term, total = np.ones_like(h), np.zeros_like(h)
            for i in range(1, k // 2 + 1):
                total += term
                term = term * h / i
            out[at] = np.exp(-h) * total
        else:
            total, term = _ERFC(np.sqrt(h)), np.sqrt(h / math.pi) * 2
            for i in range(1, (k + 1) // 2):
                total = total + np.exp(-h) * term
                term = term * h / (i + 0.5)
            out[at] = total
    return np.clip(out, 0, 1)


def rank_sum_tails(m: int, n: int) -> pd.DataFrame:
    """(m, n, u, low, high): for each excess u of the rank sum of m of m + n untied values over its least, the shares of all choices with u or less, and with u or more."""
    ways = [1]
    for i in range(1, m + 1):
        # choices of i among i + n values: times (1 - q^(n + i)) / (1 - q^i), in whole numbers
        ways = ways + [0] * n
        longer = [w - (ways[k - n - i] if k >= n + i else 0) for k, w in enumerate(ways)]
        for k in range(i, len(longer)):
            longer[k] += longer[k - i]
        ways = longer
    below = list(accumulate(ways))
    total = below[-1]
    return pd.DataFrame({"m": m, "n": n, "u": range(len(ways)), "low": [b / total for b in below], "high": [(total - b + w) / total for b, w in zip(below, ways, strict=True)]})
