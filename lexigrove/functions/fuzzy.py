"""Similarity of strings as vectorised functions: longest common subsequences by bit-parallel arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence by the lengths; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * common_length(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 where one's words are among the other's; else the best ratio of common words and rests."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    best = ratio(left, right) if not both else ratio(f"{both} {left}", f"{both} {right}")
    if both:
        best = max(best, ratio(both, f"{both} {left}"), ratio(both, f"{both} {right}"))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of its length of the longer, also over its ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    spans = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, s) for s in spans)


def _vectorised(f):
    @F.pandas_udf(T.DoubleType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return column


ratio_of, token_sort_of, token_set_of, partial_of = map(_vectorised, (ratio, token_sort_ratio, token_set_ratio, partial_ratio))
