"""Jaro-Winkler similarity as an Arrow-batched pandas UDF.

Spark has no built-in. The search plans call it on *distinct* (query term, vocabulary token) pairs
only, never on the rows of the page table, so its cost is bounded by vocabulary x query terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1, max_prefix: int = 4,
                 boost_threshold: float = 0.7) -> float:
    if a is None or b is None:
        return None
    # compared on UTF-8 bytes, like the SQL engines' built-in
    a, b = a.encode("utf-8"), b.encode("utf-8")
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(max(la, lb) // 2 - 1, 0)
    a_hit = [False] * la
    b_hit = [False] * lb
    matches = 0
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not b_hit[j] and b[j] == ch:
                a_hit[i] = b_hit[j] = True
                matches += 1
                break
    if matches == 0:
        return 0.0
    half_transpositions = 0
    j = 0
    for i in range(la):
        if a_hit[i]:
            while not b_hit[j]:
                j += 1
            if a[i] != b[j]:
                half_transpositions += 1
            j += 1
    m = float(matches)
    # transpositions = half of the out-of-order matches, rounded down
    jaro = (m / la + m / lb + (m - half_transpositions // 2) / m) / 3.0
    if jaro <= boost_threshold:
        return jaro
    prefix = 0
    for x, y in zip(a[:max_prefix], b[:max_prefix]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * prefix_weight * (1.0 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
