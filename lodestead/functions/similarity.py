"""String similarity in 0-100, on Arrow batches of pairs.

``ratio`` is twice the longest common subsequence over both lengths; token sort
compares sorted lower-case words; partial takes the best window of the longer
string that is as long as the shorter. An empty string scores 0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")


def common_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyro 2004)."""
    if not a or not b:
        return 0
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return (~row & full).bit_count()


def ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return round(200 * common_length(a, b) / (len(a) + len(b)))


def token_sort_ratio(a: str, b: str) -> int:
    a, b = (" ".join(sorted(_WORD.findall(x.lower()))) for x in (a, b))
    return ratio(a, b)


def partial_ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100
    return max(ratio(short, long[i:i + len(short)]) for i in range(len(long) - len(short) + 1))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("ratio", "token_sort", "partial")]))
def similarity(norm_a: pd.Series, norm_b: pd.Series, name_a: pd.Series, name_b: pd.Series) -> pd.DataFrame:
    """The three scores of each pair: of the normal forms, and of the names as written."""
    rows = [(ratio(x, y), token_sort_ratio(a, b), partial_ratio(a, b))
            for x, y, a, b in zip(norm_a, norm_b, name_a, name_b, strict=True)]
    return pd.DataFrame(rows, columns=["ratio", "token_sort", "partial"])
