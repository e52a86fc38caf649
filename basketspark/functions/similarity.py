"""Similarity of names: normalised indel distance, plain and with sorted words.

The share of two texts that their longest common subsequence covers, 2 * LCS / (|a| + |b|),
found bit-parallel in Arrow batches. It is declared nondeterministic so that a filter on it
isn't evaluated a second time; cheap predicates belong before it.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    open_ = mask
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & mask
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 0.0


def score(a: str | None, b: str | None) -> float:
    """0 for empty or hopelessly unequal texts, 1 for equal ones, else the better of both ratios."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if 2 * len(short) / (len(a) + len(b)) < 0.35 and f" {short} " not in f" {long_} ":
        return 0.0
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return max(ratio(a, b), ratio(x, y))


@functools.lru_cache(1 << 17)
def _remembered(a: str | None, b: str | None) -> float:
    """The score; names come in many pairs of offers, so a worker keeps the pairs it has seen last."""
    return score(a, b)


@F.pandas_udf(DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_remembered(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


_score = _score.asNondeterministic()


def fuzzy_score(a: Column, b: Column) -> Column:
    return _score(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """The plain ratio by built-in functions alone; for checks on few rows."""
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    chars = F.filter(F.split(a, ""), lambda c: c != "")

    def step(state: Column, c: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda out, j: F.array_append(
                out,
                F.when(F.substring(b, j, F.lit(1)) == c, F.element_at(state, j) + 1).otherwise(F.greatest(F.element_at(state, j + 1), F.element_at(out, j))),
            ),
        )

    lcs = F.element_at(F.aggregate(chars, row, step), -1)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 2.0 * lcs / (F.length(a) + F.length(b))).otherwise(0.0)
