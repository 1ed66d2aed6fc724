"""String similarities as Columns; only the edit similarity needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def _lcs(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (|a| + |b|) by bit-parallel LCS in Arrow batches; two empty strings are alike (1). Nested native
    expressions for the table of the LCS took minutes to plan and run on a handful of pairs."""
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2.0 * _lcs(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")


def _osa(a: str, b: str, most: int) -> int:
    """Edits of single characters and swaps of neighbours that make b of a; most + 1 if there are more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits with swaps of neighbours, up to most + 1, in Arrow batches. It is for pairs that an index found."""
    @F.pandas_udf(LongType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _osa(p, q, most) for p, q in zip(x, y)], dtype="Int64")

    return run(a, b)


def deletions(c: Column, most: int, keep: int = 0, reach: int = 10) -> Column:
    """The distinct strings that deleting up to `most` characters gives of the first keep + reach ones, the first `keep`
    staying. Two strings within `most` edits or swaps that begin with the same `keep` characters have one in common:
    what an edit shifts over the end of one's beginning is deleted there instead."""
    def less(x: Column) -> Column:
        return F.when(F.length(x) > keep, F.transform(F.sequence(F.lit(keep + 1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), x.substr(i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))

    got = last = F.array(F.substring(c, 1, keep + reach))
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        got = F.array_union(got, last)
    return got


def ratio_possible(a: Column, b: Column, least: float) -> Column:
    """A bound that costs nothing: the shorter length limits the common subsequence."""
    la, lb = F.length(a), F.length(b)
    return F.lit(2.0) * F.least(la, lb) >= F.lit(least) * (la + lb)


def common_possible(a: Column, b: Column, least: float) -> Column:
    """A bound from the characters alone: the distinct characters that only one string has can't be in a common
    subsequence."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    la, lb = F.length(a), F.length(b)
    most = F.least(la - F.size(F.array_except(x, y)), lb - F.size(F.array_except(y, x)))
    return F.lit(2.0) * most >= F.lit(least) * (la + lb)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of two strings' trigrams; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def bm25_term(tf: Column, length: Column, mean_length: Column, df: Column, n: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's BM25 score in a field."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
