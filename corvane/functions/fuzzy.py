"""String similarity that Spark has no function for (F20), in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence by the length of both; 100 for two empty texts."""
    return 200.0 * longest_common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """``ratio`` of the texts with their words in order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


class NameTable:
    """Names laid out so that ``token_sort_ratio`` of a value with all of them takes a few array operations a character."""

    def __init__(self, names: list[str]) -> None:
        sorted_names = [" ".join(sorted(n.split())) for n in names]
        self.n, self.size = len(names), np.array([len(x) for x in sorted_names], dtype=np.int64)
        # names of one, two, three … machine words apart, so that a long one doesn't slow down the short ones
        self.parts = []
        words = np.maximum(1, -(-self.size // 64))
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            bits: dict[str, np.ndarray] = {}
            for k, i in enumerate(at):
                for j, c in enumerate(sorted_names[i]):
                    if c not in bits:
                        bits[c] = np.zeros((w, len(at)), dtype=np.uint64)
                    bits[c][j // 64, k] |= np.uint64(1 << j % 64)
            self.parts.append((at, int(w), bits))

    def scores(self, value: str) -> np.ndarray:
        """``token_sort_ratio`` of the value with each name."""
        value = " ".join(sorted(value.split()))
        common = np.zeros(self.n, dtype=np.int64)
        for at, w, bits in self.parts:
            s = np.full((w, len(at)), np.uint64(2**64 - 1))
            for c in value:
                m = bits.get(c)
                if m is None:
                    continue
                u = s & m
                t = s + u
                for k in range(1, w):  # what the sum of a word carries goes to the next one
                    carry = (t[k - 1] < s[k - 1]) if k == 1 else (t[k - 1] < s[k - 1]) | carry & (t[k - 1] == s[k - 1])
                    t[k] += carry
                s = t | (s - u)
            common[at] = 64 * w - np.bitwise_count(s).sum(axis=0, dtype=np.int64)
        total = self.size + len(value)
        return np.where(total > 0, 200.0 * common / np.maximum(1, total), 100.0)


def _column(measure):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(batch, "double")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """``ratio`` of two columns."""
    return _column(ratio)(a, b)


def fuzzy_token_sort_ratio(a: Column, b: Column) -> Column:
    """``token_sort_ratio`` of two columns."""
    return _column(token_sort_ratio)(a, b)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a lower-cased text with a blank before and after, for blocking."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3))))


