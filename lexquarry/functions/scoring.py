"""Scores of matches as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_score(distance: Column, length: Column) -> Column:
    """20 / (20 + distance / length)."""
    return F.lit(20.0) / (F.lit(20.0) + distance / length)


def typo_score(factor: Column, length: Column) -> Column:
    """1 - min(factor / length, 1)."""
    return F.lit(1.0) - F.least(factor / length, F.lit(1.0))


def idf_weight(n: Column, df: Column) -> Column:
    """ln(1 + (max(n, df) - df + 0.5) / (df + 0.5))."""
    return F.log(F.lit(1.0) + (F.greatest(n, df) - df + F.lit(0.5)) / (df + F.lit(0.5)))


def typo_factor(size: Column) -> Column:
    """Typos allowed for a word of so many bytes."""
    return F.when(size <= 3, 0).when(size <= 6, 1).when(size <= 9, 2).otherwise(3)


def overall_score(scores: Column, n_terms: Column) -> Column:
    """Mean over the query's terms of an array of scores, null for none."""
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n_terms
