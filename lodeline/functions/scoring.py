"""Column functions for set scores, bands and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimals, halves up towards plus infinity, on binary doubles (``round`` goes through decimals and halves away from zero)."""
    return F.floor(x * 100 + 0.5) / 100


def f1(hits: Column, picked: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall from counts: 1 when both sets are empty, 0 when one is."""
    return F.when((picked == 0) & (truth == 0), F.lit(1.0)).when(hits == 0, F.lit(0.0)).otherwise(2.0 * hits / F.greatest(picked + truth, F.lit(1)))


def score_sets(picked: Column, truth: Column) -> Column:
    """``precision, recall, score`` of two arrays taken as sets."""
    p, t = F.array_distinct(picked), F.array_distinct(truth)
    h = F.size(F.array_intersect(p, t))
    part = lambda a, b, other: F.when(b > 0, a / F.greatest(b, F.lit(1))).when(other == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(part(h, F.size(p), F.size(t)).alias("precision"), part(h, F.size(t), F.size(p)).alias("recall"), f1(h, F.size(p), F.size(t)).alias("score"))


def band(score: Column) -> Column:
    """Grade of a score: S from .95, A from .78, B from .6, C from .5, else none."""
    return F.when(score >= 0.95, "S").when(score >= 0.78, "A").when(score >= 0.6, "B").when(score >= 0.5, "C").otherwise("-")


def surprise(truth: Column, naive: Column) -> Column:
    """How far a naive guess is from the truth: the symmetric difference over the truth, 1 at most; 0 for two empty sets."""
    n = F.size(F.array_except(truth, naive)) + F.size(F.array_except(naive, truth))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / F.greatest(F.size(F.array_distinct(truth)), F.lit(1))))


def log_share(value: Column, most: Column) -> Column:
    """``ln(1 + value) / ln(1 + most)`` within 0 and 1; 0 when there is nothing to compare with."""
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(value) / F.log1p(F.greatest(most, F.lit(1))))))


def difficulty(breadth: Column, reach: Column, surprised: Column) -> Column:
    """A quarter breadth, a quarter reach, half surprise; two decimals."""
    x = 0.25 * breadth + 0.25 * reach + 0.5 * surprised
    return round2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
