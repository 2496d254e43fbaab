"""Metric expressions and grouped metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold members found in the first k ranked; 0 for an empty gold set."""
    want = F.array_distinct(gold)
    got = F.size(F.array_intersect(F.slice(ranked, 1, k), want))
    return F.when(F.size(want) > 0, got / F.size(want)).otherwise(F.lit(0.0))


def rank_of(ranked: Column, owner: Column) -> Column:
    """1-based position of the owner, 0 when it is absent."""
    return F.coalesce(F.array_position(ranked, owner), F.lit(0)).cast("int")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% interval of k successes in n trials; (0, 1) for n = 0."""
    m, z2 = F.nullif(n, F.lit(0)).cast("double"), z * z
    p = k / m
    denom = F.lit(1.0) + F.lit(z2) / m
    center = (p + F.lit(z2) / (m * 2)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(z2) / (F.lit(4.0) * m * m)) / denom
    lo = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), center - half))
    hi = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), center + half))
    return lo, hi


def reliability(answered: Column, answerable: Column, correct: Column, c: float) -> Column:
    """Per-record effective reliability at penalty c."""
    return (F.when(answered & answerable & correct, F.lit(1.0)).when(answered, F.lit(-c))
            .when(answerable, F.lit(0.0)).otherwise(F.lit(1.0)))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den with a stated value for an empty subset."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty).cast("double"))
