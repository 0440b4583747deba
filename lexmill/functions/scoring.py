"""Ranking scores as column expressions, each between 0 and 1 unless it says otherwise."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(x: float) -> Column:
    """A decimal, so that sums and products of such constants and whole numbers carry no error of doubles."""
    return F.lit(Decimal(str(x)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def consensus(queries: Column, providers: Column) -> Column:
    """Agreement of queries and providers that found a record; a decimal of whole numbers."""
    return exact(0.75) * F.least(exact(1.0), exact(0.2) + exact(0.25) * (queries - 1)) + exact(0.25) * F.least(exact(1.0), exact(0.5) * (providers - 1))


def completeness(present: dict[str, tuple[float, Column]]) -> Column:
    """Sum of the weights of the fields that are there."""
    return sum((F.when(ok, w).otherwise(0.0) for w, ok in present.values()), F.lit(0.0))


def impact(citations: Column) -> Column:
    return clamp(F.log10(F.greatest(citations, F.lit(0)) + 1) / 4)


def total(parts: dict[str, Column], weights: dict[str, float], penalty: Column) -> Column:
    """0 to 100, whole."""
    mean = sum((parts[k] * exact(w) for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round((mean - penalty) * 100, 0))).cast("int")


def level(score: Column) -> Column:
    return F.when(score >= 85, "P1").when(score >= 65, "P2").when(score >= 40, "P3").otherwise("P4")


def dispersion_penalty(title_tokens: Column, coverage: Column) -> Column:
    """Long titles that cover little of the query; a decimal."""
    return F.when(title_tokens >= 20, exact(0.05)).otherwise(exact(0.0)) + F.when((title_tokens >= 14) & (coverage < 1), exact(0.10)).otherwise(exact(0.0))


def curation_priority(n: Column, lexical: Column, unit: Column, extras: Column) -> Column:
    """0 to 100: at most 34 for volume, 28 for words, 20 for the unit, and extras."""
    return F.least(F.lit(100.0), F.least(F.lit(34.0), 13 * F.log10(n + 1)) + F.least(F.lit(28.0), lexical) + F.least(F.lit(20.0), unit) + extras)


def curation_band(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 45, "medium").when(score >= 28, "low").otherwise("none")
