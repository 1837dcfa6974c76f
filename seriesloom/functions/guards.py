"""NULL-safe numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL: a missing value has one encoding."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clip(c: Column, lower: Column, upper: Column) -> Column:
    """Clamp to bounds; a missing value or missing bound leaves the input."""
    return (
        F.when(c.isNull() | lower.isNull() | upper.isNull(), c)
        .when(c < lower, lower)
        .when(c > upper, upper)
        .otherwise(c)
    )


def keep_between(c: Column, lower: Column, upper: Column) -> Column:
    """NULL outside the bounds; missing bounds leave the input."""
    return F.when(lower.isNull() | upper.isNull() | c.between(lower, upper), c)


def label_or_na(c: Column, digits: int = 4) -> Column:
    """Fixed-decimal text, or the phrase used for unavailable evidence."""
    return F.coalesce(F.format_string(f"%.{digits}f", c), F.lit("not available"))


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected sample skewness (Spark's built-in is the population form)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
