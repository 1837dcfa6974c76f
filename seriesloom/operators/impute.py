"""Missing-value filling on a gridded panel (columns ``t``, ``ts``, ``value``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import epoch_micros
from seriesloom.operators.scans import neighbours

KEYS = ("series_id",)


def _between(axis: str) -> Column:
    """Linear value at this row's axis position between its two neighbours."""
    p, n, x = F.col("prev"), F.col("next"), F.col(axis)
    return p["value"] + (n["value"] - p["value"]) * ((x - p[axis]) / (n[axis] - p[axis]))


def forward_fill(df: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None,
                 backfill: bool = False, block: int | None = None) -> DataFrame:
    """Carry the last observation forward, at most ``limit`` positions."""
    rows = neighbours(df, keys, "t", "value", block=block)
    prev = F.col("prev.value")
    if limit is not None:
        prev = F.when(F.col("t") - F.col("prev.t") <= limit, prev)
    parts = [F.col("value"), prev] + ([F.col("next.value")] if backfill else [])
    return rows.withColumn("value", F.coalesce(*parts)).drop("prev", "next")


def backward_fill(df: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Carry the next observation backward."""
    rows = neighbours(df, keys, "t", "value", block=block)
    return rows.withColumn("value", F.coalesce("value", "next.value")).drop("prev", "next")


def interpolate_time(df: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None,
                     edges: bool = False, block: int | None = None) -> DataFrame:
    """Time-weighted interpolation; the tail repeats the last value, the head stays NULL.

    ``edges=True`` also back-fills the head.
    """
    rows = df.withColumn("_us", epoch_micros(F.col("ts")))
    rows = neighbours(rows, keys, "t", "value", payload=["_us"], block=block)
    inner = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), _between("_us"))
    filled = F.coalesce(inner, F.col("prev.value"))
    if limit is not None:
        filled = F.when(F.col("t") - F.col("prev.t") <= limit, filled)
    # after a limited fill the remaining gap is closed by plain forward/back fill
    parts = [F.col("value"), filled]
    if edges:
        parts += [F.col("prev.value"), F.col("next.value")]
    return rows.withColumn("value", F.coalesce(*parts)).drop("prev", "next", "_us")


def interpolate_position(df: DataFrame, keys: Sequence[str] = KEYS,
                         block: int | None = None) -> DataFrame:
    """Position-weighted interpolation, both edges filled (training-window form)."""
    rows = neighbours(df, keys, "t", "value", block=block)
    filled = F.coalesce(F.col("value"), _between("t"), F.col("prev.value"), F.col("next.value"))
    return rows.withColumn("value", filled).drop("prev", "next")


def impute_training(df: DataFrame, method: str = "interpolate", keys: Sequence[str] = KEYS,
                    block: int | None = None) -> DataFrame:
    """Training-window imputer; an unknown method means ``interpolate``."""
    if method == "drop":
        return df.filter(F.col("value").isNotNull())
    if method == "forward-fill":
        return forward_fill(df, keys, backfill=True, block=block)
    return interpolate_position(df, keys, block=block)


def fill_future_inputs(train: DataFrame, future: DataFrame, keys: Sequence[str] = KEYS,
                       method: str = "interpolate") -> DataFrame:
    """Fill future covariate-like values with the last observed training value."""
    if method == "drop":
        return future
    last = train.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.max_by("value", "t").alias("_last")
    )
    return future.join(last, list(keys), "left").withColumn(
        "value", F.coalesce("value", "_last")
    ).drop("_last")
