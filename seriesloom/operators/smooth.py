"""Smoothing of a gap-free gridded panel."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.levels import affine_carry
from seriesloom.operators.scans import _BLK, framed, in_blocks
from pyspark.sql import Window

KEYS = ("series_id",)


def ewm(df: DataFrame, alpha: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recursive exponential mean started at the first value (``adjust=False``).

    Inside a block the recursion is a decayed prefix sum; across blocks only the
    block's end level is carried, by composing the blocks as affine maps. The block is short enough that the decay
    factors stay representable.
    """
    decay = 1.0 - alpha
    block = max(8, min(512, int(300 / -math.log(decay)))) if decay > 0 else 512
    if decay <= 0:
        return df.withColumn("smoothed", F.col("value"))
    rows = in_blocks(df, keys, "t", block)
    i = F.pmod(F.col("t"), F.lit(block)).cast("double")
    weight = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    gain = weight * F.col("value") * F.pow(F.lit(decay), -i)
    ends = rows.groupBy(*keys, _BLK).agg(
        F.sum(gain).alias("_g"), F.max(i).alias("_i")
    ).withColumn("_local", F.col("_g") * F.pow(F.lit(decay), F.col("_i")))
    maps = ends.select(*keys, _BLK, F.pow(F.lit(decay), F.col("_i") + 1).alias("a"), F.col("_local").alias("b"))
    carry = affine_carry(maps, keys).withColumnRenamed("x", "_carry")
    w = Window.partitionBy(*keys, _BLK).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(gain).over(w) * F.pow(F.lit(decay), i) + F.col("_carry") * F.pow(F.lit(decay), i + 1)
    return rows.join(carry, [*keys, _BLK]).withColumn("smoothed", level).drop(_BLK, "_carry")


def span_alpha(span: int = 6) -> float:
    return 2.0 / (span + 1.0)


def _hat(window: int, degree: int) -> list[list[float]]:
    """Projection matrix of a local polynomial fit; row j evaluates point j."""
    x = np.vander(np.arange(window, dtype=float) - window // 2, degree + 1)
    return (x @ np.linalg.pinv(x)).tolist()


def _window_for(n: int, window: int, degree: int) -> int | None:
    """Odd window that fits a series of ``n`` rows; NULL when too short."""
    if n < 3:
        return None
    w = min(window, n)
    w += w % 2 == 0
    if w > n:
        w -= 2
    return w if w > degree else None


def savgol(df: DataFrame, window: int = 11, degree: int = 2, keys: Sequence[str] = KEYS,
           block: int | None = None) -> DataFrame:
    """Local polynomial smoothing; edges use the fit of the first / last window.

    The projection weights are constants of the plan. A series shorter than the
    window uses the largest odd window that fits.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(sizes, list(keys))
    top = window + (window % 2 == 0)
    frame = lambda w: w.rowsBetween(-(top - 1), top - 1)
    near = framed(
        rows, keys, "t", top - 1, top - 1,
        lambda w: {"_near": F.collect_list(F.struct("t", "value")).over(frame(w))}, block,
    )
    smoothed: Column = F.lit(None).cast("double")
    fits = sorted({w for n in range(3, window + 2) if (w := _window_for(n, window, degree))})
    by_size = {}
    for n in range(1, window + 1):
        by_size.setdefault(_window_for(n, window, degree), []).append(n)
    for w in fits:
        half = w // 2
        start = F.greatest(F.lit(0), F.least(F.col("t") - half, F.col("_n") - w))
        points = F.filter("_near", lambda p: (p["t"] >= start) & (p["t"] < start + w))
        weights = F.lit(_hat(w, degree))[(F.col("t") - start).cast("int")]
        dot = F.aggregate(
            F.zip_with(points, weights, lambda p, k: p["value"] * k), F.lit(0.0), lambda a, x: a + x
        )
        sizes_here = by_size.get(w, [])
        cond = F.col("_n").isin(sizes_here) if sizes_here else F.lit(False)
        if w == max(fits):
            cond = cond | (F.col("_n") > window)
        smoothed = F.when(cond, dot).otherwise(smoothed)
    return near.withColumn("smoothed", F.coalesce(smoothed, F.col("value"))).drop("_near", "_n")


def smooth(df: DataFrame, method: str, keys: Sequence[str] = KEYS, **params) -> DataFrame:
    """Dispatcher: ``ewma`` (span), ``savgol`` (window, degree) or ``none``; each group of ``keys`` on its own."""
    if method == "none":
        return df.withColumn("smoothed", F.col("value"))
    if method == "ewma":
        return ewm(df, span_alpha(params.get("span", 6)), keys)
    if method == "savgol":
        return savgol(df, params.get("window", 11), params.get("degree", 2), keys)
    raise ValueError(f"Unsupported smoothing method: {method}")
