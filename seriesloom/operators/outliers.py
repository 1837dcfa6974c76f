"""Outlier bounds, counts and treatments. Bounds are one row per group; AQE
decides at run time whether that table is small enough to broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.guards import clip, keep_between
from seriesloom.operators.quantiles import series_quantiles

KEYS = ("series_id",)


def iqr_bounds(df: DataFrame, keys: Sequence[str] = KEYS, multiplier: float = 1.5,
               minimum: int = 1, unbounded: bool = False) -> DataFrame:
    """``lower``/``upper`` from the interquartile range; NULL below ``minimum`` rows."""
    q = series_quantiles(df, keys, "value", (0.25, 0.75), unbounded)
    spread = (F.col("q1") - F.col("q0")) * multiplier
    out = q.select(*keys, (F.col("q0") - spread).alias("lower"), (F.col("q1") + spread).alias("upper"))
    if minimum > 1:
        n = df.groupBy(*keys).agg(F.count("value").alias("_n"))
        big = F.col("_n") >= minimum
        out = out.join(n, list(keys)).select(
            *keys, F.when(big, F.col("lower")).alias("lower"), F.when(big, F.col("upper")).alias("upper")
        )
    return out


def zscore_bounds(df: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 3.0,
                  population: bool = False) -> DataFrame:
    """Mean and spread bounds; a constant series gets NULL bounds (no clipping)."""
    sd = F.stddev_pop("value") if population else F.stddev_samp("value")
    agg = df.groupBy(*keys).agg(F.avg("value").alias("mean"), sd.alias("sd"))
    usable = F.col("sd") > 0
    return agg.select(
        *keys, "mean", "sd",
        F.when(usable, F.col("mean") - threshold * F.col("sd")).alias("lower"),
        F.when(usable, F.col("mean") + threshold * F.col("sd")).alias("upper"),
    )


def iqr_report(df: DataFrame, unbounded: bool = False) -> DataFrame:
    """Outlier count and ratio; the ratio's denominator includes missing values."""
    joined = df.join(iqr_bounds(df, unbounded=unbounded), "series_id")
    v = F.col("value")
    return joined.groupBy("series_id").agg(
        F.count_if((v < F.col("lower")) | (v > F.col("upper"))).alias("outlier_count"),
        F.count(F.lit(1)).alias("n_rows"),
        F.first("lower").alias("lower_bound"),
        F.first("upper").alias("upper_bound"),
    ).withColumn("outlier_ratio", F.col("outlier_count") / F.col("n_rows"))


def zscore_report(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Outlier count and ratio; the ratio's denominator is the non-null length."""
    joined = df.join(zscore_bounds(df, threshold=threshold), "series_id")
    z = F.abs((F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))
    agg = joined.groupBy("series_id").agg(
        F.count_if(z > threshold).alias("outlier_count"),
        F.count("value").alias("n_values"),
        F.first("mean").alias("mean"), F.first("sd").alias("sd"),
        F.coalesce(F.first("lower"), F.first("mean")).alias("lower_bound"),
        F.coalesce(F.first("upper"), F.first("mean")).alias("upper_bound"),
    )
    return agg.withColumn(
        "outlier_ratio", F.when(F.col("n_values") > 0, F.col("outlier_count") / F.col("n_values")).otherwise(0.0)
    )


def treat_outliers(df: DataFrame, strategy: str, keys: Sequence[str] = KEYS,
                   population: bool = False, unbounded: bool = False) -> DataFrame:
    """Apply clip / winsorize / zscore_clip / remove / none per group.

    ``population=True`` is the training-window form (population spread);
    ``unbounded=True`` is for raw rows, whose groups fit no single buffer.
    """
    if strategy == "none":
        return df
    if strategy in ("clip", "winsorize", "remove"):
        bounds = iqr_bounds(df, keys, unbounded=unbounded)
    elif strategy == "zscore_clip":
        bounds = zscore_bounds(df, keys, population=population)
    else:
        raise ValueError(f"Unsupported outlier strategy: {strategy}")
    act = keep_between if strategy == "remove" else clip
    # left: a group without values has no split bounds and stays as it is
    joined = df.join(bounds.select(*keys, "lower", "upper"), list(keys), "left")
    treated = act(F.col("value"), F.col("lower"), F.col("upper"))
    return joined.withColumn("value", treated).drop("lower", "upper")


def winsorise(df: DataFrame, keys: Sequence[str] = KEYS, multiplier: float = 1.5) -> DataFrame:
    """IQR clipping that needs at least four observations."""
    bounds = iqr_bounds(df, keys, multiplier, minimum=4)
    joined = df.join(bounds, list(keys))
    return joined.withColumn("value", clip(F.col("value"), F.col("lower"), F.col("upper"))).drop(
        "lower", "upper"
    )
