"""Exact per-series quantiles, also for a series too large for one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPLITS = 999


def list_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array, as the exact aggregate gives it; NULL when empty."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(lo == hi, F.get(ordered, lo)).otherwise((hi - at) * F.get(ordered, lo) + (at - lo) * F.get(ordered, hi))


def series_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                     probs: Sequence[float], unbounded: bool = False) -> DataFrame:
    """``keys + q0..qk``: linear-interpolation quantiles of the non-null values.

    The built-in exact aggregate keeps every distinct value of a group in one
    buffer. That suits a gridded series. ``unbounded=True`` is for raw rows: a
    sketch splits each series into about a thousand value ranges, counts locate
    the range that holds each wanted rank, and only those ranges are ordered.
    """
    names = [f"q{i}" for i in range(len(probs))]
    if not unbounded:
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(value), F.lit(float(p))).alias(n) for n, p in zip(names, probs)]
        )
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = [i / (_SPLITS + 1) for i in range(1, _SPLITS + 1)]
    split = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n")
    )
    distinct = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # number of cuts below the value, by halving steps over the sorted cuts
    steps = F.lit([512, 256, 128, 64, 32, 16, 8, 4, 2, 1])
    below = F.aggregate(steps, F.lit(0), lambda p, s: F.when(
        (p + s <= F.size("_cuts")) & (F.get("_cuts", p + s - 1) < F.col("_v")), p + s).otherwise(p))
    binned = distinct.join(split, list(keys)).withColumn("_bin", below)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_below", F.coalesce(F.sum("_m").over(w), F.lit(0)))
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 fn((F.col("_n") - 1) * F.lit(float(p))).cast("long").alias("r"))
        for i, p in enumerate(probs) for side, fn in (("lo", F.floor), ("hi", F.ceil))
    ])
    wanted = F.filter(
        ranks, lambda x: (x["r"] >= F.col("_below")) & (x["r"] < F.col("_below") + F.col("_m"))
    )
    need = bins.withColumn("_w", wanted).filter(F.size("_w") > 0).select(*keys, "_bin", "_below", "_w")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    cand = binned.select(*keys, "_bin", "_v", "_c", "_n").join(need, [*keys, "_bin"])
    cand = cand.withColumn("_lt", F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    hits = cand.select(*keys, "_v", "_c", "_n", "_lt", F.explode("_w").alias("_k")).filter(
        (F.col("_k.r") >= F.col("_lt")) & (F.col("_k.r") < F.col("_lt") + F.col("_c"))
    )
    outs = []
    for i, (name, p) in enumerate(zip(names, probs)):
        lo = F.max(F.when((F.col("_k.i") == i) & (F.col("_k.side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_k.i") == i) & (F.col("_k.side") == "hi"), F.col("_v")))
        h = (F.max("_n") - 1) * F.lit(float(p))
        outs.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return hits.groupBy(*keys).agg(*outs)
