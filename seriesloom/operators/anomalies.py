"""Robust anomaly flags and native change-point statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.rolling import rolling_moments
from seriesloom.operators.scans import running_sums

KEYS = ("series_id",)
_EPS = 2.220446049250313e-16


def mad_flags(resid: DataFrame, keys: Sequence[str] = KEYS, column: str = "resid",
              threshold: float = 3.5) -> DataFrame:
    """Flag residuals beyond ``threshold`` scaled deviations from the median.

    When the deviation scale is zero any value that differs from the median
    beyond rounding is flagged.
    """
    # both medians are windows of one exchange: the residuals, which may be costly, are made once
    w = Window.partitionBy(*keys)
    rows = resid.dropna(subset=list(keys)).withColumn("_med", F.percentile(F.col(column), F.lit(0.5)).over(w))
    rows = rows.withColumn("_dev", F.abs(F.col(column) - F.col("_med")))
    rows = rows.withColumn("_mad", F.percentile("_dev", F.lit(0.5)).over(w))
    tolerance = F.lit(_EPS * 10) * F.greatest(F.lit(1.0), F.abs(F.col("_med")))
    hit = F.when(F.col("_mad") > 0, F.col("_dev") / (F.col("_mad") * 1.4826) > threshold).otherwise(
        F.col("_dev") > tolerance
    )
    kind = F.when(hit & (F.col(column) > F.col("_med")), "positive_spike").when(hit, "negative_spike")
    return rows.withColumn("anomaly", kind).drop("_med", "_mad", "_dev")


def anomaly_summary(flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, ratio and positions per class."""
    is_hit = F.col("anomaly").isNotNull()
    where = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("t"))))
    agg = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_hit).alias("anomaly_count"),
        where(is_hit).alias("positions"),
        where(F.col("anomaly") == "positive_spike").alias("positive_spike"),
        where(F.col("anomaly") == "negative_spike").alias("negative_spike"),
    )
    return agg.withColumn("anomaly_ratio", F.col("anomaly_count") / F.col("n")).withColumn(
        "status", F.when(F.col("n") >= 5, "ok").otherwise("not_estimable"))


def spaced(positions: Column, spacing: int) -> Column:
    """Keep the first position and then each one at least ``spacing`` later."""
    kept = F.aggregate(
        F.sort_array(positions), F.array().cast("array<bigint>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x - F.element_at(acc, -1) >= spacing), F.concat(acc, F.array(x.cast("bigint")))
        ).otherwise(acc),
    )
    return F.when(F.size(positions) > 0, kept).otherwise(F.array().cast("array<bigint>"))


def cusum(df: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Cumulative sum of centred values per row, with the series mean and spread."""
    stats = {"_mu": F.avg("value"), "sd": F.stddev_samp("value"), "n": F.count("value")}
    if block is None:
        whole = Window.partitionBy(*keys)
        rows = df.dropna(subset=list(keys)).withColumns({name: stat.over(whole) for name, stat in stats.items()})
    else:
        rows = df.join(df.groupBy(*keys).agg(*[stat.alias(name) for name, stat in stats.items()]), list(keys))
    return running_sums(rows, keys, "t", {"cusum": F.col("value") - F.col("_mu")}, block).drop("_mu")


def cusum_split(df: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Single-split statistic: position and size of the largest excursion (first on ties)."""
    rows = cusum(df, keys, block)
    peak = F.max(F.struct(F.abs(F.col("cusum")).alias("size"), (-F.col("t")).alias("neg"))).alias("_p")
    return rows.groupBy(*keys).agg(peak, F.first("n").alias("n")).select(
        *keys, "n", F.col("_p.size").alias("max_abs_cusum"), (-F.col("_p.neg")).alias("split_at"))


def change_points(df: DataFrame, method: str = "cusum", keys: Sequence[str] = KEYS,
                  threshold: float | None = None, block: int | None = None) -> DataFrame:
    """Uncalibrated threshold crossings, one row per flagged position.

    ``cusum`` above two spreads, ``rolling_mean`` gap above one spread,
    ``fft`` (rolling variance) above the mean rolling variance plus a tenth of the spread.
    Series under ten rows give no rows.
    """
    stats = df.groupBy(*keys).agg(F.stddev_samp("value").alias("_sd"), F.count("value").alias("_n"))
    factor = {"cusum": 2.0, "rolling_mean": 1.0, "fft": 0.1}[method]
    limit = F.lit(threshold) if threshold is not None else factor * F.col("_sd")
    n = F.col("n")
    if method == "cusum":
        rows, size = cusum(df, keys, block), F.abs(F.col("cusum"))
        limit_over = limit
    elif method == "rolling_mean":
        short = rolling_moments(df, F.greatest(F.lit(3), F.floor(n / 10)), keys, True, block=block)
        wide = rolling_moments(df, F.greatest(F.lit(5), F.floor(n / 5)), keys, True, block=block)
        rows = short.select(*keys, "t", F.col("roll_mean").alias("_a")).join(
            wide.select(*keys, "t", F.col("roll_mean").alias("_b")), [*keys, "t"])
        size, limit_over = F.abs(F.col("_a") - F.col("_b")), limit
    else:
        rows = rolling_moments(df, F.greatest(F.lit(10), F.floor(n / 4)), keys, True, block=block)
        mean = rows.groupBy(*keys).agg(F.avg("roll_var").alias("_mv"))
        rows = rows.join(mean, list(keys))
        size, limit_over = F.col("roll_var"), F.col("_mv") + limit
    return rows.join(stats, list(keys)).filter((F.col("_n") >= 10) & (size > limit_over)).select(
        *keys, "t", size.alias("size"))


def variance_breaks(df: DataFrame, min_segment: int = 5, keys: Sequence[str] = KEYS,
                    block: int | None = None) -> DataFrame:
    """Spaced positions whose centred rolling variance exceeds mean + 3 spreads."""
    n = F.col("n")
    rolled = rolling_moments(df, F.greatest(F.lit(min_segment), F.floor(n / 10)), keys, True, block=block)
    rolled = rolled.filter(n >= 3 * min_segment)
    level = rolled.groupBy(*keys).agg(F.avg("roll_var").alias("_m"), F.stddev_pop("roll_var").alias("_s"))
    hits = rolled.join(level, list(keys)).filter(
        (F.col("_s") > 0) & (F.col("roll_var") > F.col("_m") + 3 * F.col("_s")))
    found = hits.groupBy(*keys).agg(spaced(F.collect_list("t"), min_segment).alias("variance_breaks"))
    every = df.select(*keys).distinct()
    empty = F.array().cast("array<bigint>")
    return every.join(found, list(keys), "left").withColumn(
        "variance_breaks", F.coalesce("variance_breaks", empty))
