"""Frequency inference as one aggregate per series.

A series is regular at a unit when its distinct stamps share one phase inside
the unit and their number equals the span of period ordinals. Neither needs an
ordered pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import epoch_micros, normalise_frequency, period_index, period_stamp

_DAY = 86_400_000_000


def _consecutive(unit: str) -> Column:
    idx = period_index(F.col("ts"), unit)
    return F.max(idx) - F.min(idx) + 1 == F.count(F.lit(1))


def _on_stamp(unit: str) -> Column:
    idx = period_index(F.col("ts"), unit)
    return F.bool_and(F.col("ts") == period_stamp(idx, unit))


def regular_frequency(panel: DataFrame) -> DataFrame:
    """``(series_id, distinct_stamps, inferred)``; NULL when not perfectly regular."""
    stamps = panel.select("series_id", "ts").distinct()
    micros = epoch_micros(F.col("ts"))
    tod, hour_phase = F.pmod(micros, F.lit(_DAY)), F.pmod(micros, F.lit(_DAY // 24))
    dow = F.dayofweek("ts")
    same = lambda c: F.min(c) == F.max(c)
    tests = stamps.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("distinct_stamps"),
        (_consecutive("YS") & _on_stamp("YS")).alias("ys"),
        (_consecutive("QS") & _on_stamp("QS")).alias("qs"),
        (_consecutive("MS") & _on_stamp("MS")).alias("ms"),
        (_consecutive("MS") & F.bool_and(F.last_day("ts") == F.col("ts").cast("date")) & same(tod)).alias("me"),
        (_consecutive("W") & same(dow) & same(tod)).alias("w"),
        (_consecutive("D") & same(tod)).alias("d"),
        (_consecutive("B") & F.bool_and(dow.between(2, 6)) & same(tod)).alias("b"),
        (_consecutive("h") & same(hour_phase)).alias("h"),
    )
    alias = F.when(F.col("distinct_stamps") < 3, F.lit(None).cast("string"))
    for flag, name in (("d", "D"), ("h", "h"), ("w", "W"), ("b", "B"),
                       ("ys", "YS"), ("qs", "QS"), ("ms", "MS"), ("me", "ME")):
        alias = alias.when(F.col(flag), name)
    return tests.select("series_id", "distinct_stamps", alias.alias("inferred"))


def median_gap_days(panel: DataFrame) -> DataFrame:
    """Median of whole-day gaps between consecutive rows (exact).

    Rows of one day are less than a day apart, so they only add zeros: a count
    with the first and last stamp per (series, day) is enough. The rows are
    never ordered; the window runs over occupied days, which a calendar bounds.
    """
    us = epoch_micros(F.col("ts"))
    days = panel.groupBy("series_id", F.col("ts").cast("date").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(us).alias("_a"), F.max(us).alias("_b"))
    before = F.lag("_b").over(Window.partitionBy("series_id").orderBy("_day"))
    days = days.withColumn("_gap", F.floor((F.col("_a") - before) / F.lit(_DAY)))
    weighted = days.select("series_id", F.inline(F.array(
        F.struct(F.col("_gap").alias("gap"), F.lit(1).cast("long").alias("times")),
        F.struct(F.lit(0).cast("long").alias("gap"), (F.col("_n") - 1).alias("times")))))
    usable = weighted.filter(F.col("gap").isNotNull() & (F.col("times") > 0))
    median = usable.groupBy("series_id").agg(F.percentile("gap", F.lit(0.5), F.col("times")).alias("median_days"))
    return panel.select("series_id").distinct().join(median, "series_id", "left")


def infer_frequency(panel: DataFrame) -> DataFrame:
    """Resolved frequency: the regular alias, else a bucket of the median gap."""
    regular = regular_frequency(panel)
    gaps = median_gap_days(panel)
    m = F.col("median_days")
    fallback = (
        F.when(m.isNull(), "MS").when(m <= 1, "D").when(m <= 7, "W")
        .when(m <= 31, "MS").when(m <= 92, "QS").otherwise("YS")
    )
    return regular.join(gaps, "series_id").select(
        "series_id", "inferred", "median_days",
        F.coalesce(normalise_frequency_or_null(F.col("inferred")), fallback).alias("frequency"),
    )


def normalise_frequency_or_null(alias: Column) -> Column:
    return F.when(alias.isNotNull(), normalise_frequency(alias))
