"""Calendar grids and gap accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import block_for, period_index, period_stamp

_CHUNK = 4_096


def calendar_grid(panel: DataFrame, freq: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Every period between a series' first and last stamp, with ordinal ``t``.

    Bounds come from one partial aggregate; the ordinals are generated in two
    explodes so no row ever holds a whole long calendar.
    """
    bounds = panel.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    spans = bounds.select(
        *keys, period_index(F.col("_a"), freq).alias("_lo"), period_index(F.col("_b"), freq).alias("_hi")
    )
    starts = spans.withColumn("_s", F.explode(F.sequence("_lo", "_hi", F.lit(_CHUNK).cast("long"))))
    if block_for(freq) is not None:
        # a few long calendars would otherwise be generated by a few tasks
        starts = starts.repartition(*keys, "_s")
    cells = starts.withColumn(
        "_p", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + _CHUNK - 1, F.col("_hi"))))
    )
    return cells.select(*keys, (F.col("_p") - F.col("_lo")).alias("t"),
                        period_stamp(F.col("_p"), freq).alias("ts"))


def reindex(panel: DataFrame, freq: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Left-join the calendar to the rows: gaps become NULL, off-grid rows drop.

    The join key includes the stamp, so a dominant series spreads over all tasks.
    """
    grid = calendar_grid(panel, freq, keys)
    return grid.join(panel.select(*keys, "ts", "value"), [*keys, "ts"], "left").select(
        *keys, "t", "ts", "value"
    )


def missing_periods(panel: DataFrame, freq: str) -> DataFrame:
    """Missing and unexpected period counts, by arithmetic on period ordinals."""
    idx = period_index(F.col("ts"), freq)
    on_grid = F.col("ts") == period_stamp(idx, freq)
    stamps = panel.select("series_id", "ts").distinct()
    agg = stamps.groupBy("series_id").agg(
        F.min(idx).alias("_lo"),
        F.max(idx).alias("_hi"),
        F.count_if(on_grid).alias("_on"),
        F.count_if(~on_grid).alias("unexpected_periods"),
        F.count(F.lit(1)).alias("distinct_stamps"),
    )
    return agg.select(
        "series_id",
        F.when(F.col("distinct_stamps") < 2, F.lit(0).cast("long"))
        .otherwise(F.col("_hi") - F.col("_lo") + 1 - F.col("_on")).alias("missing_periods"),
        "unexpected_periods",
        ((F.col("_hi") - F.col("_lo") + 1 == F.col("_on")) & (F.col("unexpected_periods") == 0))
        .alias("is_regular"),
    )


def period_differences(panel: DataFrame, freq: str) -> tuple[DataFrame, DataFrame]:
    """Expected-but-absent stamps and present-but-unexpected stamps."""
    stamps = panel.select("series_id", "ts").distinct()
    grid = calendar_grid(panel, freq).select("series_id", "ts")
    return grid.join(stamps, ["series_id", "ts"], "left_anti"), stamps.join(
        grid, ["series_id", "ts"], "left_anti"
    )
