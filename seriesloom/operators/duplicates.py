"""Duplicate timestamps: resolution by mergeable aggregates, no ordering of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_duplicates(panel: DataFrame, strategy: str) -> DataFrame:
    """One row per (series, stamp).

    Each strategy is a partial+final aggregate, so a stamp holding a third of
    the table is combined map-side. ``seq`` is the ingest ordinal.
    """
    rules = {
        "keep-first": F.min_by("value", "seq"),
        "latest": F.max_by("value", "seq"),
        "mean": F.avg("value"),
        # an all-missing group sums to zero
        "sum": F.coalesce(F.sum("value"), F.lit(0.0)),
    }
    if strategy not in rules:
        raise ValueError(f"Unsupported duplicate strategy: {strategy}")
    return panel.groupBy("series_id", "ts").agg(rules[strategy].alias("value"))


def flag_duplicates(panel: DataFrame, keep: str = "first") -> DataFrame:
    """Mark every copy but the kept one; copies are never sorted in one task."""
    pick = F.min("seq") if keep == "first" else F.max("seq")
    kept = panel.groupBy("series_id", "ts").agg(pick.alias("_kept"))
    joined = panel.join(kept, ["series_id", "ts"])
    return joined.withColumn("is_duplicate", F.col("seq") != F.col("_kept")).drop("_kept")
