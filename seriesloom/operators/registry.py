"""Run, report and usage registries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States after which a run may expire.
TERMINAL = ("completed", "failed", "cancelled")


def expired(now: Column, days: int, terminal=TERMINAL) -> Column:
    """True for terminal runs that completed more than ``days`` ago."""
    old = F.col("status").isin(*terminal) & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days)))
    return F.coalesce(old, F.lit(False))


def keep_recent_runs(runs: DataFrame, now: Column, days: int, terminal=TERMINAL) -> DataFrame:
    """Drop terminal runs that completed more than ``days`` ago."""
    return runs.filter(~expired(now, days, terminal))


def runs_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("runs"))


def recent_runs(runs: DataFrame, limit: int = 25) -> DataFrame:
    """Newest first; a bounded top-k, never a full sort."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def reports_per_owner(owners: DataFrame, reports: DataFrame) -> DataFrame:
    """Owners that have reports, with their number, ordered by lower-cased name."""
    counts = reports.groupBy("owner_id").agg(F.count(F.lit(1)).alias("reports"))
    return owners.join(counts, "owner_id").orderBy(F.lower("name"), "owner_id")


def over_limit(reports: DataFrame, limit: int) -> DataFrame:
    """Report count per owner against the allowed number."""
    return reports.groupBy("owner_id").agg(F.count(F.lit(1)).alias("reports")).withColumn(
        "at_limit", F.col("reports") >= limit)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Token usage per agent plus the grand total (``agent`` NULL)."""
    return usage.rollup("agent").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.bool_or("estimated").alias("estimated"))
