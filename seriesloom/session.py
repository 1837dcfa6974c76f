"""Spark session settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change plans, not results. Shuffle partitions are left to the
# cluster; AQE coalesces small ones and splits skewed ones.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, stage_dir: str | None = None) -> SparkSession:
    """Session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seriesloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    if stage_dir:
        builder = builder.config("spark.checkpoint.dir", stage_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
