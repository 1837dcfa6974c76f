"""Materialise a reused intermediate once, in storage every executor can reach.

A panel is far smaller than the rows it summarises, and diagnostics read it
several times. Without a stage each branch would scan and aggregate the raw
table again. The stage is a parquet table under ``spark.checkpoint.dir``: it
survives lost executors, keeps column pruning, and gives the optimiser real
sizes for its join choices.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """Shared folder of the session; a temporary one only for a local master without setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="seriesloom-stage-"))
    return _LOCAL_DIR[0]


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    # plain values: a join takes the size of files for the size of rows, and would broadcast a packed table
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
