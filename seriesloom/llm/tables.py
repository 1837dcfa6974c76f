"""Small Spark helpers of the text operators: table access, Arrow batch size, range buckets, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.staging import stage

BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """Ask for Arrow batches of at most ``size`` bytes, so that a batch of long texts fits a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions of the session, which the cluster sets by data size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, key: str, count: int) -> list[int]:
    """At most ``count - 1`` ascending key values that cut the table into parts of similar row counts.

    One column is scanned; the sketch and the list have a fixed size.
    """
    if count < 2:
        return []
    cuts = [i / count for i in range(1, count)]
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, cuts)), F.lit(20 * count)).alias("b")).first()
    return sorted({int(x) for x in (found and found["b"]) or []})


def bucket(key: str, cuts: list[int]) -> Column:
    """Part of a row: how many cuts lie below its key; null keys come first."""
    if not cuts:
        return F.lit(0)
    level = [F.when(F.col(key) > c, i + 1) for i, c in reversed(list(enumerate(cuts)))]
    return F.coalesce(*level, F.lit(0)) if len(cuts) <= 64 else F.coalesce(
        F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))), F.lit(0))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for undirected ``edges`` (a, b): root is the smallest node reachable.

    Rounds of large-star and small-star contraction. Each round is written to
    the shared folder, so a lost executor costs one round.
    """
    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(low, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    now, before = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before is not None and (mark["n"], mark["s"]) == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = (mark["n"], mark["s"])
        now = stage(star(star(now, True), False), label)
