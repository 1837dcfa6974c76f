"""Chunk tables, upserts and exact nearest neighbours over supplied vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.text import chunks
from seriesloom.operators.nearest import nearest_rows

def chunk_table(docs: DataFrame, key: Column, text: Column, size: int = 400, overlap: int = 80, **meta: Column) -> DataFrame:
    """One row per chunk with id ``key__i`` and metadata columns."""
    rows = docs.select(key.cast("string").alias("source"), *[v.alias(k) for k, v in meta.items()],
                       F.posexplode(chunks(text, size, overlap)).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", F.concat_ws("__", "source", F.col("chunk_index").cast("string")))


def text_files(spark, folder: str) -> DataFrame:
    """Whole text files of a folder with their stem as ``source``."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("_path", r"([^/]+)\.txt$", 1)
    return rows.select(stem.alias("source"), F.col("value").alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the last version wins."""
    latest = new
    if order is not None:
        cols = [c for c in new.columns if c != key]
        latest = new.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def metadata_filter(df: DataFrame, equals: dict[str, str]) -> DataFrame:
    """Conjunction of equality tests, applied before any distance is computed."""
    out = df
    for name, value in equals.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int = 3, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Exact ``k`` nearest rows per query (query_id, vector) by cosine similarity, for any number of queries."""
    return nearest_rows(corpus, queries, k, vector, key)


def top_and_bottom(df: DataFrame, by: str, value: str, tie: Sequence[str], k: int = 5) -> DataFrame:
    """Largest and smallest ``k`` rows per group; ranks are limited before the exchange."""
    up = Window.partitionBy(by).orderBy(F.col(value).desc(), *tie)
    down = Window.partitionBy(by).orderBy(F.col(value).asc(), *tie)
    top = df.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= k).withColumn("end", F.lit("top"))
    low = df.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= k).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)
