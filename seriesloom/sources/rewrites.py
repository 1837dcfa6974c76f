"""Upserts and deletions that rewrite only the parts holding changed rows.

A table is a folder of parts (rows by a hash of their key) and of versions: each
version is a small list that names the folder of every part. A change writes
the parts that hold changed rows into a new folder, then the next version;
all other parts stay where they are. Readers of an earlier version are not disturbed, and a
change that dies before its version is written leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"
_LIST = "version long, part int, folder string, rows long"


def _part(key: str, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts) if isinstance(parts, int) else parts).cast("int").alias(PART)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, part, folder, rows) of every version written so far."""
    return spark.read.schema(_LIST).json(f"{path}/versions/*")


def current(spark: SparkSession, path: str, version: int | None = None) -> dict[int, str]:
    """Folder of each part in the given (default: last) version; as many entries as the table has parts."""
    rows = versions(spark, path)
    wanted = rows.agg(F.max("version")).scalar() if version is None else F.lit(version)
    return {r["part"]: r["folder"] for r in rows.filter(F.col("version") == wanted).select("part", "folder").collect()}


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version (default: the last)."""
    return _scan(spark, path, current(spark, path, version)).drop(PART)


def _scan(spark: SparkSession, path: str, parts: dict[int, str]) -> DataFrame:
    folders = [f"{path}/data/{folder}/{PART}={part}" for part, folder in sorted(parts.items()) if folder]
    schema = spark.read.parquet(f"{path}/schema").schema
    if not folders:
        return spark.createDataFrame([], schema).withColumn(PART, F.lit(None).cast("int"))
    return spark.read.schema(schema).parquet(*folders).withColumn(PART, F.regexp_extract(F.col("_metadata.file_path"), rf"/{PART}=(\d+)/", 1).cast("int"))


def _write(rows: DataFrame, path: str, key: str, parts: int, changed: list[int], kept: dict[int, str], version: int) -> None:
    spark = rows.sparkSession
    folder = uuid.uuid4().hex
    # a task writes whole parts, or a slice of one that holds far more rows than others
    rows.select(*[c for c in rows.columns if c != PART], _part(key, parts)).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(f"{path}/data/{folder}")
    # a part that lost all rows has no folder
    filled = spark.createDataFrame([(p,) for p in changed], "part int")
    have = spark.read.schema(f"{PART} int").parquet(f"{path}/data/{folder}").groupBy(F.col(PART).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    new = filled.join(have, "part", "left").select(F.lit(version).cast("long").alias("version"), "part", F.when(F.col("rows") > 0, folder).alias("folder"), F.coalesce("rows", F.lit(0)).alias("rows"))
    if kept:
        old = versions(spark, path).filter(F.col("version") == version - 1).filter(F.col("part").isin(list(kept)))
        new = new.unionByName(old.withColumn("version", F.lit(version).cast("long")))
    # two writers of one version: the second one fails here
    new.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/versions/{version}")


def create(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Write a new table of ``parts`` parts; ``key`` names its rows in later changes."""
    rows.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    _write(rows, path, key, parts, list(range(parts)), {}, 1)


def _last(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    version = versions(spark, path).agg(F.max("version")).first()[0]
    return version, current(spark, path, version)


def upsert_parts(spark: SparkSession, path: str, changes: DataFrame, key: str, order: str | None = None) -> list[int]:
    """Put ``changes`` in place of rows with the same key; returns the parts that were rewritten.

    Of several changes of a key the one with the greatest ``order`` counts; without
    ``order`` keys must be distinct. A NULL key is a key like others. Only the
    columns of the table are taken.
    """
    version, held = _last(spark, path)
    table = _scan(spark, path, held)
    columns = [c for c in table.columns if c != PART]
    latest = changes.select(*columns) if order is None else changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select("_r.*")
    touched = sorted(r[0] for r in changes.select(_part(key, len(held))).distinct().collect())
    if not touched:
        return []
    mine = _scan(spark, path, {p: held[p] for p in touched}).drop(PART)
    gone = latest.select(F.col(key).alias("_key"))
    rest = mine.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    _write(rest.unionByName(latest), path, key, len(held), touched, {p: f for p, f in held.items() if p not in touched}, version + 1)
    return touched


def delete_rows(spark: SparkSession, path: str, key: str, condition: Column) -> list[int]:
    """Drop the rows for which ``condition`` is true; returns the parts that were rewritten."""
    version, held = _last(spark, path)
    touched = sorted(r[0] for r in _scan(spark, path, held).filter(condition).select(PART).distinct().collect())
    if not touched:
        return []
    rest = _scan(spark, path, {p: held[p] for p in touched}).drop(PART).filter(~F.coalesce(condition, F.lit(False)))
    _write(rest, path, key, len(held), touched, {p: f for p, f in held.items() if p not in touched}, version + 1)
    return touched
