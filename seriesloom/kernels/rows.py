"""Packing of windows into array rows and the row-wise kernel runner."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import SINGLE_TASK_ROWS


def pack(df: DataFrame, keys: Sequence[str], value: str = "value", carry: Sequence[str] = (),
         pos: str = "t") -> DataFrame:
    """One row per group with its ordered non-null values in ``x``.

    A longer group than a daily calendar can hold is an error, not a truncation:
    such series must first be bucketed to a coarser frequency.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry], F.count(F.lit(1)).alias("_size"),
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v")))).alias("_pv"))
    checked = rows.withColumn("_ok", F.when(
        F.col("_size") > SINGLE_TASK_ROWS,
        F.raise_error(F.lit("Series exceeds the kernel bound; bucket it to a coarser frequency."))))
    return checked.filter(F.col("_ok").isNull()).select(
        *keys, *carry, F.transform("_pv", lambda s: s["v"]).alias("x"))


def run_rows(df: DataFrame, fn: Callable[[np.ndarray, dict], dict], schema: str, keep: Sequence[str]) -> DataFrame:
    """Map ``fn(x, row)`` over packed rows; output columns are ``keep`` plus ``schema``.

    The rows are dealt evenly over the configured number of partitions: each row
    may cost milliseconds of solver time, so coalescing by bytes would serialise
    it, and a repartition by the grouping key would be planned away.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [df.schema[c] for c in keep]
    extra = T.StructType.fromDDL(schema)
    names = [f.name for f in kept] + extra.fieldNames()

    def apply(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x = np.asarray(row.pop("x"), dtype=float)
                got = fn(x, row)
                out.append([row[k] for k in keep] + [got.get(n) for n in extra.fieldNames()])
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.repartition(parts).mapInPandas(apply, T.StructType(kept + extra.fields))
