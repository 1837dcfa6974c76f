"""Holdouts and expanding-window folds as rows of a small table per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("series_id",)


def series_sizes(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grid length per series."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def holdout_split(n: Column, horizon: int) -> Column:
    """First test ordinal of the terminal holdout."""
    tail = F.greatest(F.floor(n * F.lit(0.8)), n - horizon)
    return F.greatest(F.lit(1), F.least(n - 1, tail)).cast("long")


def terminal_holdout(panel: DataFrame, horizon: int, keys: Sequence[str] = KEYS,
                     exact: bool = False) -> DataFrame:
    """Flag the test tail; ``exact`` holds out precisely the last ``horizon`` rows."""
    n = series_sizes(panel, keys)
    split = F.col("n") - horizon if exact else holdout_split(F.col("n"), horizon)
    rows = panel.join(n.select(*keys, "n", split.alias("split_at")), list(keys))
    return rows.withColumn("is_test", F.col("t") >= F.col("split_at"))


def fold_plan(sizes: DataFrame, requested: int, keys: Sequence[str] = KEYS, *,
              horizon: Column | None = None, initial: int | None = None, step: int | None = None,
              max_origins: int | None = 5, gap: int = 0, final_test: Column | None = None) -> DataFrame:
    """Earliest ``max_origins`` expanding folds plus the untouched final window.

    Defaults are the production rule: horizon ``min(requested, max(1, n/5))``
    and a final window of ``requested`` rows when the series has three of them.
    Rows: ``fold, kind, train_end, test_start, test_end, horizon``.
    """
    n = F.col("n")
    hz = horizon if horizon is not None else F.least(
        F.lit(requested), F.greatest(F.lit(1), F.floor(n / 5)))
    final = final_test if final_test is not None else F.when(n >= 3 * requested, F.lit(requested)).otherwise(0)
    rows = sizes.select(
        *keys, "n", hz.cast("long").alias("horizon"),
        F.greatest(F.lit(0), F.least(final, F.greatest(F.lit(0), n - 2))).cast("long").alias("_final"),
    )
    end = F.col("n") - F.col("_final")
    first = F.lit(initial) if initial is not None else F.greatest(F.lit(10), F.floor(end / 2))
    first = F.greatest(F.lit(1), F.least(first, end - F.col("horizon") - gap)).cast("long")
    last = end - gap - F.col("horizon")
    stride = F.greatest(F.lit(1), F.lit(step) if step is not None else F.col("horizon")).cast("long")
    # sequence() rejects an end before its start: too-short series get no origin
    origins = F.when(first <= last, F.sequence(first, last, stride)).otherwise(
        F.array().cast("array<bigint>"))
    if max_origins is not None:
        origins = F.slice(origins, 1, max_origins)
    rolling = F.transform(origins, lambda e, i: F.struct(
        i.cast("int").alias("fold"), F.lit("rolling").alias("kind"), e.alias("train_end"),
        (e + gap).alias("test_start"), (e + gap + F.col("horizon")).alias("test_end"),
        F.col("horizon").alias("horizon")))
    closing = F.when((F.col("_final") > 0) & (F.col("n") > F.col("_final")), F.array(F.struct(
        F.size(origins).cast("int").alias("fold"), F.lit("final").alias("kind"), end.alias("train_end"),
        end.alias("test_start"), F.col("n").alias("test_end"), F.col("_final").alias("horizon"))))
    empty = F.array().cast("array<struct<fold:int,kind:string,train_end:bigint,test_start:bigint,"
                            "test_end:bigint,horizon:bigint>>")
    return rows.select(*keys, "n", F.inline(F.concat(rolling, F.coalesce(closing, empty))))


def _with_folds(panel: DataFrame, folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach each series' few folds as one array: an equi-join, not a range join."""
    packed = folds.groupBy(*keys).agg(F.collect_list(F.struct(
        "fold", "kind", "train_end", "test_start", "test_end", "horizon")).alias("_folds"))
    return panel.join(packed, list(keys))


def training_windows(panel: DataFrame, folds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One copy of a row per fold that may train on it (``t < train_end``)."""
    rows = _with_folds(panel, folds, keys)
    mine = F.filter("_folds", lambda f: F.col("t") < f["train_end"])
    return rows.select(*keys, "t", "ts", "value", F.inline(mine))


def test_windows(panel: DataFrame, folds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Actuals per fold with horizon step ``h`` starting at 1."""
    rows = _with_folds(panel, folds, keys)
    mine = F.filter("_folds", lambda f: (F.col("t") >= f["test_start"]) & (F.col("t") < f["test_end"]))
    out = rows.select(*keys, "t", F.col("value").alias("y"), F.inline(mine))
    return out.select(*keys, "fold", "kind", (F.col("t") - F.col("test_start") + 1).cast("int").alias("h"), "y")


def unsupported_horizons(requested: Column, evaluated: Column) -> Column:
    """Steps that were asked for but not evaluated."""
    return F.when(requested > evaluated, F.sequence(evaluated + 1, requested)).otherwise(
        F.array().cast("array<bigint>"))
