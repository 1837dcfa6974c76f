"""What baselines need of every expanding window, from one reading of the panel.

Between two fold ends lies a stretch. A window is its stretches added up, so each
row goes into one partial aggregate, however many folds may train on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.impute import _between
from seriesloom.operators.scans import neighbours


def fold_features(panel: DataFrame, folds: DataFrame, period: int, block: int | None = None) -> DataFrame:
    """Count, mean, first, last and last season of every fold's interpolated training window.

    ``panel`` is gridded (``t`` = 0, 1, ...; gaps NULL), ``folds`` as from ``fold_plan``; rows:
    the keys of a fold, train_end, horizon, n_train, last, first, mean, season. The same values as
    ``baseline_features`` of the windows after ``impute_training``: a gap counts as
    interpolated once the row behind it lies in the window, before that as a repeat
    of the last value. A fold without any value has no row.
    """
    t = F.col("t")
    ends = folds.groupBy("series_id").agg(F.array_sort(F.collect_set("train_end")).alias("_ends"))
    rows = neighbours(panel.select("series_id", "t", "value"), ("series_id",), "t", "value", block=block).join(ends, "series_id")
    stretch = F.size(F.filter("_ends", lambda e: e <= t))
    # a row's value is final for windows that reach beyond this position
    final = F.coalesce("value", _between("t"), "prev.value", "next.value")
    rows = rows.select("series_id", "t", "_ends", stretch.alias("_s"), F.col("value").isNotNull().alias("_seen"), final.alias("_v"), F.col("next.t").alias("_after"), F.col("prev.value").alias("_before")).filter(
        F.col("_s") < F.size("_ends"))
    rows = rows.withColumn("_end", F.element_at("_ends", F.col("_s") + 1))
    near = F.exists("_ends", lambda e: (t < e) & (t >= e - period))
    parts = rows.groupBy("series_id", "_s").agg(
        F.max("_end").alias("train_end"), F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_all"),
        F.sum(F.when(F.col("_after") < F.col("_end"), F.col("_v"))).alias("_own"),
        F.max(F.when(F.col("_seen"), F.struct("t", "_v"))).alias("_last"), F.min_by("_v", "t").alias("_first"),
        F.collect_list(F.when(near, F.struct("t", "_v", "_after", "_before"))).alias("_near"))
    w = Window.partitionBy("series_id").orderBy("_s")
    before = F.coalesce(F.sum("_all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_settled", F.when(F.col("_last").isNotNull(), F.struct((before + F.col("_own")).alias("total"), F.col("_last.t").alias("t"), F.col("_last._v").alias("v"))))
    # stretches have a row at least, so a season spans no more than ``period`` of them
    done = parts.select(
        "series_id", "train_end", F.sum("_n").over(upto).alias("n_train"), F.last("_settled", True).over(upto).alias("_c"), F.first("_first").over(upto).alias("first"),
        F.flatten(F.collect_list("_near").over(w.rowsBetween(-period, 0))).alias("_near")).filter(F.col("_c").isNotNull())
    end, last = F.col("train_end"), F.col("_c.v")
    mine = F.array_sort(F.filter("_near", lambda x: x["t"] >= end - period))
    season = F.transform(mine, lambda x: F.when(x["_after"] < end, x["_v"]).otherwise(x["_before"]))
    one = done.select("series_id", "train_end", "n_train", last.alias("last"), "first", ((F.col("_c.total") + (end - 1 - F.col("_c.t")) * last) / F.col("n_train")).alias("mean"), season.alias("season"))
    return folds.select("series_id", "fold", "kind", "train_end", "horizon").join(one, ["series_id", "train_end"])
