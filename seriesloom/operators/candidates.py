"""Forecast candidates that are plain column expressions over one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("series_id", "fold")
BASELINES = ("Constant", "Naive", "Seasonal Naive", "Mean Forecast", "Drift")


def baseline_features(train: DataFrame, period: int, keys: Sequence[str] = KEYS,
                      carry: Sequence[str] = ("kind", "horizon")) -> DataFrame:
    """Everything the baselines need, from one partial+final aggregate.

    The last season is at most ``period`` values; the rest are scalars.
    """
    recent = F.when(F.col("t") >= F.col("train_end") - period, F.struct("t", "value"))
    agg = train.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        F.count("value").alias("n_train"),
        F.max_by("value", "t").alias("last"), F.min_by("value", "t").alias("first"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.array_sort(F.collect_list(recent)).alias("_season"),
    )
    return agg.withColumn("season", F.transform("_season", lambda s: s["value"])).drop("_season")


def baseline_forecasts(features: DataFrame, period: int, keys: Sequence[str] = KEYS,
                       constant_only: Column | None = None, holdout_rule: bool = False) -> DataFrame:
    """Long predictions ``model, h, yhat``; a candidate that cannot run gives no rows.

    Seasonal naive needs ``period > 1`` and a full season; with
    ``holdout_rule`` it wraps whatever season is available.
    """
    h, n = F.col("h"), F.col("n_train")
    season_ok = (F.size("season") > 0) if holdout_rule else (
        F.lit(period > 1) & (n >= period) & (F.size("season") == period))
    wrapped = F.element_at("season", (F.pmod(h - 1, F.size("season")) + 1).cast("int"))
    is_constant = constant_only if constant_only is not None else F.lit(False)
    makers = {
        "Constant": F.when(is_constant, F.col("last")),
        "Naive": F.when(~is_constant, F.col("last")),
        "Seasonal Naive": F.when(~is_constant & season_ok, wrapped),
        "Mean Forecast": F.when(~is_constant, F.col("mean")),
        "Drift": F.when(~is_constant & (n >= 2),
                        F.col("last") + h * (F.col("last") - F.col("first")) / (n - 1)),
    }
    steps = features.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("horizon").cast("int"))))
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("model"), expr.alias("yhat"))
                     for i, (name, expr) in enumerate(makers.items(), start=8)])
    extra = [c for c in ("kind",) if c in features.columns and c not in keys]
    return steps.select(*keys, *extra, "h", F.inline(rows)).filter(F.col("yhat").isNotNull())


def ses_forecasts(fit: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flat forecast with its residual-quantile band."""
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("horizon").cast("int"))))
    return steps.select(
        *keys, "h", F.lit(3).alias("ord"), F.lit("EWMA").alias("model"), F.col("level").alias("yhat"),
        (F.col("level") + F.col("band_lo")).alias("lo"), (F.col("level") + F.col("band_hi")).alias("hi"), "status")
