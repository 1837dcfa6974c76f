"""Forecast accuracy as conditional aggregates, pooled and by horizon in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.guards import finite

KEYS = ("series_id",)
# Reasons recorded when a metric cannot be computed.
NO_PAIRS = "No finite aligned observations."
ZERO_ACTUAL = "MAPE is undefined when any actual value is zero."
ZERO_DENOMINATOR = "WAPE is undefined when the absolute-actual denominator is zero."
SHORT_TRAINING = "Training data is too short for the configured naive lag."
ZERO_SCALE = "MASE is undefined because the naive error scale is zero."
BOTH_ZERO = "sMAPE is undefined when actual and forecast are both zero."


def naive_scale(train: DataFrame, period: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean absolute and squared lag-``period`` differences of a gap-free window."""
    rows = train.filter(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy("t")
    diff = F.col("value") - F.lag("value", period).over(w)
    return rows.withColumn("_d", diff).groupBy(*keys).agg(
        F.avg(F.abs("_d")).alias("scale"), F.avg(F.col("_d") * F.col("_d")).alias("scale_sq"))


def pair_errors(actuals: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions with their actuals by position; ``origins.aligned`` also shows what is missing."""
    return predictions.join(actuals, list(on), "left")


def metric_columns() -> list[Column]:
    """Aggregates over columns ``y, yhat, scale, scale_sq`` (scales constant per group)."""
    y0, f0 = finite(F.col("y")), finite(F.col("yhat"))
    ok = y0.isNotNull() & f0.isNotNull()
    y, f = F.when(ok, y0), F.when(ok, f0)
    e, ae = y - f, F.abs(y - f)
    both = F.abs(y) + F.abs(f)
    scale, scale_sq = F.max("scale"), F.max("scale_sq")
    mae, mse = F.avg(ae), F.avg(e * e)
    any_zero = F.count_if(y == 0) > 0
    return [
        F.sqrt(mse).alias("rmse"), mae.alias("mae"),
        F.when(~any_zero, F.avg(F.abs(e / F.when(y != 0, y))) * 100).alias("mape"),
        F.when(F.sum(F.abs(y)) > 0, F.sum(ae) / F.sum(F.abs(y))).alias("wape"),
        F.when(scale > 0, mae / scale).alias("mase"),
        (F.avg(F.when(both > 0, ae / both)) * 200).alias("smape"),
        F.when((scale > 0) & (scale_sq > 0), F.sqrt(mse / scale_sq)).alias("rmsse"),
        F.count_if(ok).alias("n_evaluated"), F.count_if(~ok).alias("n_missing"),
        scale.alias("_scale"), any_zero.alias("_any_zero"), F.sum(F.abs(y)).alias("_den"),
    ]


def _reasons() -> Column:
    """Map of metric name to the reason it is unavailable."""
    none = F.lit(None).cast("string")
    has = F.col("n_evaluated") > 0
    short = F.when(has & F.col("_scale").isNull(), SHORT_TRAINING).when(
        has & (F.col("_scale") == 0), ZERO_SCALE)
    entries = {
        "all": F.when(~has, NO_PAIRS), "mape": F.when(has & F.col("_any_zero"), ZERO_ACTUAL),
        "wape": F.when(has & (F.col("_den") == 0), ZERO_DENOMINATOR), "mase": short, "rmsse": short,
        "smape": F.when(has & F.col("smape").isNull(), BOTH_ZERO),
    }
    flat = [x for k, v in entries.items() for x in (F.lit(k), F.coalesce(v, none))]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


def forecast_metrics(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics per group. ``errors`` carries ``y, yhat, scale, scale_sq``."""
    agg = errors.groupBy(*keys).agg(*metric_columns())
    return agg.withColumn("unavailable", _reasons()).drop("_scale", "_any_zero", "_den")


def pooled_and_by_horizon(errors: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Pooled rows (``h`` NULL) and per-horizon rows from one grouping-sets pass."""
    cols = [F.col(k) for k in keys]
    agg = errors.groupingSets([cols, [*cols, F.col("h")]], *cols, F.col("h")).agg(*metric_columns())
    return agg.withColumn("unavailable", _reasons()).drop("_scale", "_any_zero", "_den")


def skill_scores(pooled: DataFrame, references: Sequence[str] = ("Seasonal Naive", "Naive")) -> DataFrame:
    """Relative MAE / RMSE gain over the better of the reference baselines."""
    ref = pooled.filter(F.col("model").isin(*references) & F.col("rmse").isNotNull())
    order = F.struct(
        F.coalesce(F.when(F.col("mae") != 0, F.col("mae")), F.lit(float("inf"))),
        F.when(F.col("model") == references[0], 0).otherwise(1))
    best = ref.groupBy("series_id").agg(
        F.min_by("model", order).alias("reference"), F.min_by("mae", order).alias("_mae"),
        F.min_by("rmse", order).alias("_rmse"))
    rows = pooled.join(best, "series_id")
    gain = lambda m, r: 1 - F.col(m) / F.when(F.col(r) != 0, F.col(r))
    return rows.select("series_id", "model", "reference", gain("mae", "_mae").alias("mae_skill"),
                       gain("rmse", "_rmse").alias("rmse_skill"))


def error_variance_by_horizon(errors: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Sample variance of errors per step; one error gives zero. Steps count from 0."""
    e = F.col("y") - F.col("yhat")
    return errors.filter(e.isNotNull()).groupBy(*keys, (F.col("h") - 1).alias("step")).agg(
        F.coalesce(F.var_samp(e), F.lit(0.0)).alias("variance"))


def interval_scores(errors: DataFrame, keys: Sequence[str] = ("series_id", "model"),
                    nominal: float = 0.95) -> DataFrame:
    """Coverage, width, Winkler and weighted interval score; pooled and per step."""
    alpha = 1.0 - nominal
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    rows = errors.filter(y.isNotNull() & lo.isNotNull() & hi.isNotNull())
    penalty = F.when(y < lo, 2 / alpha * (lo - y)).when(y > hi, 2 / alpha * (y - hi)).otherwise(0.0)
    cols = [F.col(k) for k in keys]
    agg = rows.groupingSets([cols, [*cols, F.col("h")]], *cols, F.col("h")).agg(
        F.avg(y.between(lo, hi).cast("double")).alias("coverage"), F.avg(hi - lo).alias("mean_width"),
        F.avg(hi - lo + penalty).alias("winkler"), F.count(F.lit(1)).alias("n_scored"))
    return agg.withColumn("weighted_interval_score", F.col("winkler") * alpha / 2)


def bootstrap_intervals(errors: DataFrame, keys: Sequence[str] = ("series_id", "model"),
                        repetitions: int = 500, seed: int = 42) -> DataFrame:
    """Percentile intervals of pooled RMSE, MAE and MASE by hashed resampling.

    A candidate's pooled errors are at most folds x horizon values, so each
    resample is an array expression on one row; draws are a hash of (seed,
    group, repetition, position) and therefore survive task retries.
    """
    e = finite(F.col("y") - F.col("yhat"))
    packed = errors.withColumn("_e", e).filter(F.col("_e").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("fold", "h", "_e"))).alias("_s"), F.max("scale").alias("_scale"))
    packed = packed.withColumn("_x", F.transform("_s", lambda s: s["_e"])).filter(F.size("_x") >= 3)
    n = F.size("_x")
    group = F.xxhash64(*keys)

    def draw(rep):
        picks = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(
            "_x", (F.pmod(F.xxhash64(F.lit(seed), group, rep, i), n) + 1).cast("int")))
        sums = F.aggregate(picks, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("s")),
                           lambda acc, v: F.struct((acc["a"] + F.abs(v)).alias("a"), (acc["s"] + v * v).alias("s")))
        return sums

    reps = packed.select(*keys, "_scale", n.alias("_n"), F.explode(
        F.transform(F.sequence(F.lit(1), F.lit(repetitions)), draw)).alias("_d"))
    mae = F.col("_d.a") / F.col("_n")
    rows = reps.select(*keys, mae.alias("mae"), F.sqrt(F.col("_d.s") / F.col("_n")).alias("rmse"),
                       F.when(F.col("_scale") > 0, mae / F.col("_scale")).alias("mase"))
    out = []
    for m in ("rmse", "mae", "mase"):
        out += [F.percentile(m, F.lit(0.025)).alias(f"{m}_lo"), F.percentile(m, F.lit(0.975)).alias(f"{m}_hi")]
    return rows.groupBy(*keys).agg(*out)


def merge_metrics(found: DataFrame, existing: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Keep every found row and add existing rows for candidates that have none."""
    return found.unionByName(existing.join(found.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def with_backtest_only(rows: DataFrame, backtests: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Candidates that were actually backtested."""
    return rows.join(backtests.select(*keys).distinct(), list(keys), "left_semi")
