"""Linear trend, autocorrelation-robust inference, unit-free stationarity statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import MAX_PERIODS, normalise_alias
from seriesloom.functions.tails import normal_two_sided, t_two_sided
from seriesloom.operators.dependence import lag_products
from seriesloom.operators.scans import running_sums

KEYS = ("series_id",)


def linear_fit(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Closed-form regression of ``value`` on the ordinal ``t``: mergeable sums only."""
    t = F.col("t").cast("double")
    return df.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.regr_slope("value", t).alias("slope"), F.regr_intercept("value", t).alias("intercept"),
        F.when(F.regr_syy("value", t) > 0, F.regr_r2("value", t)).otherwise(0.0).alias("r2"), F.regr_sxx("value", t).alias("sxx"), F.avg(t).alias("t_mean"),
    )


def trend_ols(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Slope, R squared and the t-test of the slope."""
    fit = linear_fit(df, keys)
    tstat = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.when(F.col("r2") < 1, 1 - F.col("r2")))
    out = fit.select(*keys, "n", "slope", "intercept", "r2", tstat.alias("t_abs"))
    out = out.withColumn("p_value", F.coalesce(
        t_two_sided("t_abs", (F.col("n") - 2).cast("double")), F.when(F.col("r2") >= 1, F.lit(0.0))))
    return out.withColumn("has_trend", F.col("p_value") < 0.05).withColumn(
        "direction", F.when(F.col("slope") > 0, "upward").otherwise("downward"))


def detrend(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Residual from the line; series under three rows are centred instead."""
    rows = df.join(linear_fit(df, keys).select(*keys, "n", "mean", "slope", "intercept"), list(keys))
    line = F.when(F.col("n") < 3, F.col("mean")).otherwise(F.col("intercept") + F.col("slope") * F.col("t"))
    return rows.withColumn("resid", F.col("value") - line).drop("n", "mean", "slope", "intercept")


def bartlett_sum(df: DataFrame, z: str, lags: Column, keys: Sequence[str] = KEYS,
                 block: int | None = None) -> DataFrame:
    """Bartlett-weighted sum of all lagged products of a zero-sum column ``z``.

    The weighted sum over lags -L..L equals the mean square of all windows of
    L+1 consecutive terms times the window count, so any bandwidth costs one
    prefix sum and one aggregate instead of L lag joins. ``df`` carries ``n``.
    """
    sums = running_sums(df.withColumn("_L", lags.cast("long")), keys, "t", {"_p": F.col(z)}, block)
    ends = F.array(F.struct(F.col("t").alias("j"), F.col("_p").alias("v")),
                   F.struct((F.col("t") + F.col("_L") + 1).alias("j"), (-F.col("_p")).alias("v")))
    windows = sums.select(*keys, "_L", F.explode(ends).alias("_e")).groupBy(*keys, F.col("_e.j").alias("_j")).agg(
        F.sum("_e.v").alias("_w"), F.first("_L").alias("_L"))
    return windows.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_w")) / (F.first("_L") + 1)).alias("long_run"), F.first("_L").alias("lags"))


def trend_hac(df: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Slope with an autocorrelation-robust p-value (bandwidth max(1, n/5))."""
    fit = linear_fit(df, keys)
    rows = df.join(fit, list(keys)).filter(F.col("n") >= 5)
    u = F.col("value") - F.col("intercept") - F.col("slope") * F.col("t")
    rows = rows.withColumn("_z", (F.col("t") - F.col("t_mean")) / F.col("sxx") * u)
    lrv = bartlett_sum(rows.select(*keys, "t", "n", "_z"), "_z",
                       F.greatest(F.lit(1), F.floor(F.col("n") / 5)), keys, block)
    out = fit.join(lrv, list(keys), "left").select(
        *keys, "n", "slope", F.col("r2").alias("effect_size"), F.sqrt("long_run").alias("hac_se"),
        F.try_divide("slope", F.sqrt("long_run")).alias("z_stat"))
    out = out.withColumn("p_value", normal_two_sided("z_stat"))
    ok = F.col("n") >= 5
    return out.withColumn("status", F.when(ok, "ok").otherwise("not_estimable")).withColumn(
        "has_trend", F.when(ok, F.coalesce((F.col("p_value") < 0.05) & (F.col("effect_size") > 0.01), F.lit(False))))


# Published KPSS critical points (10, 5, 2.5, 1 percent).
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def _table_p(stat: Column, spec: str) -> Column:
    """Linear interpolation of the critical table, clipped to its ends."""
    crit = KPSS_CRITICAL[spec]
    p = F.when(stat <= crit[0], KPSS_LEVELS[0])
    for (a, b), (pa, pb) in zip(zip(crit, crit[1:]), zip(KPSS_LEVELS, KPSS_LEVELS[1:])):
        p = p.when(stat <= b, F.lit(pa) + (stat - a) / (b - a) * (pb - pa))
    return p.otherwise(KPSS_LEVELS[-1])


def kpss(df: DataFrame, spec: str = "c", freq: str = "MS", keys: Sequence[str] = KEYS,
         block: int | None = None) -> DataFrame:
    """Level (``c``) or trend (``ct``) stationarity statistic with automatic bandwidth."""
    fit = linear_fit(df, keys)
    line = F.col("mean") if spec == "c" else F.col("intercept") + F.col("slope") * F.col("t")
    rows = df.join(fit, list(keys)).withColumn("_e", F.col("value") - line)
    # covariance lags used by the bandwidth rule: n^(2/9), bounded by the calendar
    top = max(1, int(MAX_PERIODS[normalise_alias(freq)] ** (2 / 9)))
    prod = lag_products(rows.select(*keys, "t", "_e"), top, keys, "_e", demean=False, block=block)
    n = F.col("n").cast("double")
    used = F.slice("c", 1, F.floor(F.pow(n, F.lit(2 / 9))).cast("int"))
    s0 = F.col("c0") / n + F.aggregate(used, F.lit(0.0), lambda a, x: a + x * 2 / n)
    s1 = F.aggregate(F.transform(used, lambda x, i: x * 2 / n * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    # a series without spread has no ratio and no statistic
    ratio = F.try_divide(s1, s0)
    width = F.floor(F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
    band = prod.select(*keys, F.least(width, F.col("n") - 1).cast("long").alias("_band"))
    resid = rows.join(band, list(keys)).select(*keys, "t", "n", "_e", "_band")
    lrv = bartlett_sum(resid, "_e", F.col("_band"), keys, block)
    partial = running_sums(resid, keys, "t", {"_s": F.col("_e")}, block).groupBy(*keys).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.first("n").alias("n"))
    out = partial.join(lrv, list(keys)).select(
        *keys, "n", "lags",
        F.try_divide(F.col("_ss") / (F.col("n") * F.col("n")), F.col("long_run") / F.col("n")).alias("statistic"))
    return out.withColumn("p_value", F.when(F.col("statistic").isNotNull(), _table_p(F.col("statistic"), spec)))


def classify_stationarity(adf_c: Column, adf_ct: Column, kpss_c: Column, kpss_ct: Column,
                          alpha: float = 0.05) -> Column:
    """Five-way class from four p-values; branches are evaluated in this order."""
    rej = lambda p: F.coalesce(p < alpha, F.lit(False))
    ac, at, kc, kt = rej(adf_c), rej(adf_ct), rej(kpss_c), rej(kpss_ct)
    return (
        F.when(ac & ~kc, "stationary").when(at & ~kt & kc, "trend_stationary")
        .when(~ac & kc, "difference_stationary").when(ac != ~kc, "conflicting")
        .otherwise("not_estimable")
    )
