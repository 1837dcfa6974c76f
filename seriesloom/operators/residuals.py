"""Residual bundles, interval calibration and combined evidence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import DIAGNOSTIC_PERIODS
from seriesloom.functions.guards import finite
from seriesloom.functions.tails import t_quantile
from seriesloom.operators import dependence as D
from seriesloom.operators import fitted as FT
from seriesloom.operators import metrics as M
from seriesloom.operators import spectral as SP
from seriesloom.operators import trend as T
from seriesloom.operators.decompose import seasonal_strength
from seriesloom.staging import stage

SM = ("series_id", "model")


def mean_interval(errors: DataFrame, keys: Sequence[str] = SM) -> DataFrame:
    """Mean error with its 95 percent t-interval and a zero-mean flag."""
    e = finite(F.col("y") - F.col("yhat"))
    agg = errors.groupBy(*keys).agg(F.count(e).alias("n_errors"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("_sd"))
    agg = agg.withColumn("se", F.col("_sd") / F.sqrt("n_errors")).withColumn(
        "_t", F.when(F.col("n_errors") >= 2, t_quantile(F.lit(0.975), (F.col("n_errors") - 1).cast("double"))))
    lo, hi = F.col("mean") - F.col("_t") * F.col("se"), F.col("mean") + F.col("_t") * F.col("se")
    return agg.select(*keys, "n_errors", "mean", "se", lo.alias("mean_ci_lower"), hi.alias("mean_ci_upper"),
                      ((lo <= 0) & (hi >= 0)).alias("is_zero_mean"))


def _ordered_errors(errors: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pooled errors with a dense position: folds in order, steps inside each fold.

    A candidate has at most folds x horizon errors, so the window is bounded.
    """
    e = finite(F.col("y") - F.col("yhat"))
    rows = errors.withColumn("value", e).filter(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(*keys, "value", (F.row_number().over(w) - 1).cast("long").alias("t"))


def _bundle(series: DataFrame, base: DataFrame, keys: Sequence[str], df_adjust: int, disabled: Sequence[str]) -> DataFrame:
    none = F.lit(None)
    out = base
    if "residual_zero_mean" in disabled:
        out = out.withColumn("is_zero_mean", none.cast("boolean"))
    if "residual_autocorrelation" in disabled:
        out = out.withColumns({"ljung_box_p": none.cast("double"), "is_uncorrelated": none.cast("boolean")})
    else:
        lb = D.ljung_box(series, keys, df_adjust=df_adjust, half_cap=True).select(
            *keys, F.col("p_value").alias("ljung_box_p"), F.col("lag").alias("ljung_box_lag"),
            (F.col("p_value") >= 0.05).alias("is_uncorrelated"))
        out = out.join(lb, list(keys), "left")
    if "residual_normality" in disabled:
        out = out.withColumns({"shapiro_p": none.cast("double"), "is_normal": none.cast("boolean")})
    else:
        sw = FT.normality(series, keys, "value").select(
            *keys, F.col("p_value").alias("shapiro_p"), (F.col("p_value") >= 0.05).alias("is_normal"))
        out = out.join(sw, list(keys), "left")
    return out


def error_diagnostics(errors: DataFrame, keys: Sequence[str] = SM, disabled: Sequence[str] = ()) -> DataFrame:
    """Diagnostics of pooled backtest errors, with per-step variance and interval scores."""
    # read by each diagnostic: aligned once
    errors = stage(errors, "errors")
    series = _ordered_errors(errors, keys, ["fold", "h"])
    out = _bundle(series, mean_interval(errors, keys), keys, 0, disabled)
    var = M.error_variance_by_horizon(errors, keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "variance")))).alias("variance_by_horizon"))
    out = out.join(var, list(keys), "left").withColumn("error_type", F.lit("backtest_errors"))
    if {"lo", "hi"} <= set(errors.columns):
        scores = M.interval_scores(errors, keys)
        pooled = scores.filter(F.col("h").isNull()).drop("h")
        steps = scores.filter(F.col("h").isNotNull()).groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "coverage")))).alias("coverage_by_horizon"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "mean_width")))).alias("width_by_horizon"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "winkler")))).alias("winkler_by_horizon"))
        out = out.join(pooled, list(keys), "left").join(steps, list(keys), "left")
        out = out.withColumn("coverage_estimable", F.col("coverage").isNotNull())
    return out


def innovation_diagnostics(fits: DataFrame, keys: Sequence[str] = SM, disabled: Sequence[str] = ()) -> DataFrame:
    """Diagnostics of fitted innovations held as arrays; degrees of freedom drop by the AR+MA order."""
    rows = fits.filter(F.size("resid") > 0).select(*keys, "ar_ma_order", F.posexplode("resid").alias("t", "value"))
    rows = rows.withColumn("t", F.col("t").cast("long"))
    pairs = rows.withColumns({"y": F.col("value"), "yhat": F.lit(0.0)})
    out = _bundle(rows.select(*keys, "t", "value"), mean_interval(pairs, keys), keys, 0, disabled)
    if "residual_autocorrelation" not in disabled:
        from seriesloom.functions.tails import chi2_sf

        order = fits.select(*keys, "ar_ma_order")
        lb = D.ljung_box(rows.select(*keys, "t", "value"), keys, half_cap=True).select(*keys, "statistic", "lag")
        adjusted = lb.join(order, list(keys)).withColumn(
            "_p", chi2_sf("statistic", F.greatest(F.lit(1), F.col("lag") - F.col("ar_ma_order")).cast("double")))
        out = out.drop("ljung_box_p", "is_uncorrelated", "ljung_box_lag").join(
            adjusted.select(*keys, F.col("_p").alias("ljung_box_p"), F.col("lag").alias("ljung_box_lag"),
                            F.col("ar_ma_order").alias("ljung_box_df_adjust"), (F.col("_p") >= 0.05).alias("is_uncorrelated")),
            list(keys), "left")
    return out.withColumn("error_type", F.lit("innovations"))


def choose_diagnostics(backtest: DataFrame, innovations: DataFrame, keys: Sequence[str] = SM) -> DataFrame:
    """Backtest errors where any fold succeeded, fitted innovations otherwise."""
    rest = innovations.join(backtest.select(*keys), list(keys), "left_anti")
    return backtest.unionByName(rest, allowMissingColumns=True)


def calibrate(forecasts: DataFrame, scores: DataFrame, nominal: float = 0.95) -> DataFrame:
    """Widen or narrow intervals so nominal coverage matches the pooled coverage."""
    pooled = scores.filter(F.col("h").isNull()).select("series_id", "model", "coverage")
    dof = F.lit(10_000.0)
    pooled = pooled.withColumn("_tn", t_quantile(F.lit(0.5 + nominal / 2), dof)).withColumn(
        "_te", t_quantile(F.lit(0.5) + F.col("coverage") / 2, dof))
    rows = forecasts.join(pooled, ["series_id", "model"], "left")
    scaled = FT.calibrate_interval(F.col("lo"), F.col("hi"), F.col("coverage"), F.col("_tn"), F.col("_te"))
    return rows.withColumn("_c", scaled).withColumns({"lo": F.col("_c.lo"), "hi": F.col("_c.hi")}).drop("_c", "_tn", "_te")


def stationarity(panel: DataFrame, freq: str = "MS") -> DataFrame:
    """Both unit-root specs, both level specs and the combined class."""
    named = lambda df, p: df.select(
        "series_id", F.col("statistic").alias(f"{p}_stat"), F.col("p_value").alias(f"{p}_p"))
    out = named(FT.adf(panel, "c"), "adf").join(named(FT.adf(panel, "ct"), "adf_trend"), "series_id")
    out = out.join(named(T.kpss(panel, "c", freq), "kpss"), "series_id").join(
        named(T.kpss(panel, "ct", freq), "kpss_trend"), "series_id")
    klass = T.classify_stationarity(F.col("adf_p"), F.col("adf_trend_p"), F.col("kpss_p"), F.col("kpss_trend_p"))
    return out.withColumn("classification", klass).withColumn(
        "is_stationary", F.col("classification").isin("stationary", "trend_stationary"))


def seasonality(panel: DataFrame, freq: str, metadata_period: int | None = None) -> DataFrame:
    """Period choice with provenance from frequency, metadata, spectrum and decomposition strength."""
    sizes = panel.groupBy("series_id").agg(F.count("value").alias("n"))
    found = SP.candidate_periods(SP.periodogram(T.detrend(panel)))
    rows = sizes.join(found, "series_id", "left").withColumn(
        "candidates", F.coalesce("candidates", F.array().cast("array<int>")))
    fp = F.lit(DIAGNOSTIC_PERIODS.get(freq)).cast("int")
    mp = F.lit(metadata_period).cast("int")
    rows = rows.withColumn("stl_period", SP.stl_period(fp, mp, F.col("candidates"), F.col("n")))
    # the decomposition length is per series: each distinct period is one branch of rows
    packed = panel.join(rows.select("series_id", "stl_period"), "series_id").filter(F.col("stl_period").isNotNull())
    strength = _strength(packed)
    out = rows.join(strength, "series_id", "left")
    chosen = SP.select_period(fp, mp, F.col("candidates"), F.col("seasonal_strength"), F.col("stl_period"))
    return out.withColumn("_c", chosen).select(
        "series_id", "n", fp.alias("frequency_period"), "candidates", "stl_period", "seasonal_strength",
        F.col("_c.period").alias("selected_period"), F.col("_c.provenance").alias("provenance"))


def _strength(panel: DataFrame) -> DataFrame:
    from seriesloom.kernels.loess import stl as stl_kernel
    from seriesloom.kernels.rows import pack, run_rows

    def fit(x, row):
        season, _, resid = stl_kernel(x, int(row["stl_period"]))
        return {"seasonal": season.tolist(), "resid": resid.tolist()}

    parts = run_rows(pack(panel, ["series_id"], carry=["stl_period"]), fit,
                     "seasonal array<double>, resid array<double>", ["series_id"])
    long = parts.select("series_id", F.inline(F.arrays_zip("seasonal", "resid")))
    return long.groupBy("series_id").agg(
        seasonal_strength(F.col("resid"), F.col("seasonal")).alias("seasonal_strength"))
