"""Composition of folds, candidates, metrics and selection into one evaluation plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import future_stamps
from seriesloom.kernels.rows import pack
from seriesloom.operators import candidates as C
from seriesloom.operators import folds as FO
from seriesloom.operators import fitted as FT
from seriesloom.operators import metrics as M
from seriesloom.operators import origins as OR
from seriesloom.operators import transforms as X
from seriesloom.operators.impute import impute_training
from seriesloom.operators.levels import level_fit
from seriesloom.operators.outliers import treat_outliers, winsorise
from seriesloom.operators.quality import constant_and_skew
from seriesloom.operators.selection import select_models
from seriesloom.operators.smooth import smooth
from seriesloom.operators.stretches import fold_features
from seriesloom.staging import stage

FK = ("series_id", "fold", "kind")


@dataclass(frozen=True)
class Backtest:
    """Frames of one evaluation. Training windows copy rows for every fold and are written when a candidate first asks for them.

    ``features`` are those of the baselines where no window is needed for them.
    """

    panel: DataFrame
    folds: DataFrame
    windows: DataFrame
    actuals: DataFrame
    period: int
    horizon: int
    features: DataFrame | None = None

    @cached_property
    def train(self) -> DataFrame:
        return stage(self.windows, "train")

    @cached_property
    def _features(self) -> DataFrame:
        made = self.features if self.features is not None else C.baseline_features(self.train, self.period, FK, ("horizon",))
        return stage(made, "features")

    @cached_property
    def transformed(self) -> DataFrame:
        return stage(transformed_windows(self), "transformed")

    def first_window(self, kind: str) -> DataFrame:
        """Training rows of the first rolling fold, or of the final one; without a copy for the others."""
        mine = F.col("kind") == kind
        if kind == "rolling":
            mine = mine & (F.col("fold") == 0)
        if self.features is None:
            return self.train.filter(mine)
        return impute_training(FO.training_windows(self.panel, self.folds.filter(mine)), keys=FK)

    def baselines(self) -> DataFrame:
        constant = self.panel.groupBy("series_id").agg(
            F.coalesce(F.stddev_pop("value") <= 1e-8, F.lit(False)).alias("_const"))
        return C.baseline_forecasts(self._features.join(constant, "series_id"), self.period, FK, F.col("_const"))

    def smoothing(self) -> DataFrame:
        return C.ses_forecasts(level_fit(self.train, FK, ["horizon"]), FK)

    def candidates(self) -> DataFrame:
        """The baselines each series should get: a constant one only the constant."""
        constant = F.coalesce(F.stddev_pop("value") <= 1e-8, F.lit(False))
        names = F.when(constant, F.array(F.lit("Constant"))).otherwise(F.array(*[F.lit(m) for m in C.BASELINES if m != "Constant"]))
        return self.panel.groupBy("series_id").agg(names.alias("_m")).select("series_id", F.explode("_m").alias("model"))

    def origins(self, predictions: DataFrame, candidates: DataFrame, fits: DataFrame | None = None) -> DataFrame:
        """Status of every origin and candidate, whether it gave rows or not."""
        return OR.origin_status(OR.aligned(OR.due(self.folds, candidates), predictions, self.actuals), fits)

    def errors(self, predictions: DataFrame, kind: str = "rolling") -> DataFrame:
        """Aligned errors with the scale of the first fold (or of the final window)."""
        mine = predictions.filter(F.col("kind") == kind)
        pairs = M.pair_errors(self.actuals, mine, [*FK, "h"])
        return pairs.join(M.naive_scale(self.first_window(kind), self.period), "series_id", "left")


def prepare_training(train: DataFrame, keys=FK, outliers: str = "none", imputation: str = "interpolate",
                     smoothing: str = "none", iqr_clip: bool = False, block: int | None = None) -> DataFrame:
    """Fold-safe preparation in fixed order: outliers, imputation, smoothing, optional clip."""
    out = treat_outliers(train, outliers, keys, population=True)
    out = impute_training(out, imputation, keys, block)
    if smoothing != "none":
        out = smooth(out, smoothing, keys).withColumn("value", F.col("smoothed")).drop("smoothed")
    return winsorise(out, keys) if iqr_clip else out


def backtest(panel: DataFrame, period: int, horizon: int, block: int | None = None, **prep) -> Backtest:
    """Plan folds and fold-safe training windows for a gridded panel (gaps as NULL)."""
    folds = FO.fold_plan(FO.series_sizes(panel), horizon)
    windows = prepare_training(FO.training_windows(panel, folds), FK, block=block, **prep)
    # other preparations than interpolation need each window by itself
    features = None if prep else fold_features(panel, folds, period, block)
    return Backtest(panel, folds, windows, FO.test_windows(panel, folds), period, horizon, features)


def evidence_from(metrics: DataFrame) -> DataFrame:
    """Candidate evidence rows from pooled metrics."""
    ok = F.col("rmse").isNotNull() & F.col("mae").isNotNull()
    rows = metrics.withColumn("status", F.when(ok, "ok").otherwise("failed"))
    return rows.select("series_id", "model", "ord", "status", "mase", "wape", "rmse", "mae", "mape")


def pooled_evidence(bt: Backtest, predictions: DataFrame) -> DataFrame:
    """Pooled rolling-origin metrics as selection evidence."""
    return evidence_from(M.forecast_metrics(bt.errors(predictions), ["series_id", "model", "ord"]))


def baseline_refit(panel: DataFrame, period: int, horizon: int, freq: str, block: int | None = None) -> DataFrame:
    """Every baseline on the full history with its forecast calendar."""
    full = impute_training(panel, "interpolate", block=block)
    ends = full.groupBy("series_id").agg(F.count(F.lit(1)).alias("train_end"), F.max("ts").alias("last_ts"))
    rows = full.join(ends, "series_id").withColumn("horizon", F.lit(horizon))
    feats = C.baseline_features(rows, period, ("series_id",), ("horizon", "last_ts", "train_end"))
    stamps = feats.select("series_id", F.posexplode(future_stamps(F.col("last_ts"), horizon, freq)).alias("_i", "ts"))
    preds = C.baseline_forecasts(feats, period, ("series_id",))
    return preds.join(stamps.withColumn("h", F.col("_i") + 1).drop("_i"), ["series_id", "h"])


def with_fallback(refits: DataFrame, chosen: DataFrame, order: list[str]) -> DataFrame:
    """Forecast rows of one model per series, and how it came to be: ``status``.

    ``ok``: the selected model; ``fallback``: a series without a selection, or whose
    selected model has no refit, takes the first of ``order`` that has one.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("model")).cast("int"), F.lit(0))
    have = refits.groupBy("series_id", "model").agg(F.min("ord").alias("_o")).join(chosen.select("series_id", F.col("model").alias("_want"), *[c for c in chosen.columns if c not in ("series_id", "model")]), "series_id", "left")
    mine = F.coalesce(F.col("model") == F.col("_want"), F.lit(False))
    rank = F.struct((~mine).alias("other"), (place == 0).alias("unlisted"), place.alias("p"), F.col("_o").alias("o"))
    extra = [c for c in chosen.columns if c not in ("series_id", "model")]
    best = have.groupBy("series_id").agg(F.min_by(F.struct("model", F.when(mine, "ok").otherwise("fallback").alias("status"), *[F.when(mine, F.col(c)).alias(c) for c in extra]), rank).alias("_b"))
    return refits.join(best.select("series_id", "_b.*"), ["series_id", "model"])


def best_baseline_forecast(panel: DataFrame, period: int, horizon: int, freq: str,
                           loss: str = "rmse") -> DataFrame:
    """Select the best baseline per series by rolling-origin loss and forecast with it; no series is lost."""
    bt = backtest(panel, period, horizon)
    chosen = select_models(pooled_evidence(bt, bt.baselines()), (loss,)).select(
        "series_id", F.col("selected_model").alias("model"), "selected_rmse")
    return with_fallback(baseline_refit(panel, period, horizon, freq), chosen, list(C.BASELINES))


def transform_choice(panel: DataFrame) -> DataFrame:
    """Series whose skewness exceeds one, with the transform their sign allows."""
    return constant_and_skew(panel).filter(F.col("transform").isNotNull()).select("series_id", "transform")


def transformed_windows(bt: Backtest, keys=FK) -> DataFrame:
    """Training windows of triggered series on the transformed scale, with parameters."""
    rows = bt.train.join(transform_choice(bt.panel), "series_id")
    bc = X.fit_box_cox(rows.filter(F.col("transform") == "Box-Cox"), keys).select(*keys, "lmbda", "shift")
    yj = X.fit_yeo_johnson(rows.filter(F.col("transform") == "Yeo-Johnson"), keys).select(
        *keys, "lmbda", F.lit(0.0).alias("shift"))
    params = bc.unionByName(yj).filter(F.col("lmbda").isNotNull())
    joined = rows.join(params, list(keys))
    value = F.when(F.col("transform") == "Box-Cox", X.box_cox(F.col("value"), F.col("lmbda"), F.col("shift"))).otherwise(
        X.yeo_johnson(F.col("value"), F.col("lmbda")))
    return joined.withColumn("value", value)


def back_transform(y, transform, lam, shift):
    return F.when(transform == "Box-Cox", X.box_cox_inverse(y, lam, shift)).otherwise(X.yeo_johnson_inverse(y, lam))


def untransform_fits(fits: DataFrame) -> DataFrame:
    """Long predictions on the original scale: smeared point, plain inverse bounds."""
    inv = lambda y: back_transform(y, F.col("transform"), F.col("lmbda"), F.col("shift"))
    rows = fits.withColumns({
        "yhat": F.transform("yhat", lambda y: X.smeared_inverse(y, F.col("resid"), inv)),
        "lo": F.transform("lo", inv), "hi": F.transform("hi", inv),
        "model": F.concat("model", F.lit(" + "), "transform"), "ord": F.col("ord") + 20})
    return FT.fit_rows(rows, FK)


def transformed_smoothing(bt: Backtest) -> DataFrame:
    """Simple smoothing fitted on the transformed scale and mapped back."""
    extra = ("horizon", "transform", "lmbda", "shift")
    fit = level_fit(bt.transformed, FK, extra, with_resid=True)
    flat = lambda c: F.array_repeat(c, F.col("horizon").cast("int"))
    fits = fit.select(
        *FK, *extra, "resid", "status", F.lit("EWMA").alias("model"), F.lit(3).alias("ord"), flat(F.col("level")).alias("yhat"),
        flat(F.col("level") + F.col("band_lo")).alias("lo"), flat(F.col("level") + F.col("band_hi")).alias("hi"))
    return untransform_fits(fits)


def transformed_kernels(bt: Backtest) -> DataFrame:
    """Solver-backed candidates fitted on the transformed scale and mapped back."""
    windows = stage(pack(bt.transformed, FK, carry=["horizon", "transform", "lmbda", "shift"]), "windows")
    params = windows.select(*FK, "transform", "lmbda", "shift")
    plain = windows.select(*FK, "horizon", "x")
    fits = FT.arima(plain, FK).unionByName(FT.sarima(plain, bt.period, FK)).unionByName(
        FT.holt_winters(plain, bt.period, FK))
    return untransform_fits(fits.join(params, list(FK)))


def all_predictions(bt: Backtest, transformed: bool = True) -> DataFrame:
    """Every candidate's predictions on identical folds, as one long table."""
    windows = stage(pack(bt.train, FK, carry=["horizon"]), "windows")
    kernels = [FT.fit_rows(f, FK) for f in (
        FT.arima(windows, FK), FT.sarima(windows, bt.period, FK), FT.holt_winters(windows, bt.period, FK))]
    out = bt.baselines()
    for part in (*kernels, bt.smoothing().drop("status")):
        out = out.unionByName(part, allowMissingColumns=True)
    if transformed:
        out = out.unionByName(transformed_smoothing(bt), allowMissingColumns=True)
        out = out.unionByName(transformed_kernels(bt), allowMissingColumns=True)
    return stage(out, "predictions")


def production_fits(panel: DataFrame, period: int, horizon: int, freq: str) -> DataFrame:
    """Every candidate refitted on the full history, as long forecasts with dates."""
    full = impute_training(panel, "interpolate")
    ends = full.groupBy("series_id").agg(F.count(F.lit(1)).alias("train_end"), F.max("ts").alias("last_ts"))
    rows = full.join(ends, "series_id").withColumns({
        "horizon": F.lit(horizon).cast("long"), "fold": F.lit(0), "kind": F.lit("production")})
    bt = Backtest(panel, ends, rows, rows, period, horizon)
    preds = all_predictions(bt)
    stamps = ends.select("series_id", F.posexplode(future_stamps(F.col("last_ts"), horizon, freq)).alias("_i", "ts"))
    return preds.drop("fold", "kind").join(stamps.withColumn("h", F.col("_i") + 1).drop("_i"), ["series_id", "h"])


def production_forecast(panel: DataFrame, period: int, horizon: int, freq: str, loss: str = "mase") -> DataFrame:
    """Selected model per series by rolling-origin loss, refitted and forecast; no series is lost (``with_fallback``)."""
    bt = backtest(panel, period, horizon)
    chosen = select_models(pooled_evidence(bt, all_predictions(bt)), (loss,)).select(
        "series_id", F.col("selected_model").alias("model"))
    return with_fallback(production_fits(panel, period, horizon, freq), chosen, ["Seasonal Naive", "Naive", "Drift", "Mean Forecast", "Constant"])
