"""Fitted candidates and kernel-backed diagnostics over packed windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.kernels import arima as AR
from seriesloom.kernels import smoothing as HW
from seriesloom.kernels import series_tests as KT
from seriesloom.kernels.loess import stl as stl_kernel
from seriesloom.kernels.rows import pack, run_rows
from seriesloom.kernels.unit_root import adf as adf_kernel

KEYS = ("series_id",)
FIT_SCHEMA = ("status string, reason string, yhat array<double>, lo array<double>, hi array<double>, "
              "resid array<double>, ar_ma_order int, config map<string,string>")


def _failed(reason: str, status: str = "not_estimable") -> dict:
    return {"status": status, "reason": reason}


def holt_winters(windows: DataFrame, period: int, keys: Sequence[str]) -> DataFrame:
    """Best exponential-smoothing form per window by AICc.

    ``windows`` is packed (``x`` plus ``horizon``). Each admissible form is its
    own row, so a window's forms run in parallel; the winner is a ``min_by``.
    """
    size = F.size("x")
    seasonal = (F.lit(period) > 1) & (size >= 2 * period)
    positive = F.forall("x", lambda v: v > 0)
    forms = F.filter(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (_, _, s) in enumerate(HW.FORMS)]),
        lambda f: (f["s"] == "none") | (seasonal & ((f["s"] == "add") | positive)))
    fan = windows.withColumn("form", F.explode(F.transform(forms, lambda f: f["i"])))

    def fit(x: np.ndarray, row: dict) -> dict:
        form, h = HW.FORMS[row["form"]], int(row["horizon"])
        try:
            if len(x) < 3:
                return _failed("too few observations")
            got = HW.fit_form(x, period, form)
            if got["aicc"] is None:
                return _failed("recursion diverged")
            point = HW.forecast_form(got, len(x), period, form, h)
            lo, hi = HW.cumulative_band(point, got["resid"], 42 + int(row.get("fold") or 0))
            cfg = {"model": "Holt-Winters", "trend": form[0], "damped": str(form[1]).lower(), "seasonal": form[2],
                   "aicc": f"{got['aicc']:.6f}", "selection_criterion": "aicc"}
            return {"status": "ok", "yhat": point.tolist(), "lo": lo.tolist(), "hi": hi.tolist(),
                    "resid": got["resid"].tolist(), "ar_ma_order": 0, "config": cfg, "aicc": float(got["aicc"])}
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as exc:
            return _failed(str(exc), "failed")

    tried = run_rows(fan, fit, FIT_SCHEMA + ", aicc double", [*keys, "form"])
    fields = ["status", "reason", "yhat", "lo", "hi", "resid", "ar_ma_order", "config"]
    order = F.struct((F.col("status") != "ok").alias("bad"), F.coalesce("aicc", F.lit(float("inf"))).alias("a"), F.col("form"))
    best = tried.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_f"))
    return best.select(*keys, F.lit("Holt-Winters").alias("model"), F.lit(2).alias("ord"), "_f.*")


def _arima_row(x: np.ndarray, row: dict, model: str, period: int, options: dict) -> dict:
    try:
        if len(x) < 3:
            last = float(x[-1]) if len(x) else 0.0
            flat = [last] * int(row["horizon"])
            return {**_failed("at least three observations are needed"), "yhat": flat, "lo": flat, "hi": flat}
        strength = None
        if period > 1 and len(x) >= 2 * period and options.get("max_sp"):
            season, _, resid = stl_kernel(x, period)
            both = np.var(season + resid)
            strength = float(max(0.0, 1 - np.var(resid) / both)) if both > 0 else 0.0
        got = AR.fit_arima(x, int(row["horizon"]), m=period, seasonal_strength=strength, **options)
        good = got["converged"] and got["stationary"] and got["invertible"]
        cfg = {"model": model, "order": str(got["order"]), "seasonal_order": str(got["seasonal_order"]),
               "aicc": f"{got['aicc']:.6f}", "converged": str(got["converged"]).lower(),
               "stationary_roots": str(got["stationary"]).lower(), "invertible_roots": str(got["invertible"]).lower(),
               "with_intercept": str(got["with_intercept"]).lower()}
        return {"status": "ok" if good else "degraded", "yhat": got["point"].tolist(), "lo": got["lo"].tolist(),
                "hi": got["hi"].tolist(), "resid": got["resid"].tolist(), "ar_ma_order": got["ar_ma_order"], "config": cfg}
    except (ValueError, FloatingPointError, np.linalg.LinAlgError) as exc:
        return _failed(str(exc), "failed")


def arima(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-seasonal candidate: p, q up to 5, d up to 2."""
    out = run_rows(windows, lambda x, row: _arima_row(x, row, "ARIMA", 1, {"max_p": 5, "max_q": 5}), FIT_SCHEMA, list(keys))
    return out.select(*keys, F.lit("ARIMA").alias("model"), F.lit(0).alias("ord"), *_fit_fields())


def sarima(windows: DataFrame, period: int, keys: Sequence[str]) -> DataFrame:
    """Seasonal candidate: p, q up to 3, P, Q up to 2, D up to 1; plain below two cycles."""
    options = {"max_p": 3, "max_q": 3, "max_sp": 2, "max_sq": 2, "max_order": 10}
    out = run_rows(windows, lambda x, row: _arima_row(x, row, "SARIMA", period, options), FIT_SCHEMA, list(keys))
    return out.select(*keys, F.lit("SARIMA").alias("model"), F.lit(1).alias("ord"), *_fit_fields())


def _fit_fields() -> list[str]:
    return ["status", "reason", "yhat", "lo", "hi", "resid", "ar_ma_order", "config"]


def fit_rows(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long predictions ``h, yhat, lo, hi`` of usable fits; others give no rows."""
    ok = fits.filter((F.col("status") == "ok") & F.col("yhat").isNotNull())
    zipped = F.arrays_zip(F.col("yhat").alias("yhat"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    steps = ok.select(*keys, "model", "ord", F.posexplode(zipped).alias("_i", "_v"))
    return steps.select(*keys, "model", "ord", (F.col("_i") + 1).alias("h"), "_v.yhat", "_v.lo", "_v.hi")


def adf(df: DataFrame, spec: str = "c", keys: Sequence[str] = KEYS) -> DataFrame:
    """Unit-root statistic, p-value and chosen lag per series."""
    return run_rows(pack(df, keys), lambda x, row: adf_kernel(x, spec),
                    "statistic double, p_value double, lags int", list(keys))


def stl(df: DataFrame, period: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Robust decomposition in long form; series under two cycles give no rows."""

    def fit(x: np.ndarray, row: dict) -> dict:
        if len(x) < 2 * period:
            return {"seasonal": [], "trend": [], "resid": []}
        season, trend, resid = stl_kernel(x, period)
        return {"seasonal": season.tolist(), "trend": trend.tolist(), "resid": resid.tolist()}

    parts = run_rows(pack(df, keys), fit, "seasonal array<double>, trend array<double>, resid array<double>", list(keys))
    zipped = F.arrays_zip("seasonal", "trend", "resid")
    return parts.select(*keys, F.posexplode(zipped).alias("t", "_v")).select(*keys, F.col("t").cast("long"), "_v.*")


def split_points(df: DataFrame, min_segment: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calibrated change points per series."""

    def fit(x: np.ndarray, row: dict) -> dict:
        if len(x) < 20:
            return {"status": "not_estimable", "change_points": []}
        return {"status": "ok", "change_points": KT.split_points(x, min_segment)}

    return run_rows(pack(df, keys), fit, "status string, change_points array<int>", list(keys))


def arch_effects(resid: DataFrame, keys: Sequence[str] = KEYS, column: str = "resid") -> DataFrame:
    return run_rows(pack(resid, keys, column), lambda x, row: KT.arch_lm(x),
                    "status string, statistic double, p_value double, has_arch boolean", list(keys))


def normality(df: DataFrame, keys: Sequence[str], column: str, order: str = "t") -> DataFrame:
    """Normality statistic and p-value; outside 3..5000 values both are NULL."""
    return run_rows(pack(df, keys, column, pos=order), lambda x, row: KT.shapiro_wilk(x),
                    "statistic double, p_value double", list(keys))


def calibrate_interval(lo: Column, hi: Column, coverage: Column, t_nominal: Column, t_empirical: Column) -> Column:
    """Scale the half width by the ratio of quantiles; skipped at coverage 0 or 1."""
    usable = (coverage > 0) & (coverage < 1) & (t_empirical > 0)
    scale = F.when(usable, t_nominal / t_empirical).otherwise(1.0)
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    return F.struct((mid - half * scale).alias("lo"), (mid + half * scale).alias("hi"))
