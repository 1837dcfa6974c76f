"""Transform, fitted-candidate and residual-diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.kernels.rows import pack
from seriesloom.operators import fitted as FT
from seriesloom.operators import metrics as M
from seriesloom.operators import pairs as PR
from seriesloom.operators import residuals as R
from seriesloom.operators import selection as S
from seriesloom.operators import trend as T
from seriesloom.operators import transforms as X
from seriesloom.plans import evaluation as E
from seriesloom.plans import panels as P
from seriesloom.plans.backtesting import segment_backtest, supplier_backtest
from seriesloom.plans.evaluation import FK
from seriesloom.plans.registry import cte, query


def _r(*names, digits=5):
    return [F.round(F.col(n), digits).alias(n) for n in names]


cte("bc_best", """
WITH p AS (SELECT series_id, ln(value + CASE WHEN min(value) OVER w <= 0 THEN abs(min(value) OVER w) + 1 ELSE 0 END) AS l FROM sup_prep WINDOW w AS (PARTITION BY series_id)),
z AS (SELECT series_id, exp(l - avg(l) OVER (PARTITION BY series_id)) AS z FROM p),
s AS (SELECT series_id, i / 100.0::DOUBLE AS lam, var_pop(CASE WHEN i = 0 THEN ln(z) ELSE (z ** (i / 100.0::DOUBLE) - 1) / (i / 100.0::DOUBLE) END) AS v
  FROM z, (SELECT unnest(range(-200, 201)) AS i) GROUP BY 1, 2)
SELECT series_id, arg_min(lam, v) AS lmbda FROM s GROUP BY 1""")


@query("boxcox_lambda", "SELECT series_id, round(lmbda, 2) AS lmbda FROM bc_best")
def boxcox_lambda(spark, d):
    return X.fit_box_cox(P.supplier_prep(spark, d)).select("series_id", *_r("lmbda", digits=2))


@query("boxcox_forward", """
SELECT series_id, t, round(CASE WHEN abs(lmbda) < 1e-8 THEN ln(value) ELSE (value ** lmbda - 1) / lmbda END, 4) AS transformed
FROM sup_prep JOIN bc_best USING (series_id)""")
def boxcox_forward(spark, d):
    panel = P.supplier_prep(spark, d)
    params = X.fit_transforms(panel, with_box_cox=True)
    return X.apply_transforms(panel, params).select("series_id", "t", *_r("transformed", digits=4))


@query("transform_roundtrip", """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM sup_prep GROUP BY 1)
SELECT series_id, t, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS back FROM sup_prep JOIN q USING (series_id)""")
def transform_roundtrip(spark, d):
    panel = P.supplier_prep(spark, d)
    params = X.fit_transforms(panel, iqr_clip=True, with_box_cox=True)
    done = X.apply_transforms(panel, params).withColumn("back", F.col("transformed"))
    return X.invert_transforms(done, params, "back").select("series_id", "t", *_r("back", digits=6))


@query("yeojohnson_lambda", """
WITH x AS (SELECT series_id, value - 50 AS x FROM day_prep),
s AS (SELECT series_id, i / 100.0::DOUBLE AS lam, -count(*) / 2.0 * ln(var_pop(CASE
   WHEN x >= 0 THEN CASE WHEN i = 0 THEN ln(x + 1) ELSE ((x + 1) ** (i / 100.0::DOUBLE) - 1) / (i / 100.0::DOUBLE) END
   ELSE CASE WHEN i = 200 THEN -ln(1 - x) ELSE -((1 - x) ** (2 - i / 100.0::DOUBLE) - 1) / (2 - i / 100.0::DOUBLE) END END))
   + (i / 100.0::DOUBLE - 1) * sum(sign(x) * ln(abs(x) + 1)) AS llf
  FROM x, (SELECT unnest(range(-200, 201)) AS i) GROUP BY 1, 2, i)
SELECT series_id, round(arg_max(lam, llf), 2) AS lmbda FROM s GROUP BY 1""")
def yeojohnson_lambda(spark, d):
    panel = P.day_prep(spark, d).withColumn("value", F.col("value") - 50)
    return X.fit_yeo_johnson(panel).select("series_id", *_r("lmbda", digits=2))


@query("log_transform", """
SELECT series_id, t, round(ln(value + CASE WHEN min(value) OVER (PARTITION BY series_id) <= 0 THEN abs(min(value) OVER (PARTITION BY series_id)) + 1 ELSE 0 END), 6) AS transformed FROM sup_prep""")
def log_transform(spark, d):
    panel = P.supplier_prep(spark, d)
    return X.log_forward(panel, X.positive_shift(panel)).select("series_id", "t", *_r("transformed", digits=6))


@query("smearing_inverse", """
WITH e AS (SELECT series_id, ln(value) - avg(ln(value)) OVER (PARTITION BY series_id) AS e, avg(ln(value)) OVER (PARTITION BY series_id) AS m FROM sup_prep)
SELECT series_id, round(avg(exp(m + e)), 4) AS smeared, round(exp(any_value(m)), 4) AS naive FROM e GROUP BY 1""")
def smearing_inverse(spark, d):
    logs = P.supplier_prep(spark, d).withColumn("l", F.ln("value"))
    mean = logs.groupBy("series_id").agg(F.avg("l").alias("m"))
    resid = logs.join(mean, "series_id").groupBy("series_id", "m").agg(F.collect_list(F.col("l") - F.col("m")).alias("e"))
    return resid.select("series_id", F.round(X.smeared_inverse(F.col("m"), F.col("e"), F.exp), 4).alias("smeared"),
                        F.round(F.exp("m"), 4).alias("naive"))


@query("remediation", """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, avg(value) mu, stddev_samp(value) sd FROM sup_prep GROUP BY 1)
SELECT series_id, t, round(CASE CAST(series_id AS INTEGER) % 3 WHEN 0 THEN least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))
  WHEN 1 THEN least(greatest(value, mu - 3 * sd), mu + 3 * sd) ELSE value END, 7) AS value FROM sup_prep JOIN q USING (series_id)""")
def remediation(spark, d):
    k = F.pmod(F.col("series_id").cast("int"), F.lit(3))
    choice = F.when(k == 0, "iqr_clip").when(k == 1, "zscore_clip").otherwise("none")
    return X.remediate(P.supplier_prep(spark, d), choice).select("series_id", "t", *_r("value", digits=7))


@query("theil_sen", """
SELECT a.series_id, round(quantile_cont((b.value - a.value) / (b.t - a.t), 0.5), 5) AS sen_slope
FROM sup_prep a JOIN sup_prep b ON b.series_id = a.series_id AND b.t > a.t GROUP BY 1""")
def theil_sen(spark, d):
    return PR.monotone_trend(P.supplier_prep(spark, d)).select("series_id", *_r("sen_slope"))


@query("kendall_tau", """
WITH s AS (SELECT a.series_id, sum(sign(b.value - a.value)) AS s, count(*) AS n, count(*) FILTER (b.value <> a.value) AS u
  FROM sup_prep a JOIN sup_prep b ON b.series_id = a.series_id AND b.t > a.t GROUP BY 1)
SELECT series_id, round(s / sqrt(n * u), 6) AS tau FROM s""")
def kendall_tau(spark, d):
    return PR.monotone_trend(P.supplier_prep(spark, d)).select("series_id", *_r("tau", digits=6))


@query("monotone_trend")
def monotone_trend(spark, d):
    return PR.monotone_trend(P.supplier_prep(spark, d))


@query("adf")
def adf(spark, d):
    return FT.adf(P.supplier_prep(spark, d))


@query("stationarity_class")
def stationarity_class(spark, d):
    panel = P.supplier_prep(spark, d)
    return R.stationarity(panel)


@query("stl")
def stl(spark, d):
    return FT.stl(P.supplier_prep(spark, d), 12)


@query("seasonality_evidence")
def seasonality_evidence(spark, d):
    return R.seasonality(P.supplier_prep(spark, d), "MS")


@query("stl_anomalies")
def stl_anomalies(spark, d):
    from seriesloom.operators import anomalies as A

    return A.anomaly_summary(A.mad_flags(FT.stl(P.supplier_prep(spark, d), 12)))


@query("binary_segmentation")
def binary_segmentation(spark, d):
    return FT.split_points(P.supplier_prep(spark, d))


@query("arch_lm")
def arch_lm(spark, d):
    return FT.arch_effects(T.detrend(P.supplier_prep(spark, d)))


@query("shapiro")
def shapiro(spark, d):
    return FT.normality(T.detrend(P.supplier_prep(spark, d)), ["series_id"], "resid")


def fold_windows(bt):
    return pack(bt.train, FK, carry=["horizon"])


@query("holt_winters")
def holt_winters(spark, d):
    return FT.holt_winters(fold_windows(segment_backtest(spark, d)), 12, FK)


@query("arima_grid")
def arima_grid(spark, d):
    return FT.arima(fold_windows(segment_backtest(spark, d)), FK)


@query("sarima_grid")
def sarima_grid(spark, d):
    return FT.sarima(fold_windows(segment_backtest(spark, d)), 12, FK)


@query("transformed_candidates")
def transformed_candidates(spark, d):
    bt = E.backtest(P.gridded(P.user_day_raw(spark, d), "D"), 7, 5)
    return E.transformed_smoothing(bt)


@query("full_model_selection")
def full_model_selection(spark, d):
    bt = segment_backtest(spark, d)
    return S.select_models(E.pooled_evidence(bt, E.all_predictions(bt)), ("mase", "rmse"))


@query("production_forecast")
def production_forecast(spark, d):
    panel = P.gridded(P.segment_raw(spark, d), "MS")
    return E.production_forecast(panel, 12, 12, "MS")


@query("residual_mean_ci", """
SELECT series_id, model, count(*) AS n_errors, round(avg(y - yhat), 4) AS mean, round(stddev_samp(y - yhat) / sqrt(count(*)), 4) AS se
FROM sup_err WHERE kind = 'rolling' AND y IS NOT NULL GROUP BY 1, 2""")
def residual_mean_ci(spark, d):
    bt = supplier_backtest(spark, d)
    return R.mean_interval(bt.errors(bt.baselines())).select("series_id", "model", "n_errors", *_r("mean", "se", digits=4))


@query("backtest_error_diagnostics")
def backtest_error_diagnostics(spark, d):
    bt = supplier_backtest(spark, d)
    return R.error_diagnostics(bt.errors(bt.smoothing()))


@query("innovation_diagnostics")
def innovation_diagnostics(spark, d):
    fits = FT.arima(fold_windows(segment_backtest(spark, d)).filter(F.col("kind") == "final"), FK)
    return R.innovation_diagnostics(fits)


@query("interval_calibration")
def interval_calibration(spark, d):
    bt = segment_backtest(spark, d)
    errors = bt.errors(bt.smoothing())
    return R.calibrate(bt.smoothing().filter(F.col("kind") == "final"), M.interval_scores(errors))
