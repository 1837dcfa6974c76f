"""Review and report queries over evidence computed from the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import anomalies as A
from seriesloom.operators import decompose as DE
from seriesloom.operators import dependence as D
from seriesloom.operators import metrics as M
from seriesloom.operators import outliers as O
from seriesloom.operators import quality as Q
from seriesloom.operators import report as G
from seriesloom.operators import review as R
from seriesloom.operators import trend as T
from seriesloom.operators.grid import missing_periods
from seriesloom.operators.impute import interpolate_position
from seriesloom.plans import evaluation as E
from seriesloom.plans import panels as P
from seriesloom.plans.backtesting import HORIZON, PERIOD, supplier_backtest
from seriesloom.plans.cleaning import _DECOMP
from seriesloom.plans.registry import cte, query
from seriesloom.staging import stage


def _r(*names, digits=4):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def supplier_panels(spark, d):
    """The staged supplier rows and their staged grid, for queries with several readers of them."""
    raw = stage(P.supplier_raw(spark, d), "raw")
    return raw, P.gridded_rows(raw, "MS")


def evidence(spark, d, panels=None):
    """One staged evidence row per supplier, every value derived from its series."""
    raw, grid = panels or supplier_panels(spark, d)
    bt = E.backtest(grid, PERIOD, HORIZON)
    raw = P.dealt(raw)
    prep = P.dealt(stage(interpolate_position(bt.panel), "panel"))
    preds = stage(bt.baselines(), "predictions")
    pooled = M.forecast_metrics(bt.errors(preds), ["series_id", "model"])
    # the errors are aggregated once for the best candidate and the drift
    drift = F.max(F.when(F.col("model") == "Drift", F.struct("mape", "rmse", "mae")))
    best = pooled.groupBy("series_id").agg(F.min("rmse").alias("best_rmse"), F.min_by("model", "rmse").alias("best_model"), drift.alias("_drift"))
    best = best.filter(F.col("_drift").isNotNull()).select("series_id", "best_rmse", "best_model", "_drift.*")
    final = M.forecast_metrics(bt.errors(preds, "final"), ["series_id", "model"]).filter(F.col("model") == "Drift")
    counts = Q.base_counts(raw).select("series_id", "row_count", "missing_values", "duplicate_stamps")
    gaps = missing_periods(raw, "MS").select("series_id", "missing_periods", "is_regular")
    out = O.iqr_report(raw).select("series_id", "outlier_count", "outlier_ratio")
    fit = T.linear_fit(prep)
    t_abs = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    fit = fit.select("series_id", (t_abs > 1.96).alias("has_trend"), F.col("slope").alias("trend_slope"),
                     (F.col("r2") < 0.02).alias("is_stationary_adf"))
    rho = D.acf_arrays(prep, 1).select("series_id", F.get("acf", F.lit(0)).alias("_r1"))
    parts = DE.classical_decompose(prep, 12).groupBy("series_id").agg(
        DE.seasonal_strength(F.col("resid"), F.col("seasonal")).alias("_ss"))
    cus = A.cusum_split(prep)
    sd = prep.groupBy("series_id").agg(F.stddev_samp("value").alias("_sd"))
    def joined(*tables):
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.join(table, "series_id")
        return rows

    # staged apart, so that no task holds the sorts of all summaries at once
    quality = stage(joined(counts, gaps, out), "quality")
    shape = stage(joined(fit, rho, parts, cus, sd), "shape")
    rows = joined(quality, shape, best, final.select("series_id", F.col("rmse").alias("final_rmse")))
    rows = rows.withColumn("seasonal_period", F.when(F.col("_ss") >= 0.35, 12).otherwise(1)).withColumn(
        "is_white_noise", F.abs("_r1") < 0.05)
    order = G.preference(F.col("seasonal_period"), F.col("has_trend"), F.col("trend_slope"), F.col("is_white_noise"))
    done = rows.select(
        "series_id", "row_count", "missing_values", "duplicate_stamps", "missing_periods", "is_regular", "outlier_count",
        "outlier_ratio", "has_trend", "trend_slope", "is_stationary_adf",
        F.col("is_stationary_adf").alias("is_stationary_kpss"), "is_white_noise", "seasonal_period",
        (F.col("max_abs_cusum") > 6 * F.col("_sd")).alias("has_breaks"), "best_rmse", "best_model", "mape", "rmse", "mae",
        "final_rmse", order.alias("preference"), F.get(order, F.lit(0)).alias("model"),
        F.lit("deterministic").alias("selection_method"), F.lit("").alias("explanation"),
        F.array().cast("array<string>").alias("remediation"), (F.abs("_r1") < 0.2).alias("is_uncorrelated"),
        F.lit(None).cast("double").alias("ljung_box_p"), F.lit(None).cast("boolean").alias("is_normal"),
        F.lit(None).cast("double").alias("shapiro_p"), F.lit(True).alias("is_zero_mean"),
        F.lit(0.0).alias("residual_mean"), F.lit("MS").alias("frequency"),
        F.lit("prediction_interval").alias("interval_label"))
    return stage(done, "evidence")


cte("sup_dec", _DECOMP.strip() + "\nSELECT * FROM dec")
cte("rule_ev", """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM sup_raw GROUP BY 1),
o AS (SELECT series_id, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(*) AS row_count,
  date_diff('month', min(ts), max(ts)) + 1 - count(*) AS missing_periods FROM sup_raw JOIN q USING (series_id) GROUP BY 1),
ss AS (SELECT series_id, least(1, greatest(0, 1 - var_pop(resid) / var_pop(resid + seasonal))) AS ss FROM sup_dec GROUP BY 1),
r1 AS (SELECT series_id, acf AS r1 FROM sup_acf WHERE lag = 1),
cu AS (SELECT series_id, max(abs(cusum)) > 6 * any_value(sd) AS has_breaks FROM sup_cusum GROUP BY 1),
pm AS (SELECT series_id, mape, rmse FROM sup_pool WHERE model = 'Drift'),
bm AS (SELECT series_id, min(rmse) AS best_rmse, arg_min(model, rmse) AS best_model FROM sup_pool GROUP BY 1),
fi AS (SELECT series_id, sqrt(avg((y - yhat) ** 2)) AS final_rmse FROM sup_err WHERE kind = 'final' AND model = 'Drift' AND y IS NOT NULL GROUP BY 1),
j AS (SELECT o.*, outlier_count / row_count AS outlier_ratio, sqrt(r2 * (n - 2) / (1 - r2)) > 1.96 AS has_trend, slope AS trend_slope, r2 < 0.02 AS is_stationary_adf,
   abs(r1) < 0.05 AS is_white_noise, abs(r1) < 0.2 AS is_uncorrelated, CASE WHEN ss >= 0.35 THEN 12 ELSE 1 END AS seasonal_period, has_breaks, mape, rmse, best_rmse, best_model, final_rmse
  FROM o JOIN ss USING (series_id) JOIN r1 USING (series_id) JOIN cu USING (series_id) JOIN pm USING (series_id) JOIN bm USING (series_id) JOIN fi USING (series_id) JOIN sup_fit USING (series_id))
SELECT *, missing_periods = 0 AS is_regular, CASE WHEN seasonal_period > 1 THEN 'SARIMA' WHEN has_trend AND abs(trend_slope) > 0.1 THEN 'Holt-Winters'
  WHEN is_white_noise THEN 'EWMA' ELSE 'ARIMA' END AS model FROM j""")
cte("rule_fl", """
SELECT series_id, unnest([CASE WHEN seasonal_period > 1 AND model = 'ARIMA' THEN 'model_selection:critical:season' END,
  CASE WHEN NOT is_stationary_adf AND model = 'EWMA' THEN 'model_selection:critical:ewma' END,
  CASE WHEN mape > 20 THEN 'forecasting:warning:mape' END, CASE WHEN outlier_ratio > 0.05 THEN 'statistical:warning:outlier' END,
  CASE WHEN has_trend AND model = 'EWMA' THEN 'model_selection:warning:trend' END,
  CASE WHEN best_rmse > 0 AND rmse / best_rmse > 1.5 THEN 'model_selection:critical:rmse' END,
  CASE WHEN NOT is_uncorrelated THEN 'forecasting:warning:autocorrelation' END]) AS f FROM rule_ev""")
cte("rule_vd", """
SELECT e.*, coalesce(c.crit, false) AS has_crit, CASE WHEN c.crit THEN 'warn' ELSE 'pass' END AS verdict,
  coalesce(c.fresh, true) AS distinct_concern,
  CASE WHEN missing_periods <= 0 THEN CASE WHEN outlier_ratio > 0.05 THEN 'Fair' ELSE 'Good' END WHEN missing_periods <= 3 THEN 'Fair' ELSE 'Poor' END AS quality
FROM rule_ev e LEFT JOIN (SELECT series_id, bool_or(f LIKE '%:critical:%') AS crit,
   bool_or(f LIKE '%:season' OR f LIKE '%:rmse' OR f LIKE '%:autocorrelation' OR f LIKE '%:warning:trend') AS fresh
  FROM rule_fl WHERE f IS NOT NULL GROUP BY 1) c USING (series_id)""")
cte("rule_sc", """
SELECT *, greatest(0, least(100, 100 - CASE WHEN mape > 20 THEN 20 WHEN mape > 10 THEN 10 WHEN mape > 5 THEN 5 ELSE 0 END
  - CASE WHEN final_rmse / rmse >= 1.25 THEN 10 ELSE 0 END - CASE WHEN NOT is_stationary_adf THEN 10 ELSE 0 END
  - CASE WHEN is_white_noise THEN 15 ELSE 0 END - CASE WHEN outlier_ratio > 0.05 THEN 5 ELSE 0 END
  - CASE WHEN missing_periods > 0 THEN 5 ELSE 0 END - CASE WHEN has_breaks THEN 5 ELSE 0 END
  - CASE WHEN verdict = 'warn' AND distinct_concern THEN 10 ELSE 0 END)) AS score FROM rule_vd""")


def reviewed(spark, d, panels=None):
    return R.review(evidence(spark, d, panels))


def scored(spark, d, panels=None):
    rows = reviewed(spark, d, panels)
    issues = F.col("missing_periods") * 0  # gaps are counted separately from validation issues here
    rating = G.quality_rating(F.col("missing_values"), F.col("duplicate_stamps"), F.col("missing_periods"), issues,
                              F.col("is_regular"), F.col("outlier_ratio"))
    return G.confidence(rows.withColumn("quality", rating))


@query("rule_evidence", """
SELECT series_id, row_count, missing_periods, outlier_count, has_trend, is_stationary_adf, is_white_noise, seasonal_period, has_breaks,
  best_model, round(mape, 4) AS mape, round(rmse, 4) AS rmse, round(final_rmse, 4) AS final_rmse, model FROM rule_ev""")
def rule_evidence(spark, d):
    return evidence(spark, d).select("series_id", "row_count", "missing_periods", "outlier_count", "has_trend", "is_stationary_adf",
                                     "is_white_noise", "seasonal_period", "has_breaks", "best_model",
                                     *_r("mape", "rmse", "final_rmse"), "model")


@query("review_flags", """
SELECT series_id, split_part(f, ':', 1) AS agent, split_part(f, ':', 2) AS severity, count(*) AS n FROM rule_fl WHERE f IS NOT NULL GROUP BY 1, 2, 3""")
def review_flags(spark, d):
    return R.flag_rows(reviewed(spark, d)).groupBy("series_id", "agent", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("review_verdict", "SELECT series_id, verdict, has_crit AS override_allowed FROM rule_vd")
def review_verdict(spark, d):
    return reviewed(spark, d).select("series_id", "verdict", "override_allowed")


@query("confidence_score", """
SELECT series_id, score, CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Medium' ELSE 'Low' END AS confidence FROM rule_sc""")
def confidence_score(spark, d):
    return scored(spark, d).select("series_id", "score", "confidence")


@query("quality_rating", """
SELECT series_id, quality, round(row_count / (row_count + missing_periods) * 100, 1) AS completeness_pct FROM rule_vd""")
def quality_rating(spark, d):
    return scored(spark, d).select("series_id", "quality", F.round(
        F.col("row_count") / (F.col("row_count") + F.col("missing_periods")) * 100, 1).alias("completeness_pct"))


@query("mape_bands", """
SELECT series_id, CASE WHEN mape < 10 THEN 'high (MAPE < 10%)' WHEN mape < 20 THEN 'acceptable (MAPE 10–20%)' WHEN mape < 50 THEN 'moderate (MAPE 20–50%)'
  ELSE 'low (MAPE > 50% — treat with caution)' END AS band,
  CASE WHEN final_rmse / rmse >= 1.25 THEN 'weaker' WHEN final_rmse / rmse <= 0.8 THEN 'stronger' ELSE 'consistent' END AS holdout FROM rule_ev""")
def mape_bands(spark, d):
    e = evidence(spark, d)
    return e.select("series_id", G.mape_band(F.col("mape")).alias("band"),
                    G.holdout_assessment(G.holdout_ratio(F.col("final_rmse"), F.col("rmse"))).alias("holdout"))


@query("health_indicators", """
SELECT series_id, unnest(['Data Quality', 'Trend Stability', 'Seasonality', 'Forecast Confidence', 'Structural Breaks', 'Residual Diagnostics']) AS indicator,
  unnest([quality, CASE WHEN has_trend AND NOT is_stationary_adf THEN 'Changing' ELSE 'Stable' END, CASE WHEN seasonal_period > 1 THEN 'Strong' ELSE 'None' END,
   CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Medium' ELSE 'Low' END, CASE WHEN has_breaks THEN 'Monitor' ELSE 'None detected' END,
   CASE WHEN NOT is_uncorrelated OR is_white_noise OR mape > 20 THEN 'Concerning' ELSE 'Acceptable' END]) AS status FROM rule_sc""")
def health_indicators(spark, d):
    return G.health_indicators(scored(spark, d))


@query("recommendations", """
WITH r AS (SELECT *, CASE WHEN score >= 75 THEN 1 WHEN score >= 50 THEN 2 ELSE 3 END AS lab FROM rule_sc)
SELECT * FROM (SELECT series_id, unnest([CASE WHEN final_rmse / rmse >= 1.25 THEN 'monitor_closely' ELSE 'monitor_after_holdout' END, CASE WHEN has_breaks THEN 'validate_breaks' END,
  CASE WHEN missing_periods > 0 THEN 'improve_collection' END, CASE WHEN seasonal_period > 1 THEN 'plan_seasonal_capacity' END, 're_estimate_rolling']) AS recommendation,
  unnest([CASE WHEN verdict = 'warn' OR lab = 1 THEN 'Medium' ELSE 'Low' END, 'High', 'Medium', 'Medium', 'Low']) AS priority FROM r) WHERE recommendation IS NOT NULL""")
def recommendations(spark, d):
    return G.recommendations(scored(spark, d)).select("series_id", "recommendation", "priority")


@query("risks", """
SELECT * FROM (SELECT series_id, unnest([CASE WHEN mape > 20 THEN 'high_error' END, CASE WHEN has_breaks THEN 'structural_break' END, CASE WHEN quality = 'Poor' THEN 'poor_quality' END,
  CASE WHEN verdict = 'warn' THEN 'review_concern' END, 'horizon_decay']) AS risk, unnest(['High', 'Medium', 'High', 'Medium', 'Low']) AS severity FROM rule_sc) WHERE risk IS NOT NULL""")
def risks(spark, d):
    return G.risks(scored(spark, d)).select("series_id", "risk", "severity")


@query("visual_strategy", """
SELECT * FROM (SELECT series_id, unnest([CASE WHEN seasonal_period > 1 THEN 'STL Decomposition' END, CASE WHEN mape > 15 THEN 'Model-Based 95% Prediction Intervals' END,
  CASE WHEN model = 'SARIMA' THEN 'ACF/PACF' END, CASE WHEN outlier_ratio > 0.05 THEN 'Box Plot' END, CASE WHEN has_trend AND abs(trend_slope) > 0.01 THEN 'Trend Analysis' END,
  CASE WHEN mape > 10 THEN 'Forecast Error Plot' END, 'Histogram']) AS chart FROM rule_ev) WHERE chart IS NOT NULL""")
def visual_strategy(spark, d):
    return G.visual_strategy(evidence(spark, d)).select("series_id", "chart")


@query("heuristic_preference", """
SELECT series_id, CASE WHEN seasonal_period > 1 THEN 'SARIMA,Holt-Winters,ARIMA,EWMA' WHEN has_trend AND abs(trend_slope) > 0.1 THEN 'Holt-Winters,ARIMA,SARIMA,EWMA'
  WHEN is_white_noise THEN 'EWMA,ARIMA,Holt-Winters,SARIMA' ELSE 'ARIMA,Holt-Winters,SARIMA,EWMA' END AS preference FROM rule_ev""")
def heuristic_preference(spark, d):
    return evidence(spark, d).select("series_id", F.array_join("preference", ",").alias("preference"))


@query("suitability_points", """
SELECT * FROM (SELECT series_id, 'EWMA' AS model, unnest([CASE WHEN has_trend THEN 'lags_trend' ELSE 'suits_stable_series' END, CASE WHEN outlier_ratio > 0.05 THEN 'sensitive_to_outliers' ELSE 'few_outliers' END,
  CASE WHEN is_white_noise THEN 'as_good_on_noise' END, 'short_term', 'fast']) AS point FROM rule_ev
UNION ALL SELECT series_id, 'SARIMA', unnest([CASE WHEN seasonal_period > 1 THEN 'models_seasonality' ELSE 'would_overfit' END, CASE WHEN seasonal_period > 1 THEN 'standard_for_seasonal' END,
  CASE WHEN NOT is_stationary_adf THEN 'seasonal_differencing' END, 'needs_two_cycles']) FROM rule_ev) WHERE point IS NOT NULL""")
def suitability_points(spark, d):
    return G.suitability(evidence(spark, d)).filter(F.col("model").isin("EWMA", "SARIMA")).select("series_id", "model", "point")


@query("assumptions", """
SELECT series_id, unnest(['past_drivers_persist', CASE WHEN model IN ('Holt-Winters', 'EWMA') THEN 'level_trend_season_stable' ELSE 'differenced_dependence_stable' END,
  CASE WHEN seasonal_period > 1 THEN 'cycle_of_12_continues' ELSE 'no_seasonality' END, 'frequency_stays_MS', 'no_external_variables']) AS assumption FROM rule_ev""")
def assumptions(spark, d):
    return G.assumptions(evidence(spark, d)).select("series_id", "assumption")


@query("model_comparison", """
SELECT p.series_id, p.model, round(p.rmse, 4) AS rmse, round(p.mae, 4) AS mae, round(p.mape, 2) AS mape, round(p.wape * 100, 2) AS wape, round(p.mase, 4) AS mase,
  p.model = k.model AS selected, CASE WHEN p.model <> k.model THEN 'Baseline model for comparison.' END AS rejected_reason FROM sup_pool p JOIN sup_pick k USING (series_id)""")
def model_comparison(spark, d):
    from seriesloom.operators.selection import select_models

    bt = supplier_backtest(spark, d)
    ev = stage(E.pooled_evidence(bt, bt.baselines()), "evidence")
    chosen = select_models(ev).select("series_id", F.col("selected_model").alias("model"))
    return G.model_comparison(ev, chosen)


@query("model_comparison_long", """
SELECT series_id, model, metric, round(value, 5) AS value FROM (UNPIVOT (SELECT series_id, model, rmse, mae, mape FROM sup_pool) ON rmse, mae, mape INTO NAME metric VALUE value)""")
def model_comparison_long(spark, d):
    bt = supplier_backtest(spark, d)
    pooled = M.forecast_metrics(bt.errors(bt.baselines()), ["series_id", "model"])
    return G.metric_bars(pooled.select("series_id", "model", "rmse", "mae", "mape")).select(
        "series_id", "model", "metric", *_r("value", digits=5))


@query("rejection_reasons", """
SELECT p.series_id, p.model, CASE WHEN p.mase > s.mase THEN 'higher_error: MASE ' || format('{:.4f}', p.mase) || ' versus MASE ' || format('{:.4f}', s.mase) ELSE 'competitive_but_weaker_choice' END AS reason
FROM sup_pool p JOIN sup_pick k USING (series_id) JOIN sup_pool s ON s.series_id = p.series_id AND s.model = k.model WHERE p.model <> k.model""")
def rejection_reasons(spark, d):
    from seriesloom.operators.selection import select_models

    bt = supplier_backtest(spark, d)
    ev = stage(E.pooled_evidence(bt, bt.baselines()), "evidence")
    chosen = select_models(ev).select("series_id", F.col("selected_model").alias("model"))
    return G.rejection_reasons(ev, chosen)


@query("metric_lines", """
SELECT series_id, model, 'MASE ' || format('{:.4f}', mase) || ', WAPE ' || format('{:.2f}', wape * 100) || '%, RMSE ' || format('{:.4f}', rmse) || ', MAE ' || format('{:.4f}', mae)
  || ', ' || CASE WHEN mape IS NULL THEN 'MAPE not available' ELSE 'MAPE ' || format('{:.2f}', mape) || '%' END AS line FROM sup_pool""")
def metric_lines(spark, d):
    bt = supplier_backtest(spark, d)
    return G.metric_lines(M.forecast_metrics(bt.errors(bt.baselines()), ["series_id", "model"]))


cte("sup_path", """
SELECT series_id, h, ts, yhat FROM (SELECT p.series_id, h, last_ts + to_months(CAST(h AS INTEGER)) AS ts, p.value AS yhat
 FROM (SELECT series_id, max(t) + 1 AS n, max(ts) AS last_ts FROM sup_prep GROUP BY 1) e, (SELECT unnest(range(1, 13)) AS h)
 JOIN sup_prep p ON p.series_id = e.series_id AND p.t = e.n - 12 + (h - 1) % 12)""")


def seasonal_path(spark, d, panels=None):
    _, panel = panels or supplier_panels(spark, d)
    return E.baseline_refit(panel, 12, 12, "MS").filter(F.col("model") == "Seasonal Naive")


@query("forecast_pattern", """
WITH s AS (SELECT *, yhat - lag(yhat) OVER (PARTITION BY series_id ORDER BY h) AS d FROM sup_path)
SELECT series_id, round(arg_min(yhat, h), 7) AS first_value, round(arg_max(yhat, h), 7) AS last_value, round((arg_max(yhat, h) - arg_min(yhat, h)) / abs(arg_min(yhat, h)) * 100, 1) AS pct_change,
  CASE WHEN bool_and(d >= -1e-9) THEN 'Upward' WHEN bool_and(d <= 1e-9) THEN 'Downward' ELSE 'Seasonal / variable' END AS pattern,
  round(max(yhat), 7) AS peak_value, arg_max(ts, yhat) AS peak_ts FROM s GROUP BY 1""")
def forecast_pattern(spark, d):
    return G.path_summary(seasonal_path(spark, d)).select(
        "series_id", *_r("first_value", "last_value", digits=7), F.round("pct_change", 1).alias("pct_change"), "pattern", *_r("peak_value", digits=7), "peak_ts")


@query("dashboard")
def dashboard(spark, d):
    panels = supplier_panels(spark, d)
    rows = scored(spark, d, panels).join(G.path_summary(seasonal_path(spark, d, panels)), "series_id")
    return G.dashboard(rows)


@query("narratives")
def narratives(spark, d):
    panels = supplier_panels(spark, d)
    rows = scored(spark, d, panels).join(G.path_summary(seasonal_path(spark, d, panels)).select("series_id", "pattern"), "series_id")
    return G.narratives(rows)


@query("chart_ribbon", """
SELECT series_id, ts, 'history' AS kind, round(value, 7) AS value FROM sup_prep UNION ALL SELECT series_id, ts, 'forecast', round(yhat, 7) FROM sup_path""")
def chart_ribbon(spark, d):
    history = P.supplier_prep(spark, d).select("series_id", "ts", F.lit("history").alias("kind"), "value")
    future = seasonal_path(spark, d).select("series_id", "ts", F.lit("forecast").alias("kind"), F.col("yhat").alias("value"))
    return history.unionByName(future).select("series_id", "ts", "kind", *_r("value", digits=7))


@query("chart_decomposition", """
SELECT series_id, t, component, round(value, 6) AS value FROM (UNPIVOT (SELECT series_id, t, value AS observed, trend, seasonal, resid AS residual FROM sup_dec) ON observed, trend, seasonal, residual INTO NAME component VALUE value)""")
def chart_decomposition(spark, d):
    parts = DE.classical_decompose(P.supplier_prep(spark, d), 12)
    wide = parts.select("series_id", "t", F.col("value").alias("observed"), "trend", "seasonal", F.col("resid").alias("residual"))
    return wide.unpivot(["series_id", "t"], ["observed", "trend", "seasonal", "residual"], "component", "value").select(
        "series_id", "t", "component", *_r("value", digits=6))


def _with_path(spark, d):
    return scored(spark, d).join(G.path_summary(seasonal_path(spark, d)), "series_id")


@query("executive_summary", """
WITH p AS (SELECT series_id, (arg_max(yhat, h) - arg_min(yhat, h)) / abs(arg_min(yhat, h)) * 100 AS chg FROM sup_path GROUP BY 1)
SELECT series_id, CASE WHEN quality = 'Poor' THEN 'poor_quality' WHEN mape > 20 THEN 'high_error' ELSE 'horizon_decay' END AS primary_risk,
  CASE WHEN final_rmse / rmse >= 1.25 THEN 'monitor_closely' WHEN verdict = 'warn' THEN 'review_audit' ELSE 'use_near_term' END AS recommended_action,
  score || '/100 — ' || CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM rule_sc JOIN p USING (series_id)""")
def executive_summary(spark, d):
    return G.executive_summary(_with_path(spark, d)).select("series_id", "primary_risk", "recommended_action", "confidence_level")


@query("statistical_audit", """
SELECT series_id, verdict, (SELECT count(f) FROM rule_fl l WHERE l.series_id = e.series_id) AS n_concerns FROM rule_vd e""")
def statistical_audit(spark, d):
    return G.statistical_audit(reviewed(spark, d)).select("series_id", "verdict", F.size("key_concerns").cast("long").alias("n_concerns"))


@query("explainability", """
SELECT * FROM (SELECT series_id, unnest([CASE WHEN seasonal_period > 1 THEN 'seasonal_pattern' END, CASE WHEN has_trend AND trend_slope > 0 THEN 'upward_trend' END,
  CASE WHEN has_trend AND trend_slope <= 0 THEN 'downward_trend' END, CASE WHEN mape < 10 THEN 'low_validation_error' END,
  CASE WHEN is_uncorrelated THEN 'residuals_acceptable' ELSE 'residuals_need_monitoring' END, 'confidence']) AS finding FROM rule_sc) WHERE finding IS NOT NULL""")
def explainability(spark, d):
    return G.explainability(scored(spark, d)).select("series_id", "finding")


@query("report_appendix", """
SELECT series_id, round(rmse, 4) AS rmse, round(mape, 2) AS mape, round(trend_slope, 6) AS trend_slope, round(outlier_ratio, 4) AS outlier_ratio FROM rule_ev""")
def report_appendix(spark, d):
    raw = G.appendix(evidence(spark, d))
    return raw.select("series_id", *[F.col("raw_metrics")[k].alias(k) for k in ("rmse", "mape", "trend_slope", "outlier_ratio")])


@query("report_metadata", """
SELECT series_id, 'Drift,Mean Forecast,Naive,Seasonal Naive' AS models_evaluated, model AS selected_model, 'MS' AS dataset_frequency, quality AS data_quality_rating, row_count FROM rule_vd""")
def report_metadata(spark, d):
    bt = supplier_backtest(spark, d)
    out = G.report_metadata(scored(spark, d), bt.baselines().select("series_id", "model"))
    return out.withColumn("models_evaluated", F.array_join("models_evaluated", ","))


@query("merged_metrics", """
SELECT series_id, model, round(rmse, 5) AS rmse FROM sup_pool WHERE model IN ('Naive', 'Drift')
UNION ALL SELECT series_id, model, round(sqrt(avg((y - yhat) ** 2)), 5) FROM sup_err WHERE kind = 'final' AND y IS NOT NULL AND model NOT IN ('Naive', 'Drift') GROUP BY 1, 2""")
def merged_metrics(spark, d):
    bt = supplier_backtest(spark, d)
    preds = stage(bt.baselines(), "predictions")
    found = M.forecast_metrics(bt.errors(preds.filter(F.col("model").isin("Naive", "Drift"))), ["series_id", "model"])
    existing = M.forecast_metrics(bt.errors(preds, "final"), ["series_id", "model"])
    return M.merge_metrics(found, existing).select("series_id", "model", *_r("rmse", digits=5))


@query("unsupported_horizons", """
SELECT series_id, coalesce(array_to_string(list_transform(range(hz + 1, 25), lambda x: CAST(x AS VARCHAR)), ','), '') AS steps FROM sup_size""")
def unsupported_horizons(spark, d):
    from seriesloom.operators.folds import unsupported_horizons as missing_steps

    plan = supplier_backtest(spark, d).folds.groupBy("series_id").agg(F.min("horizon").alias("hz"))
    steps = missing_steps(F.lit(24).cast("long"), F.col("hz"))
    return plan.select("series_id", F.array_join(steps.cast("array<string>"), ",").alias("steps"))


@query("statistical_profile")
def statistical_profile(spark, d):
    from seriesloom.operators.profile import profile

    return profile(P.supplier_prep(spark, d), "MS", 12)
