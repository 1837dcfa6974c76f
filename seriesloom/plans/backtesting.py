"""Fold, baseline, metric and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import candidates as C
from seriesloom.operators import folds as FO
from seriesloom.operators import metrics as M
from seriesloom.operators import origins as OR
from seriesloom.operators import selection as S
from seriesloom.operators.levels import level_fit
from seriesloom.operators.grid import reindex
from seriesloom.operators.outliers import treat_outliers
from seriesloom.plans import evaluation as E
from seriesloom.plans import panels as P
from seriesloom.plans.registry import cte, query

PERIOD, HORIZON = 12, 12


def _r(*names, digits=5):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def segment_backtest(spark, d):
    return E.backtest(P.gridded(P.segment_raw(spark, d), "MS"), PERIOD, HORIZON)


def supplier_backtest(spark, d):
    return E.backtest(P.gridded(P.supplier_raw(spark, d), "MS"), PERIOD, HORIZON)


for _p in ("seg", "sup", "usr"):
    cte(f"{_p}_size", f"""
SELECT series_id, n, least(12, greatest(1, n // 5)) AS hz, least(CASE WHEN n >= 36 THEN 12 ELSE 0 END, greatest(0, n - 2)) AS fin
FROM (SELECT series_id, count(*) AS n FROM {_p}_grid GROUP BY 1)""")
    cte(f"{_p}_orig", f"""
SELECT series_id, n, hz, fin, greatest(1, least(greatest(10, (n - fin) // 2), n - fin - hz)) AS first, n - fin - hz AS lastp FROM {_p}_size""")
    cte(f"{_p}_folds", f"""
SELECT series_id, n, fold, 'rolling' AS kind, first + fold * hz AS train_end, first + fold * hz AS test_start, first + fold * hz + hz AS test_end, hz AS horizon
FROM {_p}_orig, (SELECT unnest(range(0, 5)) AS fold) WHERE first + fold * hz <= lastp
UNION ALL
SELECT series_id, n, (SELECT count(*) FROM range(0, 5) r(f) WHERE first + f * hz <= lastp) AS fold, 'final', n - fin, n - fin, n, fin
FROM {_p}_orig WHERE fin > 0 AND n > fin""")
    cte(f"{_p}_twin", f"""
SELECT g.series_id, f.fold, f.kind, f.train_end, f.horizon, g.t, g.value AS raw,
  last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER up AS t0, last_value(value IGNORE NULLS) OVER up AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS t1, first_value(value IGNORE NULLS) OVER dn AS v1
FROM {_p}_grid g JOIN {_p}_folds f ON f.series_id = g.series_id AND g.t < f.train_end
WINDOW up AS (PARTITION BY g.series_id, f.fold, f.kind ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       dn AS (PARTITION BY g.series_id, f.fold, f.kind ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
    cte(f"{_p}_train", f"""
SELECT series_id, fold, kind, train_end, horizon, t, coalesce(raw, v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)), v0, v1) AS value FROM {_p}_twin""")
    cte(f"{_p}_feat", f"""
SELECT series_id, fold, kind, any_value(train_end) AS train_end, any_value(horizon) AS horizon, count(*) AS n_train,
  arg_max(value, t) AS last, arg_min(value, t) AS first, avg(value) AS mean FROM {_p}_train GROUP BY 1, 2, 3""")
    cte(f"{_p}_pred", f"""
WITH st AS (SELECT f.*, h FROM {_p}_feat f, (SELECT unnest(range(1, 13)) AS h) WHERE h <= f.horizon)
SELECT series_id, fold, kind, 9 AS ord, 'Naive' AS model, h, last AS yhat FROM st
UNION ALL
SELECT st.series_id, st.fold, st.kind, 10, 'Seasonal Naive', h, t.value FROM st
 JOIN {_p}_train t ON t.series_id = st.series_id AND t.fold = st.fold AND t.kind = st.kind AND t.t = st.train_end - 12 + (h - 1) % 12
UNION ALL SELECT series_id, fold, kind, 11, 'Mean Forecast', h, mean FROM st
UNION ALL SELECT series_id, fold, kind, 12, 'Drift', h, last + h * (last - first) / (n_train - 1) FROM st WHERE n_train >= 2""")
    cte(f"{_p}_scale", f"""
SELECT series_id, avg(abs(d)) AS scale, avg(d * d) AS scale_sq FROM (
  SELECT series_id, value - lag(value, 12) OVER (PARTITION BY series_id ORDER BY t) AS d FROM {_p}_train WHERE fold = 0 AND kind = 'rolling') GROUP BY 1""")
    cte(f"{_p}_err", f"""
SELECT p.*, g.value AS y, s.scale, s.scale_sq FROM {_p}_pred p
JOIN {_p}_folds f ON f.series_id = p.series_id AND f.fold = p.fold AND f.kind = p.kind
LEFT JOIN {_p}_grid g ON g.series_id = p.series_id AND g.t = f.test_start + p.h - 1
LEFT JOIN {_p}_scale s ON s.series_id = p.series_id""")
    cte(f"{_p}_pool", f"""
SELECT series_id, model, ord, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae,
  CASE WHEN count(*) FILTER (y = 0) = 0 THEN avg(abs((y - yhat) / y)) * 100 END AS mape,
  sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS wape, avg(abs(y - yhat)) / nullif(any_value(scale), 0) AS mase
FROM {_p}_err WHERE kind = 'rolling' AND y IS NOT NULL GROUP BY 1, 2, 3""")
    cte(f"{_p}_rank", f"""
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, mase, wape, mae, mape, ord) AS rk FROM {_p}_pool""")

_SIMPLE = "CASE model WHEN 'Naive' THEN 0 WHEN 'Seasonal Naive' THEN 1 WHEN 'Mean Forecast' THEN 2 WHEN 'Drift' THEN 3 END"
for _p in ("seg", "sup"):
    # only baselines compete here, so the retention step never fires
    cte(f"{_p}_pick", f"""
SELECT a.series_id, CASE WHEN b.rmse / a.rmse < 1.05 AND b.s < a.s THEN b.model ELSE a.model END AS model,
  CASE WHEN b.rmse / a.rmse < 1.05 AND b.s < a.s THEN b.rmse ELSE a.rmse END AS rmse, coalesce(b.rmse / a.rmse < 1.05 AND b.s < a.s, false) AS tied
FROM (SELECT *, {_SIMPLE} AS s FROM {_p}_rank WHERE rk = 1) a LEFT JOIN (SELECT *, {_SIMPLE} AS s FROM {_p}_rank WHERE rk = 2) b USING (series_id)""")


@query("folds", "SELECT series_id, n, fold, kind, train_end, test_start, test_end, horizon FROM sup_folds")
def folds(spark, d):
    return supplier_backtest(spark, d).folds


@query("terminal_holdout", """
WITH s AS (SELECT series_id, n, greatest(1, least(n - 1, greatest(CAST(floor(0.8 * n) AS BIGINT), n - 12))) AS split FROM sup_size)
SELECT s.series_id, n, split AS split_at, t, t >= split AS is_test FROM sup_grid JOIN s USING (series_id)""")
def terminal_holdout(spark, d):
    out = FO.terminal_holdout(reindex(P.supplier_raw(spark, d), "MS"), HORIZON)
    return out.select("series_id", "n", "split_at", "t", "is_test")


@query("training_windows", "SELECT series_id, fold, kind, t, round(value, 7) AS value FROM sup_train")
def training_windows(spark, d):
    return supplier_backtest(spark, d).train.select("series_id", "fold", "kind", "t", *_r("value", digits=7))


for _name, _model in (("backtest_naive", "Naive"), ("backtest_snaive", "Seasonal Naive"),
                      ("backtest_mean", "Mean Forecast"), ("backtest_drift", "Drift")):
    @query(_name, f"SELECT series_id, fold, kind, h, round(yhat, 7) AS yhat FROM sup_pred WHERE model = '{_model}'")
    def _baseline(spark, d, model=_model):
        preds = supplier_backtest(spark, d).baselines().filter(F.col("model") == model)
        return preds.select("series_id", "fold", "kind", "h", *_r("yhat", digits=7))


@query("mase_scale", "SELECT series_id, round(scale, 5) AS scale, round(scale_sq, 4) AS scale_sq FROM sup_scale")
def mase_scale(spark, d):
    bt = supplier_backtest(spark, d)
    train = bt.train.filter((F.col("fold") == 0) & (F.col("kind") == "rolling"))
    return M.naive_scale(train, PERIOD).select("series_id", *_r("scale"), *_r("scale_sq", digits=4))


_METRICS = """
 round(sqrt(avg((y - yhat) ** 2)), 5) AS rmse, round(avg(abs(y - yhat)), 5) AS mae,
 round(CASE WHEN count(*) FILTER (y = 0) = 0 THEN avg(abs((y - yhat) / y)) * 100 END, 5) AS mape,
 round(sum(abs(y - yhat)) / nullif(sum(abs(y)), 0), 6) AS wape,
 round(avg(abs(y - yhat)) / nullif(any_value(scale), 0), 6) AS mase,
 round(avg(abs(y - yhat) / nullif(abs(y) + abs(yhat), 0)) * 200, 5) AS smape,
 round(sqrt(avg((y - yhat) ** 2) / nullif(any_value(scale_sq), 0)), 6) AS rmsse, count(*) AS n_evaluated
FROM sup_err WHERE kind = 'rolling' AND y IS NOT NULL"""


def _metric_select(df, *keys):
    return df.select(*keys, *_r("rmse", "mae", "mape", "smape"), *_r("wape", "mase", "rmsse", digits=6), "n_evaluated")


@query("metrics_pooled", "SELECT series_id, model," + _METRICS + " GROUP BY 1, 2")
def metrics_pooled(spark, d):
    bt = supplier_backtest(spark, d)
    return _metric_select(M.forecast_metrics(bt.errors(bt.baselines()), ["series_id", "model"]), "series_id", "model")


@query("metrics_by_horizon", "SELECT series_id, model, h," + _METRICS + " GROUP BY GROUPING SETS ((series_id, model), (series_id, model, h))")
def metrics_by_horizon(spark, d):
    bt = supplier_backtest(spark, d)
    return _metric_select(M.pooled_and_by_horizon(bt.errors(bt.baselines())), "series_id", "model", "h")


@query("metrics_final_test", """
SELECT series_id, model, round(sqrt(avg((y - yhat) ** 2)), 5) AS rmse, round(avg(abs(y - yhat)), 5) AS mae, count(*) AS n_evaluated
FROM sup_err WHERE kind = 'final' AND y IS NOT NULL GROUP BY 1, 2""")
def metrics_final_test(spark, d):
    bt = supplier_backtest(spark, d)
    out = M.forecast_metrics(bt.errors(bt.baselines(), "final"), ["series_id", "model"])
    return out.select("series_id", "model", *_r("rmse", "mae"), "n_evaluated")


@query("skill_scores", """
WITH ref AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, CASE model WHEN 'Seasonal Naive' THEN 0 ELSE 1 END) rk
  FROM sup_pool WHERE model IN ('Seasonal Naive', 'Naive'))
SELECT p.series_id, p.model, r.model AS reference, round(1 - p.mae / r.mae, 6) AS mae_skill, round(1 - p.rmse / r.rmse, 6) AS rmse_skill
FROM sup_pool p JOIN ref r ON r.series_id = p.series_id AND r.rk = 1""")
def skill_scores(spark, d):
    bt = supplier_backtest(spark, d)
    pooled = M.forecast_metrics(bt.errors(bt.baselines()), ["series_id", "model"])
    return M.skill_scores(pooled).select("series_id", "model", "reference", *_r("mae_skill", "rmse_skill", digits=6))


@query("error_variance_by_h", """
SELECT series_id, model, h - 1 AS step, round(coalesce(var_samp(y - yhat), 0), 4) AS variance
FROM sup_err WHERE kind = 'rolling' AND y IS NOT NULL GROUP BY 1, 2, 3""")
def error_variance_by_h(spark, d):
    bt = supplier_backtest(spark, d)
    out = M.error_variance_by_horizon(bt.errors(bt.baselines()))
    return out.select("series_id", "model", "step", *_r("variance", digits=4))


cte("usr_status", """
WITH c AS (SELECT series_id, coalesce(stddev_pop(value) <= 1e-8, false) AS constant FROM usr_grid GROUP BY 1),
m AS (SELECT unnest(['Constant', 'Naive', 'Seasonal Naive', 'Mean Forecast', 'Drift']) AS model)
SELECT f.series_id, f.fold, f.kind, model, f.horizon, CASE WHEN train_end < 2 THEN 'skipped' WHEN model = 'Seasonal Naive' AND train_end < 21 THEN 'not_estimable' ELSE 'ok' END AS status
FROM usr_folds f JOIN c USING (series_id), m WHERE (model = 'Constant') = constant""")


def user_backtest(spark, d):
    """Daily values per user with a season of three weeks: many origins have less training than that."""
    return E.backtest(P.gridded(P.user_day_raw(spark, d), "D"), 21, HORIZON)


@query("origin_counts", """
SELECT series_id, model, count(*) FILTER (status = 'ok') AS n_origins, count(*) FILTER (status NOT IN ('ok', 'skipped')) AS n_failed_origins
FROM usr_status WHERE kind = 'rolling' GROUP BY 1, 2""")
def origin_counts(spark, d):
    bt = user_backtest(spark, d)
    status = bt.origins(bt.baselines(), bt.candidates())
    return OR.origin_counts(status.filter(F.col("kind") == "rolling"))


@query("origin_statuses", """
SELECT series_id, fold, kind, model, status, CASE status WHEN 'skipped' THEN 'training' WHEN 'not_estimable' THEN 'no_prediction' END AS reason FROM usr_status""")
def origin_statuses(spark, d):
    bt = user_backtest(spark, d)
    return bt.origins(bt.baselines(), bt.candidates())


@query("aligned_steps", """
SELECT model, kind, count(*) AS n_due, count(*) FILTER (status = 'ok' OR (status = 'skipped' AND model NOT IN ('Drift', 'Seasonal Naive'))) AS n_predicted, count(y) AS n_observed
FROM (SELECT s.*, g.value AS y FROM (SELECT *, unnest(range(1, horizon + 1)) AS h FROM usr_status) s JOIN usr_folds f USING (series_id, fold, kind)
  LEFT JOIN usr_grid g ON g.series_id = s.series_id AND g.t = f.test_start + s.h - 1) GROUP BY 1, 2""")
def aligned_steps(spark, d):
    bt = user_backtest(spark, d)
    rows = OR.aligned(OR.due(bt.folds, bt.candidates()), bt.baselines(), bt.actuals)
    return rows.filter("due").groupBy("model", "kind").agg(
        F.count(F.lit(1)).alias("n_due"), F.count_if("predicted").alias("n_predicted"), F.count("y").alias("n_observed"))


@query("model_ranking", "SELECT series_id, rk AS rank, model, round(rmse, 5) AS rmse FROM sup_rank")
def model_ranking(spark, d):
    bt = supplier_backtest(spark, d)
    chosen = S.select_models(E.pooled_evidence(bt, bt.baselines()))
    return S.ranking_table(chosen).select("series_id", "rank", "model", *_r("rmse"))


@query("model_selected", "SELECT series_id, model AS selected_model, round(rmse, 5) AS selected_rmse, tied AS tie_broken FROM sup_pick")
def model_selected(spark, d):
    bt = supplier_backtest(spark, d)
    chosen = S.select_models(E.pooled_evidence(bt, bt.baselines()))
    return chosen.select("series_id", "selected_model", *_r("selected_rmse"), "tie_broken")


_LOSS_PICK = """
WITH l AS (SELECT p.*, loss, CASE loss WHEN 'mase' THEN mase WHEN 'wape' THEN wape WHEN 'rmse' THEN rmse ELSE mae END AS v
  FROM sup_pool p, (SELECT unnest(['mase', 'wape', 'rmse', 'mae']) AS loss)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, loss ORDER BY v, mase, wape, rmse, mae, mape, ord) AS rk, """ + _SIMPLE + """ AS s FROM l),
w AS (SELECT a.series_id, a.loss, CASE WHEN b.v / a.v < 1.05 AND b.s < a.s THEN b.model ELSE a.model END AS model
  FROM (SELECT * FROM r WHERE rk = 1) a LEFT JOIN (SELECT * FROM r WHERE rk = 2) b ON a.series_id = b.series_id AND a.loss = b.loss)"""


@query("loss_sensitivity", _LOSS_PICK + """
SELECT series_id, max(model) FILTER (loss = 'mase') AS by_mase, max(model) FILTER (loss = 'wape') AS by_wape,
  max(model) FILTER (loss = 'rmse') AS by_rmse, max(model) FILTER (loss = 'mae') AS by_mae, count(DISTINCT model) > 1 AS selection_sensitive
FROM w GROUP BY 1""")
def loss_sensitivity(spark, d):
    bt = supplier_backtest(spark, d)
    out = S.loss_sensitivity(E.pooled_evidence(bt, bt.baselines()))
    return out.select("series_id", *[F.col("winners")[m].alias(f"by_{m}") for m in ("mase", "wape", "rmse", "mae")],
                      "selection_sensitive")


@query("best_metric_model", """
SELECT series_id, model AS best_model FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mase, wape, rmse, mae, mape, ord) AS k FROM sup_pool) WHERE k = 1""")
def best_metric_model(spark, d):
    bt = supplier_backtest(spark, d)
    return S.best_metric_model(E.pooled_evidence(bt, bt.baselines()))


@query("fallback_choice", """
SELECT series_id, model AS fallback_model, round(rmse, 5) AS fallback_rmse FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, ord) AS k FROM sup_pool) WHERE k = 1""")
def fallback_choice(spark, d):
    bt = supplier_backtest(spark, d)
    return S.fallback_choice(E.pooled_evidence(bt, bt.baselines())).select("series_id", "fallback_model", *_r("fallback_rmse"))


@query("reselect_flagged", """
WITH x AS (SELECT r.* FROM sup_rank r JOIN sup_pick p USING (series_id) WHERE r.model <> p.model AND p.tied),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, mase, wape, mae, mape, ord) AS k, """ + _SIMPLE + """ AS s FROM x)
SELECT a.series_id, CASE WHEN b.rmse / a.rmse < 1.05 AND b.s < a.s THEN b.model ELSE a.model END AS selected_model
FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b USING (series_id)""")
def reselect_flagged(spark, d):
    bt = supplier_backtest(spark, d)
    evidence = E.pooled_evidence(bt, bt.baselines())
    first = S.select_models(evidence)
    again = S.reselect(evidence, first, first.filter("tie_broken"))
    return again.select("series_id", "selected_model")


@query("baseline_forecast", """
WITH full_ AS (SELECT * FROM seg_prep), e AS (SELECT series_id, max(t) + 1 AS n, max(ts) AS last_ts, arg_max(value, t) AS last, arg_min(value, t) AS first, avg(value) AS mean FROM full_ GROUP BY 1),
s AS (SELECT e.*, h, p.model, p.rmse FROM e JOIN seg_pick p USING (series_id), (SELECT unnest(range(1, 13)) AS h))
SELECT s.series_id, s.model, s.h, s.last_ts + to_months(CAST(s.h AS INTEGER)) AS ts, round(CASE s.model WHEN 'Naive' THEN last WHEN 'Mean Forecast' THEN mean
  WHEN 'Drift' THEN last + h * (last - first) / (n - 1) ELSE f.value END, 4) AS yhat, round(s.rmse, 4) AS selected_rmse
FROM s LEFT JOIN full_ f ON f.series_id = s.series_id AND f.t = s.n - 12 + (s.h - 1) % 12""")
def baseline_forecast(spark, d):
    panel = P.gridded(P.segment_raw(spark, d), "MS")
    out = E.best_baseline_forecast(panel, PERIOD, HORIZON, "MS")
    return out.select("series_id", "model", "h", "ts", *_r("yhat", "selected_rmse", digits=4))


@query("holdout_baselines", """
WITH s AS (SELECT series_id, n, greatest(1, least(n - 1, greatest(CAST(floor(0.8 * n) AS BIGINT), n - 12))) AS split FROM sup_size),
tr AS (SELECT p.*, split, n FROM sup_prep p JOIN s USING (series_id) WHERE t < split),
f AS (SELECT series_id, any_value(split) split, any_value(n) n, arg_max(value, t) AS last, avg(value) AS mean FROM tr GROUP BY 1),
pr AS (SELECT f.series_id, 'Naive' AS model, p.value AS y, last AS yhat FROM f JOIN sup_prep p ON p.series_id = f.series_id AND p.t >= split
  UNION ALL SELECT f.series_id, 'Mean Forecast', p.value, mean FROM f JOIN sup_prep p ON p.series_id = f.series_id AND p.t >= split)
SELECT series_id, model, round(sqrt(avg((y - yhat) ** 2)), 5) AS rmse, round(avg(abs(y - yhat)), 5) AS mae FROM pr GROUP BY 1, 2""")
def holdout_baselines(spark, d):
    rows = FO.terminal_holdout(P.supplier_prep(spark, d), HORIZON).withColumn("fold", F.lit(0))
    train = rows.filter(~F.col("is_test")).select(
        "series_id", "fold", "t", "value", F.col("split_at").alias("train_end"), (F.col("n") - F.col("split_at")).alias("horizon"))
    feats = C.baseline_features(train, PERIOD, ("series_id", "fold"), ("horizon",))
    preds = C.baseline_forecasts(feats, PERIOD, ("series_id", "fold"), holdout_rule=True)
    actual = rows.filter("is_test").select(
        "series_id", "fold", (F.col("t") - F.col("split_at") + 1).cast("int").alias("h"), F.col("value").alias("y"))
    pairs = M.pair_errors(actual, preds, ["series_id", "fold", "h"]).join(M.naive_scale(train, PERIOD), "series_id")
    out = M.forecast_metrics(pairs, ["series_id", "model"]).filter(F.col("model").isin("Naive", "Mean Forecast"))
    return out.select("series_id", "model", *_r("rmse", "mae"))


@query("fold_safe_clip", """
WITH q AS (SELECT series_id, fold, quantile_cont(raw, 0.25) q1, quantile_cont(raw, 0.75) q3 FROM sup_twin WHERE kind = 'rolling' GROUP BY 1, 2)
SELECT series_id, fold, t, round(CASE WHEN raw IS NULL THEN NULL ELSE least(greatest(raw, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 7) AS value
FROM sup_twin JOIN q USING (series_id, fold) WHERE kind = 'rolling'""")
def fold_safe_clip(spark, d):
    bt = supplier_backtest(spark, d)
    train = FO.training_windows(bt.panel, bt.folds).filter(F.col("kind") == "rolling")
    return treat_outliers(train, "clip", ("series_id", "fold")).select("series_id", "fold", "t", *_r("value", digits=7))


_SES_SQL = """
WITH RECURSIVE w AS (SELECT * FROM {p}_train WHERE kind = 'rolling'),
a AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS alpha),
r AS (SELECT series_id, fold, t, alpha, value AS level, 0.0::DOUBLE AS sse FROM w, a WHERE t = 0
  UNION ALL SELECT w.series_id, w.fold, w.t, r.alpha, r.alpha * w.value + (1 - r.alpha) * r.level, r.sse + (w.value - r.level) ** 2
  FROM r JOIN w ON w.series_id = r.series_id AND w.fold = r.fold AND w.t = r.t + 1),
e AS (SELECT r.*, row_number() OVER (PARTITION BY r.series_id, r.fold ORDER BY sse, alpha) AS k
  FROM r JOIN {p}_folds f ON f.series_id = r.series_id AND f.fold = r.fold AND f.kind = 'rolling' AND r.t = f.train_end - 1)
"""


@query("ses_alpha_grid", _SES_SQL.format(p="seg") + """
SELECT series_id, fold, alpha, round(sse / 1e6, 2) AS sse_millions, round(level, 3) AS level FROM e WHERE k = 1""")
def ses_alpha_grid(spark, d):
    bt = segment_backtest(spark, d)
    fit = level_fit(bt.train.filter(F.col("kind") == "rolling"), ("series_id", "fold"))
    return fit.select("series_id", "fold", "alpha", F.round(F.col("sse") / 1e6, 2).alias("sse_millions"), *_r("level", digits=3))


@query("ses_backtest", """
WITH RECURSIVE a AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS alpha),
r AS (SELECT series_id, fold, kind, t, alpha, value AS level, 0.0::DOUBLE AS sse, NULL::DOUBLE AS miss FROM sup_train, a WHERE t = 0
  UNION ALL SELECT w.series_id, w.fold, w.kind, w.t, r.alpha, r.alpha * w.value + (1 - r.alpha) * r.level, r.sse + (w.value - r.level) ** 2, w.value - r.level
  FROM r JOIN sup_train w ON w.series_id = r.series_id AND w.fold = r.fold AND w.kind = r.kind AND w.t = r.t + 1),
l AS (SELECT series_id, fold, kind, max(t) AS t FROM sup_train GROUP BY 1, 2, 3),
e AS (SELECT r.*, row_number() OVER (PARTITION BY series_id, fold, kind ORDER BY sse, alpha) AS k FROM r JOIN l USING (series_id, fold, kind, t)),
q AS (SELECT r.series_id, r.fold, r.kind, quantile_cont(r.miss, 0.025) AS lo, quantile_cont(r.miss, 0.975) AS hi
  FROM r JOIN e ON e.k = 1 AND e.series_id = r.series_id AND e.fold = r.fold AND e.kind = r.kind AND e.alpha = r.alpha WHERE r.miss IS NOT NULL GROUP BY 1, 2, 3)
SELECT e.series_id, e.fold, e.kind, h, 3 AS ord, 'EWMA' AS model, round(e.level, 6) AS yhat, round(e.level + lo, 6) AS lo, round(e.level + hi, 6) AS hi, 'ok' AS status
FROM e JOIN q USING (series_id, fold, kind) JOIN sup_folds f USING (series_id, fold, kind), (SELECT unnest(range(1, 13)) AS h) WHERE e.k = 1 AND h <= f.horizon""")
def ses_backtest(spark, d):
    out = supplier_backtest(spark, d).smoothing()
    return out.select("series_id", "fold", "kind", "h", "ord", "model", *_r("yhat", "lo", "hi", digits=6), "status")


@query("interval_scores")
def interval_scores(spark, d):
    bt = segment_backtest(spark, d)
    return M.interval_scores(bt.errors(bt.smoothing()))


@query("bootstrap_metric_ci")
def bootstrap_metric_ci(spark, d):
    bt = segment_backtest(spark, d)
    return M.bootstrap_intervals(bt.errors(bt.baselines()))
