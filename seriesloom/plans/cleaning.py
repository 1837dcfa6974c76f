"""Quality, duplicate, grid, imputation, outlier and smoothing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.calendar import SCAN_BLOCK
from seriesloom.operators import decompose, duplicates, frequency, grid, impute, outliers, quality, rolling, smooth
from seriesloom.operators.quantiles import series_quantiles
from seriesloom.plans import panels as P
from seriesloom.plans.registry import query


def _r(*names, digits=7):
    return [F.round(F.col(n), digits).alias(n) for n in names]


@query("audit_panel", """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, avg(value) mu, stddev_samp(value) sd
           FROM ev_hours GROUP BY 1)
SELECT e.series_id, count(*) AS length, count(*) - count(value) AS missing,
  count(*) - count(DISTINCT ts) AS duplicate_stamps,
  count(DISTINCT ts) <> date_diff('hour', min(ts), max(ts)) + 1 AS irregular,
  CASE WHEN count(DISTINCT ts) = date_diff('hour', min(ts), max(ts)) + 1 THEN 'h' END AS freq,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (abs((value - mu) / sd) > 3) AS zscore_outliers
FROM ev_hours e JOIN q USING (series_id) GROUP BY e.series_id""")
def audit_panel(spark, d):
    return quality.audit(P.event_hours(spark, d), unbounded=True)


@query("freq_inference", """
WITH allp AS (SELECT 'seg' p, * FROM seg_raw UNION ALL SELECT 'sup', * FROM sup_raw UNION ALL SELECT 'hr', * FROM hr_raw
              UNION ALL SELECT 'day', * FROM day_raw UNION ALL SELECT 'sta', * FROM sta_raw),
st AS (SELECT p || ':' || series_id AS series_id, ts FROM allp),
g AS (SELECT series_id, ts, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS d,
  date_diff('month', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS m FROM st),
a AS (SELECT series_id, count(*) n, quantile_cont(floor(epoch(d) / 86400), 0.5) AS median_days,
  min(d) AS mind, max(d) AS maxd, max(m) AS maxm, bool_and(ts = date_trunc('month', ts)) AS ms FROM g GROUP BY 1),
i AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN mind = maxd AND mind = INTERVAL 1 DAY THEN 'D'
  WHEN mind = maxd AND mind = INTERVAL 1 HOUR THEN 'h' WHEN ms AND maxm = 1 THEN 'MS' END AS inferred FROM a)
SELECT series_id, inferred, median_days,
  coalesce(CASE WHEN inferred = 'h' THEN 'H' ELSE inferred END,
    CASE WHEN median_days IS NULL THEN 'MS' WHEN median_days <= 1 THEN 'D' WHEN median_days <= 7 THEN 'W'
    WHEN median_days <= 31 THEN 'MS' WHEN median_days <= 92 THEN 'QS' ELSE 'YS' END) AS frequency
FROM i""")
def freq_inference(spark, d):
    parts = {"seg": P.segment_raw, "sup": P.supplier_raw, "hr": P.hour_raw, "day": P.day_raw, "sta": P.status_raw}
    union = None
    for name, make in parts.items():
        part = make(spark, d).withColumn("series_id", F.concat(F.lit(name + ":"), F.col("series_id")))
        union = part if union is None else union.unionByName(part)
    return frequency.infer_frequency(union)


@query("missing_periods", """
SELECT series_id, count(*) FILTER (value IS NULL) AS missing_periods, CAST(0 AS BIGINT) AS unexpected_periods,
  count(*) FILTER (value IS NULL) = 0 AS is_regular FROM hr_grid GROUP BY 1""")
def missing_periods(spark, d):
    return grid.missing_periods(P.hour_raw(spark, d), "h")


@query("missing_stamps", "SELECT series_id, ts FROM sup_grid WHERE value IS NULL")
def missing_stamps(spark, d):
    return grid.period_differences(P.supplier_raw(spark, d), "MS")[0]


@query("unexpected_stamps", """
WITH b AS (SELECT series_id, min(date_trunc('hour', ts)) a, max(date_trunc('hour', ts)) z FROM ev_rows GROUP BY 1)
SELECT DISTINCT series_id, ts FROM ev_rows WHERE ts <> date_trunc('hour', ts)""")
def unexpected_stamps(spark, d):
    return grid.period_differences(P.event_rows(spark, d), "h")[1]


@query("schema_validation", """
WITH s AS (SELECT *, ts < lag(ts) OVER (PARTITION BY series_id ORDER BY seq) AS back FROM ev_hours)
SELECT series_id,
  count(DISTINCT ts) >= 3 AND count(DISTINCT ts) = date_diff('hour', min(ts), max(ts)) + 1 AS freq_regular,
  (count(*) - count(value)) / count(*) <= 0.05 AS missing_below_threshold,
  round((count(*) - count(value)) / count(*), 4) AS missing_rate,
  count(*) FILTER (NOT value BETWEEN 1 AND 200) = 0 AS values_in_range,
  count(*) FILTER (NOT value BETWEEN 1 AND 200) AS out_of_range_count,
  count(*) = count(DISTINCT ts) AS no_duplicates, NOT bool_or(coalesce(back, false)) AS index_monotonic
FROM s GROUP BY 1""")
def schema_validation(spark, d):
    return quality.validate_schema(P.event_hours(spark, d), "h", minimum=1.0, maximum=200.0)


@query("validation_summary", """
WITH c AS (SELECT series_id, count(*) row_count, count(*) - count(value) missing_values,
    count(*) - count(DISTINCT ts) duplicate_stamps,
    date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS missing_periods
  FROM ev_hours GROUP BY 1)
SELECT series_id, row_count, missing_values, duplicate_stamps, missing_periods, missing_periods = 0 AS is_regular,
  array_to_string(list_filter([CASE WHEN duplicate_stamps > 0 THEN duplicate_stamps || ' duplicate timestamp(s)' END,
   CASE WHEN missing_values > 0 THEN missing_values || ' missing value(s)' END,
   CASE WHEN missing_periods > 0 THEN missing_periods || ' missing period(s)' END,
   CASE WHEN missing_periods > 0 THEN 'irregular intervals' END], lambda x: x IS NOT NULL), '; ') AS issues,
  duplicate_stamps = 0 AND missing_values = 0 AS is_valid,
  round(row_count / (row_count + missing_periods) * 100, 1) AS completeness_pct
FROM c""")
def validation_summary(spark, d):
    out = quality.validation_summary(P.event_hours(spark, d), "h")
    return out.withColumn("issues", F.array_join("issues", "; "))


@query("preflight_status", """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM sup_raw GROUP BY 1),
o AS (SELECT series_id, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count
      FROM sup_raw JOIN q USING (series_id) GROUP BY 1),
c AS (SELECT series_id, count(*) AS row_count, count(value) AS usable_observations,
   date_diff('month', min(ts), max(ts)) + 1 - count(*) AS missing_periods FROM sup_raw GROUP BY 1)
SELECT series_id, row_count, usable_observations, missing_periods, missing_periods = 0 AS is_regular, outlier_count,
  CASE WHEN missing_periods > 0 THEN 'gaps' ELSE '' END AS issues,
  array_to_string(list_filter([CASE WHEN outlier_count > 0 THEN 'outliers' END,
    CASE WHEN usable_observations < 20 THEN 'short_series' END,
    CASE WHEN 12 > greatest(usable_observations, 1) THEN 'horizon_exceeds_history' END], lambda x: x IS NOT NULL), '; ') AS warnings,
  6 + (missing_periods > 0)::INT + (outlier_count > 0)::INT + (usable_observations < 20)::INT AS n_decisions,
  'needs_input' AS status
FROM c JOIN o USING (series_id)""")
def preflight_status(spark, d):
    out = quality.preflight(P.supplier_raw(spark, d), 12, "MS")
    return out.select(
        "series_id", "row_count", "usable_observations", "missing_periods", "is_regular", "outlier_count",
        F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"),
        F.size("decisions").alias("n_decisions"), "status")


for _name, _strategy, _sql in (
    ("dedupe_first", "keep-first", "arg_min(value, seq)"),
    ("dedupe_latest", "latest", "arg_max(value, seq)"),
    ("dedupe_mean", "mean", "avg(value)"),
    ("dedupe_sum", "sum", "coalesce(sum(value), 0)"),
):
    @query(_name, f"SELECT series_id, ts, round({_sql}, 7) AS value FROM ev_hours GROUP BY 1, 2")
    def _dedupe(spark, d, strategy=_strategy):
        out = duplicates.resolve_duplicates(P.event_hours(spark, d), strategy)
        return out.select("series_id", "ts", *_r("value"))


@query("duplicate_flags", """
SELECT series_id, ts, seq, seq <> min(seq) OVER (PARTITION BY series_id, ts) AS is_duplicate FROM ev_hours""")
def duplicate_flags(spark, d):
    return duplicates.flag_duplicates(P.event_hours(spark, d)).select("series_id", "ts", "seq", "is_duplicate")


@query("grid_fill", "SELECT series_id, t, ts, value FROM hr_grid")
def grid_fill(spark, d):
    return grid.reindex(P.hour_raw(spark, d), "h")


@query("ffill", "SELECT series_id, t, ts, v0 AS value FROM hr_near")
def ffill(spark, d):
    return impute.forward_fill(grid.reindex(P.hour_raw(spark, d), "h"), block=128)


@query("ffill_limit", "SELECT series_id, t, ts, CASE WHEN t - t0 <= 1 THEN v0 END AS value FROM usr_near")
def ffill_limit(spark, d):
    return impute.forward_fill(grid.reindex(P.user_day_raw(spark, d), "D"), limit=1)


@query("bfill", "SELECT series_id, t, ts, v1 AS value FROM hr_near")
def bfill(spark, d):
    return impute.backward_fill(grid.reindex(P.hour_raw(spark, d), "h"), block=128)


@query("interp_time", """
SELECT series_id, t, ts, round(coalesce(value, v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(ts0)) / (epoch_us(ts1) - epoch_us(ts0)), v0), 7) AS value
FROM sup_near""")
def interp_time(spark, d):
    out = impute.interpolate_time(grid.reindex(P.supplier_raw(spark, d), "MS"))
    return out.select("series_id", "t", "ts", *_r("value"))


@query("interp_position", "SELECT series_id, t, ts, round(value, 7) AS value FROM hr_prep")
def interp_position(spark, d):
    out = impute.interpolate_position(grid.reindex(P.hour_raw(spark, d), "h"), block=128)
    return out.select("series_id", "t", "ts", *_r("value"))


_IQR = """
WITH q AS (SELECT series_id, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM ev_rows GROUP BY 1),
b AS (SELECT series_id, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""
_Z = """
WITH q AS (SELECT series_id, avg(value) mu, stddev_samp(value) sd FROM ev_rows GROUP BY 1),
b AS (SELECT series_id, mu, sd, mu - 3 * sd AS lo, mu + 3 * sd AS hi FROM q)"""


@query("iqr_outliers", _IQR + """
SELECT series_id, count(*) FILTER (value < lo OR value > hi) AS outlier_count, count(*) AS n_rows,
  round(any_value(lo), 7) AS lower_bound, round(any_value(hi), 7) AS upper_bound,
  round(count(*) FILTER (value < lo OR value > hi) / count(*), 6) AS outlier_ratio
FROM ev_rows JOIN b USING (series_id) GROUP BY 1""")
def iqr_outliers(spark, d):
    out = outliers.iqr_report(P.event_rows(spark, d), unbounded=True)
    return out.select("series_id", "outlier_count", "n_rows", *_r("lower_bound", "upper_bound"),
                      *_r("outlier_ratio", digits=6))


@query("zscore_outliers", _Z + """
SELECT series_id, count(*) FILTER (abs((value - mu) / sd) > 3) AS outlier_count, round(any_value(mu), 7) AS mean,
  round(any_value(sd), 7) AS sd, round(any_value(lo), 7) AS lower_bound, round(any_value(hi), 7) AS upper_bound
FROM ev_rows JOIN b USING (series_id) GROUP BY 1""")
def zscore_outliers(spark, d):
    out = outliers.zscore_report(P.event_rows(spark, d))
    return out.select("series_id", "outlier_count", *_r("mean", "sd", "lower_bound", "upper_bound"))


for _name, _strategy, _head, _expr in (
    ("iqr_clip", "clip", _IQR, "CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END"),
    ("zscore_clip", "zscore_clip", _Z, "CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END"),
    ("remove_outliers", "remove", _IQR, "CASE WHEN value BETWEEN lo AND hi THEN value END"),
):
    @query(_name, f"{_head} SELECT series_id, seq, round({_expr}, 6) AS value FROM ev_rows JOIN b USING (series_id)")
    def _treat(spark, d, strategy=_strategy):
        out = outliers.treat_outliers(P.event_rows(spark, d), strategy, unbounded=True)
        return out.select("series_id", "seq", *_r("value", digits=6))


@query("winsorise", """
WITH q AS (SELECT series_id, count(value) n, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM usr_raw GROUP BY 1)
SELECT series_id, ts, round(CASE WHEN n >= 4 THEN least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) ELSE value END, 6) AS value
FROM usr_raw JOIN q USING (series_id)""")
def winsorise(spark, d):
    return outliers.winsorise(P.user_day_raw(spark, d)).select("series_id", "ts", *_r("value", digits=6))


@query("ewm_smooth", """
WITH RECURSIVE s AS (
  SELECT series_id, t, value AS smoothed FROM sup_prep WHERE t = 0
  UNION ALL
  SELECT p.series_id, p.t, 2.0 / 7 * p.value + 5.0 / 7 * s.smoothed FROM s JOIN sup_prep p ON p.series_id = s.series_id AND p.t = s.t + 1)
SELECT series_id, t, round(smoothed, 7) AS smoothed FROM s""")
def ewm_smooth(spark, d):
    out = smooth.smooth(P.supplier_prep(spark, d), "ewma", span=6)
    return out.select("series_id", "t", *_r("smoothed"))


@query("savgol_smooth", """
WITH n AS (SELECT series_id, count(*) AS n FROM sup_prep GROUP BY 1),
p AS (SELECT series_id, t, n, greatest(0, least(t - 5, n - 11)) AS s FROM sup_prep JOIN n USING (series_id))
SELECT p.series_id, p.t, round(sum(q.value * (1.0 / 11 + (p.t - p.s - 5) * (q.t - p.s - 5) / 110.0
   + ((p.t - p.s - 5) ** 2 - 10) * ((q.t - p.s - 5) ** 2 - 10) / 858.0)), 7) AS smoothed
FROM p JOIN sup_prep q ON q.series_id = p.series_id AND q.t BETWEEN p.s AND p.s + 10
GROUP BY 1, 2""")
def savgol_smooth(spark, d):
    out = smooth.smooth(P.supplier_prep(spark, d), "savgol")
    return out.select("series_id", "t", *_r("smoothed"))


@query("rolling_centred", """
WITH n AS (SELECT series_id, count(*) n, greatest(5, count(*) // 10) w FROM sup_prep GROUP BY 1)
SELECT a.series_id, a.t, round(avg(b.value), 7) AS roll_mean, round(var_samp(b.value), 3) AS roll_var
FROM sup_prep a JOIN n USING (series_id)
JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - (w - 1 - (w - 1) // 2) AND a.t + (w - 1) // 2
GROUP BY a.series_id, a.t, w HAVING count(*) = w""")
def rolling_centred(spark, d):
    window = F.greatest(F.lit(5), F.floor(F.col("n") / 10))
    out = rolling.rolling_moments(P.supplier_prep(spark, d), window, centred=True)
    return out.select("series_id", "t", *_r("roll_mean"), *_r("roll_var", digits=3))


@query("rolling_trailing_hours", """
SELECT a.series_id, a.t, round(avg(b.value), 9) AS roll_mean, round(var_samp(b.value), 3) AS roll_var
FROM hr_prep a JOIN hr_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - 23 AND a.t
GROUP BY 1, 2 HAVING count(*) = 24""")
def rolling_trailing_hours(spark, d):
    out = rolling.rolling_moments(P.hour_prep(spark, d, 128), F.lit(24), block=128)
    return out.select("series_id", "t", *_r("roll_mean", digits=9), *_r("roll_var", digits=3))


@query("variance_stability", """
WITH n AS (SELECT series_id, count(*) n, greatest(5, count(*) // 10) w, min(value) lo FROM sup_prep GROUP BY 1),
r AS (SELECT a.series_id, a.t, avg(b.value) m, stddev_samp(b.value) s, any_value(lo) lo, any_value(n) n
  FROM sup_prep a JOIN n USING (series_id) JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - w + 1 AND a.t
  GROUP BY a.series_id, a.t, w HAVING count(*) = w)
SELECT series_id, round(corr(m, s), 7) AS correlation, abs(corr(m, s)) > 0.6 AND any_value(lo) > 0 AS is_unstable
FROM r GROUP BY 1""")
def variance_stability(spark, d):
    out = rolling.variance_stability(P.supplier_prep(spark, d))
    return out.select("series_id", *_r("correlation"), "is_unstable")


@query("intermittency", """
SELECT series_id, 'ok' AS status, round(avg((value = 0)::INT), 6) AS zero_ratio,
  round(CASE WHEN count(*) FILTER (value > 0) >= 2 THEN (max(t) FILTER (value > 0) - min(t) FILTER (value > 0)) / (count(*) FILTER (value > 0) - 1) END, 6) AS mean_nonzero_interval,
  avg((value = 0)::INT) >= 0.4 OR coalesce(CASE WHEN count(*) FILTER (value > 0) >= 2 THEN (max(t) FILTER (value > 0) - min(t) FILTER (value > 0)) / (count(*) FILTER (value > 0) - 1) END, 0) >= 2 AS is_intermittent
FROM (SELECT series_id, t, coalesce(value, 0) AS value FROM usr_grid) GROUP BY 1""")
def intermittency(spark, d):
    rows = grid.reindex(P.user_day_raw(spark, d), "D").na.fill(0.0, ["value"])
    out = quality.intermittency(rows)
    return out.select("series_id", "status", *_r("zero_ratio", "mean_nonzero_interval", digits=6), "is_intermittent")


@query("skew_trigger", """
SELECT series_id, min(value) = max(value) AS is_constant, stddev_pop(value) < 1e-8 AS near_zero_spread,
  round(skewness(value), 6) AS skewness,
  CASE WHEN abs(skewness(value)) > 1 THEN CASE WHEN bool_and(value > 0) THEN 'Box-Cox' ELSE 'Yeo-Johnson' END END AS transform
FROM ev_rows GROUP BY 1""")
def skew_trigger(spark, d):
    out = quality.constant_and_skew(P.event_rows(spark, d))
    return out.select("series_id", "is_constant", "near_zero_spread", *_r("skewness", digits=6), "transform")


_DECOMP = """
WITH n AS (SELECT series_id, count(*) AS n FROM sup_prep GROUP BY 1),
ma AS (SELECT p.series_id, p.t, p.value, n,
   CASE WHEN t BETWEEN 6 AND n - 7 THEN (sum(value) OVER w - 0.5 * lag(value, 6) OVER o - 0.5 * lead(value, 6) OVER o) / 12 END AS ma
  FROM sup_prep p JOIN n USING (series_id)
  WINDOW o AS (PARTITION BY p.series_id ORDER BY t), w AS (PARTITION BY p.series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
l AS (SELECT series_id, regr_slope(ma, t) FILTER (t < least(18, n - 7)) ks, regr_intercept(ma, t) FILTER (t < least(18, n - 7)) ki,
   regr_slope(ma, t) FILTER (t >= greatest(6, n - 19) AND t < n - 7) es, regr_intercept(ma, t) FILTER (t >= greatest(6, n - 19) AND t < n - 7) ei
  FROM ma GROUP BY 1),
tr AS (SELECT ma.*, CASE WHEN t < 6 THEN ki + ks * t WHEN t > n - 7 THEN ei + es * t ELSE ma END AS trend FROM ma JOIN l USING (series_id)),
s AS (SELECT series_id, t % 12 AS ph, avg(value - trend) AS s FROM tr GROUP BY 1, 2),
sb AS (SELECT series_id, avg(s) AS sbar FROM s GROUP BY 1),
dec AS (SELECT tr.series_id, tr.t, tr.value, trend, s - sbar AS seasonal, value - trend - (s - sbar) AS resid
  FROM tr JOIN s ON s.series_id = tr.series_id AND s.ph = tr.t % 12 JOIN sb ON sb.series_id = tr.series_id)"""


@query("classical_decompose", _DECOMP + """
SELECT series_id, t, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM dec""")
def classical_decompose(spark, d):
    out = decompose.classical_decompose(P.supplier_prep(spark, d), 12)
    return out.select("series_id", "t", *_r("trend", "seasonal", "resid", digits=6))


@query("seasonal_strength", _DECOMP + """
SELECT series_id, round(least(1, greatest(0, 1 - var_pop(resid) / var_pop(resid + seasonal))), 6) AS strength FROM dec GROUP BY 1""")
def seasonal_strength(spark, d):
    parts = decompose.classical_decompose(P.supplier_prep(spark, d), 12)
    return parts.groupBy("series_id").agg(
        F.round(decompose.seasonal_strength(F.col("resid"), F.col("seasonal")), 6).alias("strength"))


@query("impute_seasonal", """
WITH p0 AS (SELECT series_id, t, value AS raw, coalesce(value, v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(ts0)) / (epoch_us(ts1) - epoch_us(ts0)), v0, v1) AS value FROM sup_near),
""" + _DECOMP.strip()[5:].replace("sup_prep", "p0") + """
SELECT p0.series_id, p0.t, round(coalesce(p0.raw, dec.trend + dec.seasonal), 6) AS value
FROM p0 JOIN dec ON dec.series_id = p0.series_id AND dec.t = p0.t""")
def impute_seasonal(spark, d):
    out = decompose.impute_seasonal(P.gridded(P.supplier_raw(spark, d), "MS"), 12)
    return out.select("series_id", "t", *_r("value", digits=6))


@query("describe_panel", """
SELECT series_id, count(value) AS n, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS sd, min(value) AS min,
  round(quantile_cont(value, 0.5), 7) AS median, max(value) AS max FROM ev_rows GROUP BY 1""")
def describe_panel(spark, d):
    rows = P.event_rows(spark, d)
    moments = rows.groupBy("series_id").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 7).alias("mean"),
        F.round(F.stddev_samp("value"), 7).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    # five series hold all events: the median comes from split ranges, not from one buffer
    median = series_quantiles(rows, ["series_id"], "value", (0.5,), unbounded=True)
    return moments.join(median, "series_id", "left").select(
        "series_id", "n", "mean", "sd", "min", F.round("q0", 7).alias("median"), "max")


@query("fold_safe_zclip", """
WITH q AS (SELECT series_id, avg(value) mu, stddev_pop(value) sd FROM sup_raw GROUP BY 1)
SELECT series_id, ts, round(CASE WHEN sd > 0 THEN least(greatest(value, mu - 3 * sd), mu + 3 * sd) ELSE value END, 7) AS value
FROM sup_raw JOIN q USING (series_id)""")
def fold_safe_zclip(spark, d):
    out = outliers.treat_outliers(P.supplier_raw(spark, d), "zscore_clip", population=True)
    return out.select("series_id", "ts", *_r("value"))


@query("future_input_fill", """
WITH l AS (SELECT series_id, arg_max(value, t) FILTER (value IS NOT NULL AND t < 40) AS last FROM hr_grid GROUP BY 1)
SELECT series_id, t, coalesce(value, last) AS value FROM hr_grid JOIN l USING (series_id) WHERE t >= 40""")
def future_input_fill(spark, d):
    rows = grid.reindex(P.hour_raw(spark, d), "h")
    out = impute.fill_future_inputs(rows.filter("t < 40"), rows.filter("t >= 40"))
    return out.select("series_id", "t", "value")
