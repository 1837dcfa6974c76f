"""Native statistical diagnostics on gap-free panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.calendar import DIAGNOSTIC_PERIODS, future_stamps, normalise_frequency, seasonal_period
from seriesloom.operators import anomalies as A
from seriesloom.operators import dependence as D
from seriesloom.operators import spectral as SP
from seriesloom.operators import trend as T
from seriesloom.plans import panels as P
from seriesloom.plans.registry import cte, query


def _r(*names, digits=5):
    return [F.round(F.col(n), digits).alias(n) for n in names]


cte("sup_fit", """
SELECT series_id, count(*) AS n, avg(value) AS mean, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept,
  regr_r2(value, t) AS r2, regr_sxx(value, t) AS sxx, avg(t) AS t_mean FROM sup_prep GROUP BY 1""")
cte("sup_res", """
SELECT p.series_id, t, value, n, value - intercept - slope * t AS resid, (t - t_mean) / sxx * (value - intercept - slope * t) AS z
FROM sup_prep p JOIN sup_fit USING (series_id)""")
cte("sup_acf", """
WITH m AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM sup_prep),
c0 AS (SELECT series_id, sum(d * d) AS c0 FROM m GROUP BY 1)
SELECT a.series_id, k AS lag, any_value(a.n) AS n, sum(a.d * b.d) / any_value(c0) AS acf
FROM m a JOIN c0 USING (series_id), (SELECT unnest(range(1, 41)) AS k) JOIN m b ON b.series_id = a.series_id AND b.t = a.t - k
GROUP BY 1, 2 HAVING k <= least(40, any_value(a.n) // 2 - 1)""")
cte("sup_pgram", """
SELECT series_id, n, k, k / n AS frequency,
 (sum(resid * cos(2 * pi() * k * t / n)) ** 2 + sum(resid * sin(2 * pi() * k * t / n)) ** 2) / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS power
FROM sup_res, (SELECT unnest(range(1, 100)) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3""")


@query("trend_ols", """
SELECT series_id, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 8) AS r2,
  round(sqrt(r2 * (n - 2) / (1 - r2)), 5) AS t_abs, CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END AS direction FROM sup_fit""")
def trend_ols(spark, d):
    out = T.trend_ols(P.supplier_prep(spark, d))
    return out.select("series_id", "n", *_r("slope", digits=6), *_r("intercept", digits=4), *_r("r2", digits=8),
                      *_r("t_abs"), "direction")


@query("trend_ols_pvalue")
def trend_ols_pvalue(spark, d):
    return T.trend_ols(P.supplier_prep(spark, d))


@query("detrend", "SELECT series_id, t, round(resid, 7) AS resid FROM sup_res")
def detrend(spark, d):
    return T.detrend(P.supplier_prep(spark, d)).select("series_id", "t", *_r("resid", digits=7))


@query("trend_hac_stat", """
WITH l AS (SELECT series_id, greatest(1, n // 5) AS ml FROM sup_fit),
s AS (SELECT a.series_id, sum(CASE WHEN b.t = a.t THEN 1 ELSE 2 * (1 - (a.t - b.t) / (ml + 1)) END * a.z * b.z) AS v
  FROM sup_res a JOIN l USING (series_id) JOIN sup_res b ON b.series_id = a.series_id AND b.t BETWEEN a.t - ml AND a.t GROUP BY 1)
SELECT series_id, round(slope, 6) AS slope, round(r2, 8) AS effect_size, round(sqrt(v), 6) AS hac_se, round(slope / sqrt(v), 4) AS z_stat
FROM sup_fit JOIN s USING (series_id)""")
def trend_hac_stat(spark, d):
    out = T.trend_hac(P.supplier_prep(spark, d))
    return out.select("series_id", *_r("slope", digits=6), *_r("effect_size", digits=8), *_r("hac_se", digits=6),
                      *_r("z_stat", digits=4))


_KPSS = """
WITH e AS (SELECT p.series_id, t, n, {resid} AS e FROM sup_prep p JOIN sup_fit USING (series_id)),
lp AS (SELECT a.series_id, a.n, a.t - b.t AS i, sum(a.e * b.e) AS g FROM e a JOIN e b ON b.series_id = a.series_id AND b.t <= a.t GROUP BY 1, 2, 3),
w AS (SELECT series_id, n, sum(CASE WHEN i = 0 THEN g / n WHEN i <= CAST(floor(n ** (2.0 / 9)) AS BIGINT) THEN 2 * g / n ELSE 0 END) AS s0,
  sum(CASE WHEN i BETWEEN 1 AND CAST(floor(n ** (2.0 / 9)) AS BIGINT) THEN 2 * i * g / n ELSE 0 END) AS s1 FROM lp GROUP BY 1, 2),
bw AS (SELECT series_id, n, least(n - 1, CAST(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)) AS BIGINT)) AS lags FROM w),
v AS (SELECT lp.series_id, lags, sum(CASE WHEN i = 0 THEN g WHEN i <= lags THEN 2 * g * (1 - i / (lags + 1)) ELSE 0 END) / any_value(lp.n) AS v
  FROM lp JOIN bw USING (series_id) GROUP BY 1, 2),
ps AS (SELECT series_id, n, sum(e) OVER (PARTITION BY series_id ORDER BY t) AS s FROM e)
SELECT v.series_id, lags, round(sum(s * s) / (any_value(n) * any_value(n)) / any_value(v), 5) AS statistic
FROM ps JOIN v USING (series_id) GROUP BY 1, 2"""


@query("kpss_stat", _KPSS.format(resid="value - mean"))
def kpss_stat(spark, d):
    return T.kpss(P.supplier_prep(spark, d), "c").select("series_id", "lags", *_r("statistic"))


@query("kpss_trend_stat", _KPSS.format(resid="value - intercept - slope * t"))
def kpss_trend_stat(spark, d):
    return T.kpss(P.supplier_prep(spark, d), "ct").select("series_id", "lags", *_r("statistic"))


@query("kpss_pvalue")
def kpss_pvalue(spark, d):
    return T.kpss(P.supplier_prep(spark, d), "c")


@query("acf", """
SELECT series_id, lag, round(acf, 6) AS acf, round(1.96 / sqrt(least(40, n // 2 - 1) + 1), 6) AS band FROM sup_acf
UNION ALL SELECT series_id, 0, 1.0, round(1.96 / sqrt(least(40, n // 2 - 1) + 1), 6) FROM sup_fit""")
def acf(spark, d):
    return D.acf_table(P.supplier_prep(spark, d)).select("series_id", "lag", *_r("acf", "band", digits=6))


@query("pacf_low_lags", """
WITH r AS (SELECT series_id, max(acf) FILTER (lag = 1) r1, max(acf) FILTER (lag = 2) r2, max(acf) FILTER (lag = 3) r3 FROM sup_acf GROUP BY 1)
SELECT series_id, round(r1, 6) AS p1, round((r2 - r1 * r1) / (1 - r1 * r1), 6) AS p2,
 round((r1 ** 3 - 2 * r1 * r2 + r3 + r1 * r2 * r2 - r1 * r1 * r3) / (1 - 2 * r1 * r1 + 2 * r1 * r1 * r2 - r2 * r2), 6) AS p3 FROM r""")
def pacf_low_lags(spark, d):
    t = D.acf_table(P.supplier_prep(spark, d)).filter(F.col("lag").between(1, 3))
    return t.groupBy("series_id").agg(*[
        F.round(F.max(F.when(F.col("lag") == k, F.col("pacf"))), 6).alias(f"p{k}") for k in (1, 2, 3)])


@query("ljung_box_stat", """
SELECT series_id, least(10, greatest(1, any_value(n) // 5)) AS lag, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) FILTER (lag <= least(10, greatest(1, n // 5))), 5) AS statistic
FROM sup_acf GROUP BY series_id""")
def ljung_box_stat(spark, d):
    return D.ljung_box(P.supplier_prep(spark, d)).select("series_id", "lag", *_r("statistic"))


@query("ljung_box_pvalue")
def ljung_box_pvalue(spark, d):
    return D.ljung_box(P.supplier_prep(spark, d), df_adjust=2, half_cap=True)


@query("periodogram", "SELECT series_id, k, round(frequency, 8) AS frequency, round(power, 3) AS power FROM sup_pgram")
def periodogram(spark, d):
    out = SP.periodogram(T.detrend(P.supplier_prep(spark, d)))
    return out.select("series_id", "k", *_r("frequency", digits=8), *_r("power", digits=3))


@query("dominant_period", """
SELECT series_id, round(1 / arg_max(frequency, power), 6) AS dominant_period FROM sup_pgram GROUP BY 1""")
def dominant_period(spark, d):
    out = SP.dominant_period(SP.periodogram(T.detrend(P.supplier_prep(spark, d))))
    return out.select("series_id", *_r("dominant_period", digits=6))


@query("candidate_periods", """
WITH RECURSIVE c AS (SELECT series_id, CAST(round_even(1 / frequency, 0) AS INTEGER) AS period, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, k DESC) AS rk
  FROM sup_pgram WHERE 1 / frequency >= 2 AND 1 / frequency <= n / 2.0),
w AS (SELECT series_id, rk, [period] AS acc FROM c WHERE rk = 1
  UNION ALL SELECT c.series_id, c.rk, CASE WHEN len(acc) < 5 AND NOT list_bool_or(list_transform(acc, lambda o:
     round_even(greatest(c.period, o) / least(c.period, o), 0) >= 2 AND abs(greatest(c.period, o) / least(c.period, o) - round_even(greatest(c.period, o) / least(c.period, o), 0)) < 0.15))
   THEN list_append(acc, c.period) ELSE acc END FROM w JOIN c ON c.series_id = w.series_id AND c.rk = w.rk + 1)
SELECT series_id, array_to_string(arg_max(acc, rk), ',') AS candidates FROM w GROUP BY 1""")
def candidate_periods(spark, d):
    out = SP.candidate_periods(SP.periodogram(T.detrend(P.supplier_prep(spark, d))))
    return out.select("series_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query("mad_anomalies", """
WITH m AS (SELECT series_id, quantile_cont(resid, 0.5) AS med FROM sup_res GROUP BY 1),
a AS (SELECT r.*, med, abs(resid - med) AS dev FROM sup_res r JOIN m USING (series_id)),
s AS (SELECT series_id, quantile_cont(dev, 0.5) AS mad FROM a GROUP BY 1)
SELECT a.series_id, t, CASE WHEN resid > med THEN 'positive_spike' ELSE 'negative_spike' END AS anomaly
FROM a JOIN s USING (series_id) WHERE dev / (mad * 1.4826) > 3.5""")
def mad_anomalies(spark, d):
    flags = A.mad_flags(T.detrend(P.supplier_prep(spark, d)))
    return flags.filter(F.col("anomaly").isNotNull()).select("series_id", "t", "anomaly")


@query("anomaly_summary", """
WITH m AS (SELECT series_id, quantile_cont(resid, 0.5) AS med FROM sup_res GROUP BY 1),
a AS (SELECT r.*, med, abs(resid - med) AS dev FROM sup_res r JOIN m USING (series_id)),
s AS (SELECT series_id, quantile_cont(dev, 0.5) AS mad FROM a GROUP BY 1)
SELECT a.series_id, count(*) FILTER (dev / (mad * 1.4826) > 3.5) AS anomaly_count,
  round(count(*) FILTER (dev / (mad * 1.4826) > 3.5) / count(*), 6) AS anomaly_ratio, 'ok' AS status
FROM a JOIN s USING (series_id) GROUP BY 1""")
def anomaly_summary(spark, d):
    out = A.anomaly_summary(A.mad_flags(T.detrend(P.supplier_prep(spark, d))))
    return out.select("series_id", "anomaly_count", *_r("anomaly_ratio", digits=6), "status")


cte("sup_cusum", """
SELECT series_id, t, value, sd, sum(value - mu) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cusum
FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mu, stddev_samp(value) OVER (PARTITION BY series_id) AS sd FROM sup_prep)""")


@query("cusum_points", "SELECT series_id, t, round(abs(cusum), 6) AS size FROM sup_cusum WHERE abs(cusum) > 2 * sd")
def cusum_points(spark, d):
    return A.change_points(P.supplier_prep(spark, d), "cusum").select("series_id", "t", *_r("size", digits=6))


@query("rolling_mean_points", """
WITH n AS (SELECT series_id, count(*) n, greatest(3, count(*) // 10) w1, greatest(5, count(*) // 5) w2, stddev_samp(value) sd FROM sup_prep GROUP BY 1),
r1 AS (SELECT a.series_id, a.t, avg(b.value) m FROM sup_prep a JOIN n USING (series_id)
  JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - (w1 - 1 - (w1 - 1) // 2) AND a.t + (w1 - 1) // 2 GROUP BY a.series_id, a.t, w1 HAVING count(*) = w1),
r2 AS (SELECT a.series_id, a.t, avg(b.value) m FROM sup_prep a JOIN n USING (series_id)
  JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - (w2 - 1 - (w2 - 1) // 2) AND a.t + (w2 - 1) // 2 GROUP BY a.series_id, a.t, w2 HAVING count(*) = w2)
SELECT r1.series_id, r1.t, round(abs(r1.m - r2.m), 7) AS size FROM r1 JOIN r2 USING (series_id, t) JOIN n USING (series_id) WHERE abs(r1.m - r2.m) > sd""")
def rolling_mean_points(spark, d):
    return A.change_points(P.supplier_prep(spark, d), "rolling_mean").select("series_id", "t", *_r("size", digits=7))


@query("rolling_variance_points", """
WITH n AS (SELECT series_id, greatest(10, count(*) // 4) w, stddev_samp(value) sd FROM sup_prep GROUP BY 1),
r AS (SELECT a.series_id, a.t, var_samp(b.value) v FROM sup_prep a JOIN n USING (series_id)
  JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - (w - 1 - (w - 1) // 2) AND a.t + (w - 1) // 2 GROUP BY a.series_id, a.t, w HAVING count(*) = w),
m AS (SELECT series_id, avg(v) mv FROM r GROUP BY 1)
SELECT r.series_id, r.t, round(v, 6) AS size FROM r JOIN m USING (series_id) JOIN n USING (series_id) WHERE v > mv + 0.1 * sd""")
def rolling_variance_points(spark, d):
    return A.change_points(P.supplier_prep(spark, d), "fft").select("series_id", "t", *_r("size", digits=6))


@query("cusum_split", """
SELECT series_id, round(max(abs(cusum)), 6) AS max_abs_cusum, arg_max(t, abs(cusum)) AS split_at FROM sup_cusum GROUP BY 1""")
def cusum_split(spark, d):
    return A.cusum_split(P.supplier_prep(spark, d)).select("series_id", *_r("max_abs_cusum", digits=6), "split_at")


@query("variance_breaks", """
WITH RECURSIVE n AS (SELECT series_id, count(*) n, greatest(5, count(*) // 10) w FROM sup_prep GROUP BY 1),
r AS (SELECT a.series_id, a.t, var_samp(b.value) v FROM sup_prep a JOIN n USING (series_id)
  JOIN sup_prep b ON b.series_id = a.series_id AND b.t BETWEEN a.t - (w - 1 - (w - 1) // 2) AND a.t + (w - 1) // 2 GROUP BY a.series_id, a.t, w HAVING count(*) = w),
m AS (SELECT series_id, avg(v) + 3 * stddev_pop(v) AS lim FROM r GROUP BY 1),
h AS (SELECT r.series_id, r.t, row_number() OVER (PARTITION BY r.series_id ORDER BY r.t) AS k FROM r JOIN m USING (series_id) WHERE v > lim),
g AS (SELECT series_id, k, t AS last, [t] AS acc FROM h WHERE k = 1
  UNION ALL SELECT h.series_id, h.k, CASE WHEN h.t - last >= 5 THEN h.t ELSE last END, CASE WHEN h.t - last >= 5 THEN list_append(acc, h.t) ELSE acc END FROM g JOIN h ON h.series_id = g.series_id AND h.k = g.k + 1),
f AS (SELECT series_id, arg_max(acc, k) AS acc FROM g GROUP BY 1)
SELECT n.series_id, coalesce(array_to_string(acc, ','), '') AS variance_breaks FROM n LEFT JOIN f USING (series_id)""")
def variance_breaks(spark, d):
    out = A.variance_breaks(P.supplier_prep(spark, d))
    return out.select("series_id", F.array_join(F.col("variance_breaks").cast("array<string>"), ",").alias("variance_breaks"))


@query("hourly_cusum_split", """
WITH c AS (SELECT series_id, t, sum(value - mu) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mu FROM hr_prep))
SELECT series_id, round(max(abs(c)), 6) AS max_abs_cusum, arg_max(t, abs(c)) AS split_at FROM c GROUP BY 1""")
def hourly_cusum_split(spark, d):
    out = A.cusum_split(P.hour_prep(spark, d, 128), block=128)
    return out.select("series_id", *_r("max_abs_cusum", digits=6), "split_at")


@query("hourly_acf", """
WITH m AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS d FROM hr_prep),
c0 AS (SELECT series_id, sum(d * d) AS c0 FROM m GROUP BY 1)
SELECT a.series_id, k AS lag, round(sum(a.d * b.d) / any_value(c0), 6) AS acf
FROM m a JOIN c0 USING (series_id), (SELECT unnest(range(1, 25)) AS k) JOIN m b ON b.series_id = a.series_id AND b.t = a.t - k GROUP BY 1, 2""")
def hourly_acf(spark, d):
    arrays = D.acf_arrays(P.hour_prep(spark, d, 128), 24, block=128)
    return arrays.select("series_id", F.posexplode("acf").alias("_i", "acf")).select(
        "series_id", (F.col("_i") + 1).alias("lag"), *_r("acf", digits=6))


@query("seasonal_period_lookup", """
WITH f AS (SELECT series_id, CASE WHEN count(DISTINCT ts) = date_diff('hour', min(ts), max(ts)) + 1 THEN 'h' END AS freq FROM hr_raw GROUP BY 1)
SELECT series_id, CASE WHEN freq = 'h' THEN 24 ELSE 12 END AS cleaning_period, CASE WHEN freq = 'h' THEN 24 END AS diagnostic_period,
  CASE WHEN freq = 'h' THEN 'H' ELSE '' END AS normalised FROM f""")
def seasonal_period_lookup(spark, d):
    from seriesloom.operators.frequency import regular_frequency

    f = regular_frequency(P.hour_raw(spark, d))
    return f.select("series_id", seasonal_period(F.col("inferred")).alias("cleaning_period"),
                    seasonal_period(F.col("inferred"), None, DIAGNOSTIC_PERIODS).alias("diagnostic_period"),
                    normalise_frequency(F.col("inferred")).alias("normalised"))


@query("forecast_calendar", """
SELECT series_id, h, max(ts) + to_months(CAST(h AS INTEGER)) AS ts FROM sup_raw, (SELECT unnest(range(1, 13)) AS h) GROUP BY series_id, h""")
def forecast_calendar(spark, d):
    last = P.supplier_raw(spark, d).groupBy("series_id").agg(F.max("ts").alias("last"))
    return last.select("series_id", F.posexplode(future_stamps(F.col("last"), 12, "MS")).alias("_i", "ts")).select(
        "series_id", (F.col("_i") + 1).alias("h"), "ts")
