import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.calendar import normalise_frequency, period_index, period_stamp, seasonal_period
from seriesloom.operators import duplicates, frequency, grid, impute, outliers, quality, quantiles, rolling, scans, smooth
from tests.data import AIRLINE, generators, panel

RAW = "series_id string, ts timestamp_ntz, value double, seq long"


def sorted_values(df, col="value"):
    return [r[col] for r in df.orderBy("series_id", "t").collect()]


@pytest.mark.parametrize("freq,alias", [("h", "h"), ("D", "D"), ("W", "W"), ("MS", "MS"), ("QS", "QS"), ("YS", "YS"), ("B", "B")])
def test_period_stamps_match_the_pandas_calendar(spark, freq, alias):
    want = pd.date_range("2019-12-29", periods=60, freq=alias)
    rows = spark.createDataFrame([(x.to_pydatetime(),) for x in want], "ts timestamp_ntz")
    back = rows.select("ts", period_stamp(period_index(F.col("ts"), freq), freq).alias("b"), period_index(F.col("ts"), freq).alias("i"))
    got = back.orderBy("ts").collect()
    assert all(r.ts == r.b for r in got)
    assert [r.i - got[0].i for r in got] == list(range(60))


def test_frequency_aliases(spark):
    df = spark.createDataFrame([("ME",), ("W-SUN",), ("min",), ("QE-DEC",), ("h",), ("A",)], "f string")
    got = {r.f: (r.n, r.p) for r in df.select("f", normalise_frequency(F.col("f")).alias("n"), seasonal_period(F.col("f")).alias("p")).collect()}
    assert got["ME"] == ("MS", 12) and got["W-SUN"] == ("W", 52) and got["min"] == ("MS", 12)
    assert got["QE-DEC"][0] == "QS" and got["h"] == ("H", 24) and got["A"] == ("YS", 12)


@pytest.mark.parametrize("freq,step,want", [("MS", None, "MS"), ("D", 1, "D"), ("B", None, "B"), ("h", None, "h"), ("W-WED", 7, "W"), ("ME", None, "ME"), ("QS", None, "QS")])
def test_regular_frequency(spark, freq, step, want):
    stamps = pd.date_range("2022-01-03", periods=30, freq=freq)
    rows = [("a", s.to_pydatetime(), 1.0, i) for i, s in enumerate(stamps)]
    got = frequency.regular_frequency(spark.createDataFrame(rows, RAW)).collect()[0]
    assert got.inferred == want


def test_irregular_series_has_no_frequency_and_counts_gaps(spark):
    days = [1, 2, 4, 5, 7, 8, 10, 11, 12, 15]
    df = spark.createDataFrame([("a", dt.datetime(2023, 1, x), 1.0, x) for x in days], RAW)
    assert frequency.regular_frequency(df).collect()[0].inferred is None
    assert frequency.infer_frequency(df).collect()[0].frequency == "D"
    row = grid.missing_periods(df, "D").collect()[0]
    assert (row.missing_periods, row.is_regular) == (5, False)


def test_airline_audit(spark):
    df = panel(spark, {"air": AIRLINE}).withColumn("seq", F.col("t"))
    assert frequency.regular_frequency(df).collect()[0].inferred == "MS"
    row = grid.missing_periods(df, "MS").collect()[0]
    assert (row.missing_periods, row.is_regular) == (0, True)
    assert quality.audit(df).collect()[0].irregular is False


def test_duplicate_strategies(spark):
    stamp = dt.datetime(2023, 1, 1)
    rows = [("a", stamp, 1.0, 0), ("a", stamp, None, 1), ("a", stamp, 4.0, 2), ("b", stamp, None, 3), ("b", stamp, None, 4)]
    df = spark.createDataFrame(rows, RAW)
    got = lambda s: {r.series_id: r.value for r in duplicates.resolve_duplicates(df, s).collect()}
    assert got("keep-first")["a"] == 1.0 and got("latest")["a"] == 4.0 and got("mean")["a"] == 2.5
    assert got("sum") == {"a": 5.0, "b": 0.0} and got("mean")["b"] is None
    assert sum(r.is_duplicate for r in duplicates.flag_duplicates(df).collect()) == 3
    with pytest.raises(ValueError):
        duplicates.resolve_duplicates(df, "median")


@pytest.mark.parametrize("block", [None, 3, 7])
def test_segmented_fills_equal_pandas(spark, block):
    gen = np.random.default_rng(1)
    series = {}
    for k in range(4):
        v = gen.normal(size=40)
        v[gen.random(40) < 0.45] = np.nan
        series[f"s{k}"] = v
    df = panel(spark, {k: [None if np.isnan(x) else x for x in v] for k, v in series.items()})
    idx = pd.DatetimeIndex([r.ts for r in df.filter("series_id='s0'").orderBy("t").collect()])
    frames = {k: pd.Series(v, index=idx) for k, v in series.items()}
    checks = [
        (impute.forward_fill(df, block=block), lambda s: s.ffill()),
        (impute.forward_fill(df, limit=2, block=block), lambda s: s.ffill(limit=2)),
        (impute.backward_fill(df, block=block), lambda s: s.bfill()),
        (impute.interpolate_time(df, block=block), lambda s: s.interpolate(method="time")),
        (impute.interpolate_time(df, limit=1, block=block), lambda s: s.interpolate(method="time", limit=1)),
        (impute.interpolate_position(df, block=block), lambda s: s.reset_index(drop=True).interpolate(limit_direction="both").ffill().bfill()),
    ]
    for out, fn in checks:
        want = np.concatenate([fn(s).to_numpy() for s in frames.values()])
        got = np.array([np.nan if v is None else v for v in sorted_values(out)])
        np.testing.assert_allclose(got, want, equal_nan=True, atol=1e-9)


@pytest.mark.parametrize("block", [None, 5])
def test_running_sums_and_ordinals(spark, block):
    df = panel(spark, {"a": list(range(17)), "b": [1.0] * 9})
    out = scans.running_sums(df, ["series_id"], "t", {"s": F.col("value")}, block)
    want = list(np.cumsum(np.arange(17.0))) + list(np.cumsum(np.ones(9)))
    assert sorted_values(out, "s") == want
    ranked = scans.dense_ordinal(df.withColumn("axis", F.col("t") * 3), ["series_id"], "axis", ["axis"], "rank", block)
    assert sorted_values(ranked, "rank") == list(range(17)) + list(range(9))


def test_running_sums_carry_over_null_rows(spark):
    df = panel(spark, {"a": [1.0, 2.0, None, None, 5.0]})
    assert sorted_values(scans.running_sums(df, ["series_id"], "t", {"s": F.col("value")}, 2), "s") == [1.0, 3.0, 3.0, 3.0, 8.0]


@pytest.mark.parametrize("probs", [(0.25, 0.75), (0.5,), (0.0, 0.333, 1.0)])
def test_split_quantiles_are_exact(spark, probs):
    gen = np.random.default_rng(3)
    values = {"skewed": np.exp(gen.normal(size=3000) * 3), "tied": gen.integers(0, 5, 1500).astype(float), "one": np.array([7.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "series_id string, value double")
    got = {r.series_id: r for r in quantiles.series_quantiles(df, ["series_id"], "value", probs, True).collect()}
    for k, v in values.items():
        for i, p in enumerate(probs):
            assert got[k][f"q{i}"] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_outlier_treatment(spark):
    gen = np.random.default_rng(42)
    base = np.clip(gen.normal(100, 10, 100), 0, 200)
    base[10], base[50] = 500, -300
    df = panel(spark, {"x": list(base)})
    s = pd.Series(base)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    np.testing.assert_allclose(sorted_values(outliers.treat_outliers(df, "clip")), s.clip(lo, hi), rtol=1e-12)
    removed = sorted_values(outliers.treat_outliers(df, "remove"))
    assert removed[10] is None and removed[50] is None
    z = s.clip(s.mean() - 3 * s.std(), s.mean() + 3 * s.std())
    np.testing.assert_allclose(sorted_values(outliers.treat_outliers(df, "zscore_clip")), z, rtol=1e-12)
    flat = panel(spark, {"c": [5.0] * 10})
    assert outliers.zscore_report(flat).collect()[0].outlier_count == 0
    assert sorted_values(outliers.treat_outliers(flat, "zscore_clip")) == [5.0] * 10


def test_missing_values_are_never_invented_by_clipping(spark):
    df = panel(spark, {"x": [1.0, None, 3.0, 100.0, 2.0, 2.5]})
    assert sorted_values(outliers.treat_outliers(df, "clip"))[1] is None


@pytest.mark.parametrize("span", [2, 6, 40])
def test_ewm_equals_pandas(spark, span):
    values = np.random.default_rng(5).normal(size=900)
    out = smooth.ewm(panel(spark, {"x": list(values)}), smooth.span_alpha(span))
    want = pd.Series(values).ewm(span=span, adjust=False).mean()
    np.testing.assert_allclose(sorted_values(out, "smoothed"), want, atol=1e-10)


@pytest.mark.parametrize("n", [2, 3, 4, 8, 11, 30])
def test_savgol_window_rules(spark, n):
    values = [float(i * i) for i in range(n)]  # a quadratic is reproduced exactly
    out = sorted_values(smooth.savgol(panel(spark, {"x": values})), "smoothed")
    np.testing.assert_allclose(out, values, atol=1e-8)


@pytest.mark.parametrize("block", [None, 8])
@pytest.mark.parametrize("centred", [True, False])
def test_rolling_moments_equal_pandas(spark, block, centred):
    values = np.random.default_rng(6).normal(100, 3, 70)
    out = rolling.rolling_moments(panel(spark, {"x": list(values)}), F.greatest(F.lit(5), F.floor(F.col("n") / 10)) + 1, centred=centred, block=block)
    got = {r.t: (r.roll_mean, r.roll_var) for r in out.collect()}
    roll = pd.Series(values).rolling(8, center=centred)
    mean, var = roll.mean(), roll.var()
    assert set(got) == set(np.flatnonzero(mean.notna()))
    for t, (m, v) in got.items():
        assert m == pytest.approx(mean[t], abs=1e-9) and v == pytest.approx(var[t], abs=1e-8)


def test_schema_validation_and_monotonic_ingest(spark):
    rows = [("a", dt.datetime(2023, 1, d), v, i) for i, (d, v) in enumerate([(1, 1.0), (3, 2.0), (2, -5.0)])]
    r = quality.validate_schema(spark.createDataFrame(rows, RAW), "D", minimum=0.0).collect()[0]
    assert (r.freq_regular, r.index_monotonic, r.out_of_range_count, r.no_duplicates) == (True, False, 1, True)


def test_preflight_short_negative_series(spark):
    rows = [("a", dt.datetime(2023, 1, d), -1.0 if d == 3 else 1.0, d) for d in (1, 2, 3, 4, 6)]
    r = quality.preflight(spark.createDataFrame(rows, RAW), 12).collect()[0]
    assert r.status == "needs_input" and r.frequency == "D" and r.missing_periods == 1
    assert {"short_series", "horizon_exceeds_history", "negative_values"} <= set(r.warnings)
    assert {d.key for d in r.decisions} >= {"frequency", "data_domain", "continue_short_series"}


def test_intermittency(spark):
    df = panel(spark, {"gappy": [0, 3, 0, 0, 2, 0, 0, 0, 1], "neg": [-1, 0, 1], "dense": [1, 2, 3, 4]})
    got = {r.series_id: r for r in quality.intermittency(df).collect()}
    assert got["gappy"].is_intermittent and got["gappy"].mean_nonzero_interval == 3.5
    assert got["neg"].status == "not_applicable" and not got["dense"].is_intermittent


def test_constant_and_skew_match_pandas(spark):
    g = generators()
    got = {r.series_id: r for r in quality.constant_and_skew(panel(spark, {k: g[k] for k in ("constant", "trend", "isolated_anomalies")})).collect()}
    assert got["constant"].is_constant and not got["trend"].is_constant
    assert got["isolated_anomalies"].skewness == pytest.approx(pd.Series(g["isolated_anomalies"]).skew(), rel=1e-9)
