"""Series without spread, zero vectors, and preparation that stays inside a fold."""

import pytest

from seriesloom.operators import retrieval, rolling, smooth, trend
from seriesloom.plans.evaluation import prepare_training
from tests.data import AIRLINE, panel

MIXED = {"flat": [100.0] * 40, "zero": [0.0] * 40, "air": list(AIRLINE[:60])}


def by_series(df):
    return {r["series_id"]: r for r in df.collect()}


def test_series_without_spread_have_results(spark):
    rows = panel(spark, MIXED)
    ols, hac = by_series(trend.trend_ols(rows)), by_series(trend.trend_hac(rows))
    level, slope = by_series(trend.kpss(rows, "c")), by_series(trend.kpss(rows, "ct"))
    stable = by_series(rolling.variance_stability(rows))
    for name in ("flat", "zero"):
        assert ols[name]["r2"] == 0 and ols[name]["p_value"] == 1 and not ols[name]["has_trend"]
        assert hac[name]["has_trend"] is False and hac[name]["z_stat"] is None
        assert level[name]["statistic"] is None and slope[name]["statistic"] is None
        assert stable[name]["is_unstable"] is False
    assert ols["air"]["has_trend"] and hac["air"]["has_trend"] and level["air"]["statistic"] > 0


def test_zero_vector_ranks_last(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, vector array<double>")
    got = [(r["vec_id"], r["similarity"]) for r in retrieval.cosine_top_k(corpus, queries, 3).orderBy("rank").collect()]
    assert got == [(3, 1.0), (1, 0.0), (2, None)]


@pytest.mark.parametrize("method", ["ewma", "savgol"])
def test_smoothing_stays_inside_a_fold(spark, method):
    long, short = [10.0 + i for i in range(24)], [30.0 + (i % 5) for i in range(12)]
    alone = {k: [r["smoothed"] for r in smooth.smooth(panel(spark, {"s": v}), method).orderBy("t").collect()] for k, v in ((0, long), (1, short))}
    rows = [("s", k, "rolling", t, v) for k, values in ((0, long), (1, short)) for t, v in enumerate(values)]
    train = spark.createDataFrame(rows, "series_id string, fold int, kind string, t long, value double")
    got = prepare_training(train, keys=("series_id", "kind", "fold"), smoothing=method)
    for k in (0, 1):
        assert [r["value"] for r in got.filter(f"fold = {k}").orderBy("t").collect()] == pytest.approx(alone[k])
