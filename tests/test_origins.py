"""Every origin of every candidate gets a status, from what was due, made and seen."""

import pytest

from seriesloom.operators import origins
from seriesloom.plans import evaluation as E

FOLDS = "series_id string, n long, fold int, kind string, train_end long, test_start long, test_end long, horizon long"
PRED = "series_id string, fold int, kind string, model string, h int, yhat double"


@pytest.fixture(scope="module")
def frames(spark):
    folds = spark.createDataFrame([("a", 9, 0, "rolling", 5, 5, 7, 2), ("a", 9, 1, "rolling", 7, 7, 9, 2), ("b", 3, 0, "rolling", 1, 1, 3, 2), ("c", 9, 0, "rolling", 7, 9, 11, 2)], FOLDS)
    made = [(f, m, h) for f, m, hs in ((0, "full", (1, 2)), (1, "full", (1, 2)), (0, "short", (1,)), (1, "short", (1, 2)), (0, "long", (1, 2, 3)), (0, "twice", (1, 1, 2)), (0, "stranger", (1, 2)), (0, "broken", (1, 2))) for h in hs]
    preds = spark.createDataFrame([("a", f, "rolling", m, h, float("nan") if (f, m, h) == (1, "full", 2) else 1.0 * h) for f, m, h in made] + [("b", 0, "rolling", "full", 1, 1.0), ("c", 0, "rolling", "full", 1, 1.0)], PRED)
    actuals = spark.createDataFrame([("a", f, "rolling", h, 5.0) for f in (0, 1) for h in (1, 2)] + [("b", 0, "rolling", 1, 5.0)], "series_id string, fold int, kind string, h int, y double")
    candidates = origins.same_candidates(folds, ["full", "short", "long", "twice", "nothing", "broken"])
    return folds, preds, actuals, origins.aligned(origins.due(folds, candidates), preds, actuals)


def test_statuses(spark, frames):
    *_, rows = frames
    fits = spark.createDataFrame([("a", 0, "rolling", "broken", "degraded", "roots"), ("a", 0, "rolling", "full", "ok", None)], "series_id string, fold int, kind string, model string, status string, reason string")
    got = {(r["series_id"], r["fold"], r["model"]): (r["status"], r["reason"]) for r in origins.origin_status(rows, fits).collect()}
    assert got["a", 0, "full"] == got["a", 1, "full"] == ("ok", None)
    assert got["a", 0, "short"] == ("failed", "steps 1 of 2") and got["a", 1, "short"] == ("ok", None)
    assert got["a", 0, "long"] == ("failed", "steps 3 of 2") and got["a", 0, "twice"] == ("failed", "steps 2 of 2")
    assert got["a", 0, "nothing"] == ("not_estimable", "no_prediction")
    assert got["a", 0, "broken"] == ("degraded", "roots")
    assert got["b", 0, "full"] == ("skipped", "training") and got["c", 0, "full"] == ("skipped", "no_actual")
    assert got["a", 0, "stranger"][0] in ("skipped", "failed")
    counts = {(r["series_id"], r["model"]): (r["n_origins"], r["n_failed_origins"]) for r in origins.origin_counts(origins.origin_status(rows, fits)).collect()}
    assert counts["a", "full"] == (2, 0) and counts["a", "short"] == (1, 1) and counts["a", "nothing"] == (0, 2) and counts["b", "full"] == (0, 0)


def test_nothing_is_lost_and_only_good_origins_are_scored(frames):
    _, preds, _, rows = frames
    assert rows.filter("predicted").count() == preds.dropDuplicates(["series_id", "fold", "model", "h"]).count()
    assert rows.filter("due and not predicted").count() > 0 and rows.filter("not due").count() == 3
    pairs = origins.scored(rows, origins.origin_status(rows)).filter("model = 'full'").orderBy("fold", "h").collect()
    assert [(r["fold"], r["h"], r["y"], r["yhat"]) for r in pairs] == [(0, 1, 5.0, 1.0), (0, 2, 5.0, 2.0), (1, 1, 5.0, 1.0), (1, 2, 5.0, None)]


def test_fallback_keeps_every_series(spark):
    refits = spark.createDataFrame([(s, m, o, h, 1.0) for s, m, o in (("a", "Naive", 9), ("a", "Drift", 12), ("b", "Drift", 12), ("b", "Mean Forecast", 11), ("c", "Own", 30)) for h in (1, 2)],
                                   "series_id string, model string, ord int, h int, yhat double")
    chosen = spark.createDataFrame([("a", "Drift", 2.5), ("b", "Naive", 1.5)], "series_id string, model string, selected_rmse double")
    got = {(r["series_id"], r["model"], r["status"], r["selected_rmse"]) for r in E.with_fallback(refits, chosen, ["Naive", "Drift"]).collect()}
    assert got == {("a", "Drift", "ok", 2.5), ("b", "Drift", "fallback", None), ("c", "Own", "fallback", None)}
