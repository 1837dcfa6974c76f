"""Features of expanding windows from one reading, against windows that copy rows."""

import numpy as np
import pytest

from seriesloom.operators import candidates as C
from seriesloom.operators import folds as FO
from seriesloom.operators.impute import impute_training
from seriesloom.operators.stretches import fold_features
from seriesloom.plans import evaluation as E
from tests.data import SCHEMA, month

FK = ("series_id", "fold", "kind")


def gappy(spark):
    rng = np.random.default_rng(11)
    series = {}
    for i in range(40):
        n = int(rng.integers(3, 90))
        values = [None if rng.random() < (0.1 + 0.2 * (i % 4)) else float(round(rng.normal(50, 9), 3)) for _ in range(n)]
        if i % 5 == 0:
            # long gaps at the head and across fold ends
            values[: n // 3] = [None] * (n // 3)
            values[n // 2 : n // 2 + n // 4] = [None] * (n // 4)
        series[f"s{i}"] = values
    series["none"], series["late"], series["one"] = [None] * 40, [None] * 38 + [1.0, 2.0], [5.0] + [None] * 39
    rows = [(k, j, month(j), v) for k, vs in series.items() for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("period, horizon, origins, block", [(12, 6, 5, None), (4, 3, None, None), (1, 1, 5, 16), (60, 2, 3, 16)])
def test_same_as_copied_windows(spark, period, horizon, origins, block):
    panel = gappy(spark)
    folds = FO.fold_plan(FO.series_sizes(panel), horizon, max_origins=origins)
    train = impute_training(FO.training_windows(panel, folds), keys=FK)
    want = {(r["series_id"], r["fold"], r["kind"]): r for r in C.baseline_features(train, period, FK, ("horizon",)).collect()}
    got = {(r["series_id"], r["fold"], r["kind"]): r for r in fold_features(panel, folds, period, block).collect()}
    assert set(got) == set(want) and len(got) > 40
    for k, r in want.items():
        g = got[k]
        assert (g["n_train"], g["horizon"]) == (r["n_train"], r["horizon"])
        assert [g["last"], g["first"], g["mean"]] == pytest.approx([r["last"], r["first"], r["mean"]], rel=1e-12)
        assert g["season"] == pytest.approx(r["season"], rel=1e-12), k


def test_scores_are_those_of_copied_windows(spark):
    panel = gappy(spark)
    bt = E.backtest(panel, 4, 3)
    old = E.Backtest(bt.panel, bt.folds, bt.windows, bt.actuals, 4, 3)
    for frames in ((bt.baselines(), old.baselines()), (bt.errors(bt.baselines()), old.errors(old.baselines()))):
        a, b = ({(r["series_id"], r["fold"], r["kind"], r["model"], r["h"]): r.asDict() for r in f.collect()} for f in frames)
        assert set(a) == set(b)
        for k in a:
            for c in ("yhat", "y", "scale", "scale_sq"):
                assert a[k].get(c) == (None if b[k].get(c) is None else pytest.approx(b[k][c], rel=1e-12)), (k, c)


def test_one_reading(spark):
    """Only the fold plan makes rows (read for the ends and for the result); panel rows are never copied."""
    panel = gappy(spark)
    folds = FO.fold_plan(FO.series_sizes(panel), 3)
    plan = fold_features(panel, folds, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("Generate inline") == folds._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") * 2


def test_empty(spark):
    panel = gappy(spark).limit(0)
    assert fold_features(panel, FO.fold_plan(FO.series_sizes(panel), 3), 4).count() == 0
