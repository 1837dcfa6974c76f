"""Fits of one block where they lie, transformed windows made once, stages whose files are as large as their rows."""

import math

import numpy as np
import pytest

from seriesloom.operators import levels, residuals
from seriesloom.operators.quantiles import list_quantile
from seriesloom.plans import evaluation
from seriesloom.staging import stage
from tests.data import panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(n, seed):
    return np.exp(np.random.default_rng(seed).normal(0, 1.2, size=n)).tolist()


def test_one_block_needs_no_row_for_a_trial(spark):
    gen = np.random.default_rng(5)
    rows = panel(spark, {"a": gen.normal(size=40).cumsum().tolist(), "b": gen.normal(size=9).tolist(), "flat": [3.0] * 5, "step": [1.0, 1.0, 1.0, 6.0]})
    blocks = stage(levels.level_blocks(rows, ["series_id"]), "blocks")
    found = levels.whole_grid(blocks, ["series_id"])
    assert "Generate" not in plan(found) and "hashpartitioning" not in plan(found)
    trials = {}
    for r in levels.level_grid(blocks, ["series_id"]).collect():
        trials.setdefault(r["series_id"], []).append((r["sse"], r["k"], r["alpha"], r["level"]))
    got = {r["series_id"]: r for r in found.collect()}
    assert set(got) == set(trials) == {"a", "b", "flat", "step"}
    for name, every in trials.items():
        sse, _, alpha, level = min(every)
        assert got[name]["alpha"] == alpha
        assert (got[name]["sse"], got[name]["level"]) == pytest.approx((sse, level), rel=1e-9, abs=1e-12)


def test_a_filter_on_fits_does_not_repeat_the_search(spark):
    fit = levels.level_fit(panel(spark, {"a": [1.0, 2.0, 4.0, 3.0]}), ["series_id"], with_resid=True)
    assert "lambda" not in plan(fit.filter("alpha > 0.5")) and "Exchange" not in plan(fit)


def test_windows_without_key_get_no_fit(spark):
    rows = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (None, 2, 4.0), ("a", 0, 1.0), ("a", 1, None), ("a", 2, 5.0)], "series_id string, t long, value double")
    assert [(r["series_id"], r["status"], r["level"], r["n_train"]) for r in levels.level_fit(rows, ["series_id"]).collect()] == [("a", "not_estimable", 5.0, 2)]


def test_transformed_windows_are_made_once(spark):
    rows = panel(spark, {"a": skewed(60, 1), "b": [v - 0.5 for v in skewed(60, 2)]})
    bt = evaluation.backtest(rows, 7, 5)
    out = evaluation.transformed_smoothing(bt)
    assert "Exchange" not in plan(out)
    assert bt.transformed is bt.transformed
    got = out.collect()
    assert {r["model"] for r in got} == {"EWMA + Box-Cox", "EWMA + Yeo-Johnson"}
    assert all(math.isfinite(r["yhat"]) for r in got)


def test_a_stage_is_as_large_as_its_rows(spark):
    staged = stage(spark.range(20_000).selectExpr("cast(id % 3 as string) as series_id", "id % 7 as t", "1.5D as value"), "even")
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 20_000 * 16


def test_errors_are_aligned_once(spark):
    rows = spark.createDataFrame([("a", "m", 0, h, float(h % 3), 1.0, 0.0, 2.0) for h in range(1, 13)], "series_id string, model string, fold int, h int, y double, yhat double, lo double, hi double")
    out = residuals.error_diagnostics(rows.repartition(3).filter("h > 0"))
    assert "Scan ExistingRDD" not in plan(out)
    assert out.collect()[0]["n_errors"] == 12


def test_list_quantile(spark):
    data = [("a", [1.0, 4.0, 9.0]), ("b", [2.0]), ("c", [])]
    df = spark.createDataFrame(data, "k string, x array<double>")
    from pyspark.sql import functions as F

    got = {r["k"]: (r["lo"], r["hi"]) for r in df.select("k", list_quantile(F.col("x"), 0.025).alias("lo"), list_quantile(F.col("x"), 0.975).alias("hi")).collect()}
    assert got["a"] == pytest.approx(np.quantile([1.0, 4.0, 9.0], [0.025, 0.975])) and got["b"] == (2.0, 2.0) and got["c"] == (None, None)


def test_equal_quantiles_are_searched_once(monkeypatch):
    import pandas as pd

    from seriesloom.functions import tails

    plain, calls = tails.t_quantile_value, []
    monkeypatch.setattr(tails, "t_quantile_value", lambda a, b: calls.append(a) or plain(a, b))
    got = tails.t_quantile.func(pd.Series([0.975] * 500), pd.Series([11.0] * 500))
    assert len(calls) == 1
    assert got.tolist() == pytest.approx([2.200985160082949] * 500)
