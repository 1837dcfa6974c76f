"""Smoothing levels by blocks against the plain recursion."""

import numpy as np
import pytest

from seriesloom.operators import levels
from tests.data import AIRLINE, panel


def plain(y):
    best = None
    for a in levels.ALPHA_GRID:
        level, resid = y[0], []
        for v in y[1:]:
            resid.append(v - level)
            level = a * v + (1 - a) * level
        sse = float(np.sum(np.square(resid)))
        if best is None or sse < best[0]:
            best = (sse, a, level, resid)
    return best


@pytest.mark.parametrize("block", [4, 128])
def test_level_fit(spark, block):
    gen = np.random.default_rng(1)
    given = {"air": [float(x) for x in AIRLINE], "noise": gen.normal(size=57).tolist(), "flat": [2.0] * 9, "two": [1.0, 5.0], "one": [4.0],
             "gap": [None, None, 3.0, None, 4.0, 8.0, None, 1.0, *gen.normal(size=20), None]}
    found = {r["series_id"]: r for r in levels.level_fit(panel(spark, given), ["series_id"], with_resid=True, block=block).collect()}
    assert set(found) == set(given)
    for name, values in given.items():
        y, r = [v for v in values if v is not None], found[name]
        assert r["n_train"] == len(y)
        if len(y) < 3:
            assert (r["status"], r["level"], r["alpha"], r["resid"]) == ("not_estimable", y[-1], None, [])
            continue
        sse, a, level, resid = plain(y)
        assert r["status"] == "ok" and r["alpha"] == a
        assert r["sse"] == pytest.approx(sse, rel=1e-9, abs=1e-9) and r["level"] == pytest.approx(level, rel=1e-9)
        assert r["resid"] == pytest.approx(resid, rel=1e-7, abs=1e-8)
        assert [r["band_lo"], r["band_hi"]] == pytest.approx(np.quantile(resid, [0.025, 0.975]), rel=1e-7, abs=1e-8)


@pytest.mark.parametrize("fan", [2, 3, 512])
def test_affine_carry(spark, fan):
    gen = np.random.default_rng(fan)
    maps = [(i, float(a), float(b)) for i, (a, b) in enumerate(gen.normal(size=(40, 2))) if i % 7 != 3]
    rows = [("x", *m) for m in maps] + [("y", 5, 2.0, 1.0)]
    got = {(r["series_id"], r["_blk"]): r["x"] for r in levels.affine_carry(spark.createDataFrame(rows, "series_id string, _blk long, a double, b double"), ["series_id"], fan).collect()}
    level = 0.0
    for i, a, b in maps:
        assert got["x", i] == pytest.approx(level, rel=1e-12)
        level = a * level + b
    assert got["y", 5] == 0.0 and len(got) == len(rows)


def test_no_python_in_the_plan(spark):
    text = levels.level_fit(panel(spark, {"a": [1.0, 2.0, 4.0]}), ["series_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
