"""Anomaly flags make the residuals they judge once."""

import numpy as np

from seriesloom.kernels import loess
from seriesloom.operators import anomalies
from seriesloom.operators import fitted
from tests.data import AIRLINE, panel


def test_residuals_of_flags_are_made_once(spark):
    flags = anomalies.mad_flags(fitted.stl(panel(spark, {"air": [float(x) for x in AIRLINE]}), 12))
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    hits = {r["t"] for r in flags.filter("anomaly is not null").collect()}
    resid = loess.stl(np.array([float(x) for x in AIRLINE]), 12)[2]
    dev = np.abs(resid - np.median(resid))
    assert hits == set(np.flatnonzero(dev / (np.median(dev) * 1.4826) > 3.5).tolist())


def test_flags_without_key(spark):
    rows = spark.createDataFrame([(None, 0, 1.0), ("a", 0, 1.0), ("a", 1, None), ("a", 2, 9.0), ("a", 3, 1.0), ("a", 4, 1.0)],
                                 "series_id string, t long, resid double")
    got = {(r["series_id"], r["t"]): r["anomaly"] for r in anomalies.mad_flags(rows).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("a", 2): "positive_spike", ("a", 3): None, ("a", 4): None}
