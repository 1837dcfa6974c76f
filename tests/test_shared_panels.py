"""What several readers of a panel share is made once."""

from pyspark.sql import functions as F

from seriesloom.operators import anomalies as A
from seriesloom.operators import decompose as DE
from seriesloom.operators import dependence as D
from seriesloom.plans import panels as P
from seriesloom.plans import rules


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_report_reads_the_line_items_once(spark, sf_dir, monkeypatch):
    made, raw = [], P.supplier_raw

    def counted(*args, **kwargs):
        made.append(1)
        return raw(*args, **kwargs)

    monkeypatch.setattr(P, "supplier_raw", counted)
    rules.narratives(spark, sf_dir)
    assert len(made) == 1


def _panel(spark):
    rows = [(s, t, float((t * 7 + k) % 5 + 0.3 * t + (t % 4))) for k, s in enumerate(("a", "b", None)) for t in range(24 + k)]
    return spark.createDataFrame(rows, "series_id string, t long, value double").withColumn("ts", F.lit(0))


def _rounded(df, *names):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def test_decomposition_by_windows_is_that_by_blocks(spark):
    panel, names = _panel(spark), ("series_id", "t", "n", "trend", "seasonal", "resid")
    plain = DE.classical_decompose(panel, 4)
    assert "Join" not in _plan(plain)
    rows = _rounded(plain, *names)
    assert len(rows) == 49 and rows == _rounded(DE.classical_decompose(panel, 4, block=8), *names)


def test_lags_and_cusum_by_windows_are_those_by_blocks(spark):
    panel = _panel(spark)
    assert "Join" not in _plan(D.lag_products(panel, 2)) and "Join" not in _plan(A.cusum(panel))
    flat = lambda df: df.select("series_id", "n", "c0", F.element_at("c", 2).alias("c2"))
    rows = _rounded(flat(D.lag_products(panel, 2)), "series_id", "n", "c0", "c2")
    assert len(rows) == 2 and rows == _rounded(flat(D.lag_products(panel, 2, block=8)), "series_id", "n", "c0", "c2")
    assert _rounded(A.cusum(panel), "series_id", "t", "cusum") == _rounded(A.cusum(panel, block=8), "series_id", "t", "cusum")
