"""The last month of the monthly panels."""

import datetime as dt

import pytest

from seriesloom.plans import panels


def tables(spark, folder, last):
    """Orders and shipments on the 15th of three months and on ``last``."""
    days = [dt.datetime(2001, m, 15) for m in (5, 6, 7)] + [last]
    spark.createDataFrame([(1, d, 10.0) for d in days], "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, d, 10.0) for d in days], "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("panel", [panels.segment_raw, panels.supplier_raw])
@pytest.mark.parametrize("last, months", [(dt.datetime(2001, 8, 31), 4), (dt.datetime(2001, 8, 31, 18), 4), (dt.datetime(2001, 8, 30), 3), (dt.datetime(2001, 7, 31), 3)])
def test_last_month(spark, tmp_path, panel, last, months):
    """A complete last month stays; a partial one goes unless asked for."""
    tables(spark, tmp_path, last)
    assert {r["ts"].month for r in panel(spark, str(tmp_path)).collect()} == set(range(5, 5 + months))
    assert {r["ts"].month for r in panel(spark, str(tmp_path), partial=True).collect()} == set(range(5, last.month + 1))
