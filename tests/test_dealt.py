"""Large panels in tasks of a stated number of rows."""

from seriesloom.operators import trend
from seriesloom.plans import panels
from tests.data import panel


def test_large_panels_are_dealt_by_series(spark):
    rows = panel(spark, {f"s{i}": [float((i * 7 + t * t) % 11) for t in range(20)] for i in range(40)})
    assert panels.dealt(rows, 400) is rows
    many = panels.dealt(rows, 50)
    assert many.rdd.getNumPartitions() == 16
    where = many.rdd.mapPartitionsWithIndex(lambda i, part: [(r["series_id"], i) for r in part]).distinct().collect()
    assert len(where) == 40
    assert sorted(trend.kpss(many).collect()) == sorted(trend.kpss(rows).collect())
