"""The segment panel of orders whose customers grow with them."""

from pyspark.sql import functions as F

from seriesloom.plans import panels as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, path):
    day = "timestamp_ntz'2000-01-01' + make_dt_interval(cast(30 * i as int))"
    spark.sql(f"SELECT i % 7 AS o_custkey, {day} AS o_orderdate, cast(i AS double) AS o_totalprice FROM (SELECT explode(sequence(0L, 40L)) AS i)").write.parquet(f"{path}/orders.parquet")
    spark.sql("SELECT i AS c_custkey, IF(i < 3, 'A', 'B') AS c_mktsegment FROM (SELECT explode(sequence(0L, 5L)) AS i)").write.parquet(f"{path}/customer.parquet")


def test_customers_are_not_sent_through_the_driver(spark, tmp_path):
    _tables(spark, tmp_path)
    raw = P.segment_raw(spark, str(tmp_path), partial=True)
    assert "Broadcast" not in _plan(raw)
    # no customer of key 6; every other order counts once
    got = {r["series_id"]: r["v"] for r in raw.groupBy("series_id").agg(F.sum("value").alias("v")).collect()}
    assert got == {"A": sum(i for i in range(41) if i % 7 < 3), "B": sum(i for i in range(41) if 3 <= i % 7 < 6)}
