"""Panels built from the driver tables, in Spark and as shared CTEs.

Month sums are rounded to cents so both engines start from identical values.
The number of supplier series grows with the data; segments, statuses and event
types are few series over a growing scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.calendar import bucket, period_index, period_stamp
from seriesloom.operators.grid import reindex
from seriesloom.operators.impute import interpolate_position
from seriesloom.plans.registry import cte
from seriesloom.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums(df: DataFrame, key: Column, ts: Column, value: Column, freq: str) -> DataFrame:
    # rows meet by plain numbers; names and stamps are made once per group
    sums = df.groupBy(key.alias("_k"), period_index(ts, freq).alias("_p")).agg(F.round(F.sum(value), 2).alias("value"))
    return sums.select(F.col("_k").cast("string").alias("series_id"), period_stamp(F.col("_p"), freq).alias("ts"), "value")


def before_partial_month(df: DataFrame, ts: str) -> DataFrame:
    """``df`` without the rows of its last month, unless some row lies on that month's last day.

    The rows that are there decide: a month whose last day has a row is complete and stays.
    """
    last = df.agg(F.max(ts)).scalar()
    complete = F.to_date(last) == F.last_day(last)
    return df.filter((F.col(ts) < bucket(last, "MS")) | (complete & (F.col(ts) <= last)))


def segment_raw(spark, sf_dir, partial: bool = False) -> DataFrame:
    """Monthly order value per market segment; a last month that the orders don't reach the end of only with ``partial``."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = orders if partial else before_partial_month(orders, "o_orderdate")
    # customers grow with the orders: merged, neither sent through the driver nor held as month sums of each
    rows = orders.join(customer.hint("merge"), orders.o_custkey == customer.c_custkey)
    return _sums(rows, F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice"), "MS")


def supplier_raw(spark, sf_dir, partial: bool = False) -> DataFrame:
    """Monthly shipped quantity per supplier, with real gaps; a last month not shipped to its end only with ``partial``."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    li = li if partial else before_partial_month(li, "l_shipdate")
    return _sums(li, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_quantity"), "MS")


def status_raw(spark, sf_dir) -> DataFrame:
    """Monthly order value per order status."""
    o = table(spark, sf_dir, "orders")
    return _sums(o, F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_totalprice"), "MS")


def hour_raw(spark, sf_dir) -> DataFrame:
    """Hourly event value per type, with gaps."""
    e = table(spark, sf_dir, "events")
    return _sums(e, F.col("event_type"), F.col("ts"), F.col("value"), "h")


def day_raw(spark, sf_dir) -> DataFrame:
    """Daily event value per type."""
    e = table(spark, sf_dir, "events")
    return _sums(e, F.col("event_type"), F.col("ts"), F.col("value"), "D")


def user_day_raw(spark, sf_dir) -> DataFrame:
    """Daily event value per user: many short, intermittent series."""
    e = table(spark, sf_dir, "events")
    return _sums(e, F.col("user_id"), F.col("ts"), F.col("value"), "D")


def event_rows(spark, sf_dir) -> DataFrame:
    """Raw events as a panel: ``series_id, ts, value, seq``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series_id"), "ts", "value", F.col("event_id").alias("seq"))


def event_hours(spark, sf_dir) -> DataFrame:
    """Raw events with the stamp cut to the hour: many duplicate stamps."""
    e = event_rows(spark, sf_dir)
    return e.withColumn("ts", bucket(F.col("ts"), "h"))


#: Rows of a large panel that a task takes; smaller panels are left to the optimiser.
TASK_ROWS = 400_000


def dealt(panel: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """A staged panel of many tasks' rows with its series dealt over tasks of about ``task_rows`` rows.

    Exchanges are merged by their packed bytes, and a panel packs so well that a
    task's rows would grow with the table. A stated number of tasks is not merged,
    and windows and groups of a series then need no other exchange.
    """
    tasks = -(-panel.count() // task_rows)
    return panel if tasks < 4 else panel.repartition(tasks, "series_id")


def prepared(raw: DataFrame, freq: str, block: int | None = None) -> DataFrame:
    """Staged gridded and position-interpolated panel with ordinal ``t``."""
    return dealt(stage(interpolate_position(reindex(stage(raw, "raw"), freq), block=block), "panel"))


def gridded(raw: DataFrame, freq: str) -> DataFrame:
    """Staged gridded panel, gaps as NULL."""
    return gridded_rows(stage(raw, "raw"), freq)


def gridded_rows(raw: DataFrame, freq: str) -> DataFrame:
    """``gridded`` of a panel that is staged: the calendar and its rows each read it."""
    return dealt(stage(reindex(raw, freq), "grid"))


def segment_prep(spark, sf_dir) -> DataFrame:
    return prepared(segment_raw(spark, sf_dir), "MS")


def supplier_prep(spark, sf_dir) -> DataFrame:
    return prepared(supplier_raw(spark, sf_dir), "MS")


def day_prep(spark, sf_dir) -> DataFrame:
    return prepared(day_raw(spark, sf_dir), "D")


def hour_prep(spark, sf_dir, block: int | None = 4_096) -> DataFrame:
    return prepared(hour_raw(spark, sf_dir), "h", block)


cte("seg_raw", """
SELECT c_mktsegment AS series_id, date_trunc('month', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS value
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate)) FROM orders)
GROUP BY 1, 2""")
cte("sup_raw", """
SELECT CAST(l_suppkey AS VARCHAR) AS series_id, date_trunc('month', l_shipdate) AS ts, round(sum(l_quantity), 2) AS value
FROM lineitem WHERE l_shipdate < (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)
GROUP BY 1, 2""")
cte("sta_raw", """
SELECT o_orderstatus AS series_id, date_trunc('month', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS value
FROM orders GROUP BY 1, 2""")
cte("hr_raw", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value
FROM events GROUP BY 1, 2""")
cte("day_raw", """
SELECT event_type AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(sum(value), 2) AS value
FROM events GROUP BY 1, 2""")
cte("usr_raw", """
SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(sum(value), 2) AS value
FROM events GROUP BY 1, 2""")
cte("ev_rows", "SELECT event_type AS series_id, ts, value, event_id AS seq FROM events")
cte("ev_hours", "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, value, event_id AS seq FROM events")

for _p, _unit in (("seg", "month"), ("sup", "month"), ("sta", "month"), ("hr", "hour"), ("day", "day"), ("usr", "day")):
    cte(f"{_p}_grid", f"""
SELECT g.series_id, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS t, g.ts, r.value
FROM (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 {_unit})) AS ts
      FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM {_p}_raw GROUP BY 1)) g
LEFT JOIN {_p}_raw r ON r.series_id = g.series_id AND r.ts = g.ts""")
    cte(f"{_p}_near", f"""
SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER up AS t0,
  last_value(value IGNORE NULLS) OVER up AS v0,
  last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS ts0,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS t1,
  first_value(value IGNORE NULLS) OVER dn AS v1,
  first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER dn AS ts1
FROM {_p}_grid
WINDOW up AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       dn AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
    cte(f"{_p}_prep", f"""
SELECT series_id, t, ts, coalesce(value, v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)), v0, v1) AS value
FROM {_p}_near""")
