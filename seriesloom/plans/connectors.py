"""Queries on date texts, nested results and tables changed in place."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.operators import registry as K
from seriesloom.plans import panels as P
from seriesloom.plans.registry import cte, query
from seriesloom.sources import dates as D
from seriesloom.sources import nested as N
from seriesloom.sources import rewrites as W
from seriesloom.staging import stage_root

# order dates as each priority's office writes them; every 97th order has none, every 89th a wrong one
cte("date_texts", """
SELECT o_orderkey, o_orderpriority AS office, CASE WHEN o_orderkey % 97 = 0 THEN ' ' WHEN o_orderkey % 89 = 0 THEN 'week ' || o_orderkey
  WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderpriority LIKE '2%' THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN o_orderpriority LIKE '3%' THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderpriority LIKE '4%' THEN strftime(o_orderdate, '%b %d, %Y')
  ELSE strftime(date_trunc('month', o_orderdate), '%d/%m/%Y') END AS date_text, CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 THEN NULL
  WHEN left(o_orderpriority, 1) IN ('1', '2', '3', '4') THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS day FROM orders""")


def date_texts(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("office"), F.col("o_orderdate").alias("_d"))
    kind = F.substring("office", 1, 1)
    text = (F.when(F.col("o_orderkey") % 97 == 0, " ").when(F.col("o_orderkey") % 89 == 0, F.concat(F.lit("week "), F.col("o_orderkey").cast("string")))
            .when(kind == "1", F.date_format("_d", "dd/MM/yyyy")).when(kind == "2", F.date_format("_d", "MM/dd/yyyy")).when(kind == "3", F.date_format("_d", "dd.MM.yyyy"))
            .when(kind == "4", F.date_format("_d", "MMM dd, yyyy")).otherwise(F.date_format(F.trunc("_d", "MM"), "dd/MM/yyyy")))
    return o.select("o_orderkey", "office", text.alias("date_text"))


@query("date_forms", "SELECT o_orderkey, office, CAST(day AS VARCHAR) AS day FROM date_texts")
def date_forms(spark, d):
    """Dates of every order, read in the form that its office's texts voted for."""
    rows = date_texts(spark, d)
    out = D.with_dates(rows, "date_text", D.date_vote(rows, "date_text", ["office"]), ["office"])
    return out.select("o_orderkey", "office", F.to_date("ts").cast("string").alias("day"))


@query("date_votes", """
WITH v AS (SELECT office, count(*) FILTER (length(trim(date_text)) > 0) AS filled,
  count(try_strptime(date_text, '%m/%d/%Y')) AS mdy, count(try_strptime(date_text, '%d/%m/%Y')) AS dmy, count(try_strptime(date_text, '%d.%m.%Y')) AS dots,
  count(try_strptime(date_text, '%b %d, %Y')) AS named, count(DISTINCT split_part(date_text, '/', 1)) FILTER (try_strptime(date_text, '%m/%d/%Y') IS NOT NULL AND try_strptime(date_text, '%d/%m/%Y') IS NOT NULL) AS lefts,
  count(DISTINCT split_part(date_text, '/', 2)) FILTER (try_strptime(date_text, '%m/%d/%Y') IS NOT NULL AND try_strptime(date_text, '%d/%m/%Y') IS NOT NULL) AS rights FROM date_texts GROUP BY 1)
SELECT office, CASE WHEN greatest(mdy, dmy, dots, named) = 0 THEN NULL WHEN dots > greatest(mdy, dmy, named) THEN 'day.month.year' WHEN named > greatest(mdy, dmy) THEN 'name day, year'
  WHEN dmy > mdy OR (dmy = mdy AND lefts < rights) THEN 'day/month/year' ELSE 'month/day/year' END AS form,
  filled, greatest(mdy, dmy, dots, named) AS parsed, filled - greatest(mdy, dmy, dots, named) AS refused,
  mdy > 0 AND mdy = dmy AND lefts = rights AND mdy = greatest(mdy, dmy, dots, named) AS ambiguous FROM v""")
def date_votes(spark, d):
    return D.date_vote(date_texts(spark, d), "date_text", ["office"])


RESULT = "order_status string, total double, lines array<struct<number: int, quantity: double, shipped: string>>, summary struct<lines: bigint, last: string>"


@query("nested_results", """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_day, sum(l_linenumber * 1000 + l_quantity) AS digest FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'corrupt' WHEN o_orderkey % 51 = 0 THEN 'corrupt' WHEN k IS NULL THEN 'incomplete' ELSE 'ok' END AS state,
  CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 THEN NULL ELSE o_totalprice END AS total,
  CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 THEN NULL ELSE n END AS n_lines,
  CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 THEN NULL ELSE last_day END AS last_day,
  CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 THEN NULL ELSE round(digest, 2) END AS digest
FROM orders LEFT JOIN l ON k = o_orderkey""")
def nested_results(spark, d):
    """Orders with their lines written as nested results, some cut short or of a wrong type, and read back."""
    lines = P.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("number"), F.col("l_quantity").cast("double").alias("quantity"),
                                             F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")))).alias("lines"),
        F.struct(F.count(F.lit(1)).alias("lines"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("last")).alias("summary"))
    orders = P.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").cast("double").alias("total"))
    told = N.to_payload(orders.join(lines, "o_orderkey", "left"), "o_orderkey")
    text = F.col("payload")
    harmed = told.withColumn("payload", F.when(F.col("o_orderkey") % 50 == 0, F.expr("left(payload, length(payload) - 3)"))
                             .when(F.col("o_orderkey") % 51 == 0, F.regexp_replace(text, r'"total":[^,]*', '"total":"much"')).otherwise(text))
    out = N.from_payload(harmed, StructType.fromDDL(RESULT), required=["total", "summary.last"])
    digest = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["number"] * 1000 + x["quantity"])
    return out.select("o_orderkey", F.col("status").alias("state"), "total", F.col("summary.lines").alias("n_lines"), F.col("summary.last").alias("last_day"), F.round(digest, 2).alias("digest"))


def _folder(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("upsert_in_place", """
SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, md5(text) FROM benchmark""")
def upsert_in_place(spark, d):
    """Documents kept as a versioned table; benchmark items replace rows with their id."""
    path = _folder(spark, "documents")
    W.create(P.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), path, "id")
    W.upsert_parts(spark, path, P.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "id")
    return W.read_version(spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("retention_in_place", """
SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders
WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY)""")
def retention_in_place(spark, d):
    """Runs kept as a versioned table; finished ones older than a year go."""
    path = _folder(spark, "runs")
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("completed_at"))
    W.create(o, path, "run_id")
    now = F.lit(o.agg(F.max("completed_at")).first()[0])
    W.delete_rows(spark, path, "run_id", K.expired(now, 365, ("F", "O")))
    return W.read_version(spark, path).select("run_id", "status")
