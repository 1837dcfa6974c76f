"""Text, retrieval, registry and ingest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom.functions import text as X
from seriesloom.operators import metrics as M
from seriesloom.operators import panel as PN
from seriesloom.operators import registry as K
from seriesloom.operators import retrieval as T
from seriesloom.operators import review as R
from seriesloom.operators import selection as S
from seriesloom.plans import panels as P
from seriesloom.plans.backtesting import supplier_backtest
from seriesloom.plans.registry import cte, query
from seriesloom.plans.rules import reviewed
from seriesloom.sources import ingest as I
from seriesloom.staging import stage_root

cte("doc_chunks", r"""
SELECT CAST(doc_id AS VARCHAR) AS source, i AS chunk_index, regexp_replace(substring(text, i * 320 + 1, 400), '^\s+|\s+$', '', 'g') AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 400) / 320.0) AS BIGINT)) + 1)) AS i FROM documents WHERE length(text) > 0)""")


@query("chunk_documents", """
SELECT source || '__' || k AS chunk_id, source, length(text) AS n_chars, md5(text) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_index) - 1 AS k FROM doc_chunks WHERE length(text) > 0)""")
def chunk_documents(spark, d):
    t = T.chunk_table(P.table(spark, d, "documents"), F.col("doc_id"), F.col("text"))
    return t.select("chunk_id", "source", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("upsert_documents", """
SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, md5(text) FROM benchmark""")
def upsert_documents(spark, d):
    dig = F.md5(F.col("text").cast("binary")).alias("digest")
    old = P.table(spark, d, "documents").select(F.col("doc_id").alias("id"), dig)
    return T.upsert(old, P.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), dig), "id")


@query("cosine_topk", """
WITH q AS (SELECT label AS query_id, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM q GROUP BY 1),
e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT q.query_id, e.vec_id, sum(x * v) / (any_value(en.n) * any_value(qn.n)) AS s FROM e JOIN q USING (i) JOIN en USING (vec_id) JOIN qn USING (query_id) GROUP BY 1, 2)
SELECT query_id, vec_id, round(s, 6) AS similarity, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rk FROM s) WHERE rk <= 3""")
def cosine_topk(spark, d):
    e = P.table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    centroids = long.groupBy(F.col("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_v")).select(
        "query_id", F.transform("_v", lambda s: s["v"]).alias("vector"))
    return T.cosine_top_k(e, centroids).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("cosine_neighbours", """
WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x) / (any_value(m.n) * any_value(n.n)) AS s FROM e a JOIN e b USING (i) JOIN n m ON m.vec_id = a.vec_id JOIN n ON n.vec_id = b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, vec_id, round(s, 6) AS similarity, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")
def cosine_neighbours(spark, d):
    """Five nearest rows of every twentieth vector among all vectors."""
    e = P.table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return T.cosine_top_k(e, asked, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("filtered_scan", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def filtered_scan(spark, d):
    return T.metadata_filter(P.table(spark, d, "documents"), {"lang": "en", "source": "src1"}).select("doc_id", "n_chars")


@query("top_bottom_rows", """
WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS lo FROM events)
SELECT event_type, event_id, value, hi AS rank, 'top' AS "end" FROM r WHERE hi <= 5 UNION ALL SELECT event_type, event_id, value, lo, 'bottom' FROM r WHERE lo <= 5""")
def top_bottom_rows(spark, d):
    return T.top_and_bottom(P.table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "value", ["event_id"])


@query("token_rollup", """
SELECT agent, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, bool_or(true) AS estimated
FROM (SELECT role AS agent, CASE WHEN role = 'user' THEN tok ELSE 0 END AS i, CASE WHEN role = 'user' THEN 0 ELSE tok END AS o
  FROM (SELECT role, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END AS tok FROM conversations)) GROUP BY ROLLUP (agent)""")
def token_rollup(spark, d):
    tok = X.token_estimate(F.col("text"))
    given, made = F.when(F.col("role") == "user", tok).otherwise(0), F.when(F.col("role") == "user", 0).otherwise(tok)
    rows = P.table(spark, d, "conversations").select(F.col("role").alias("agent"), given.alias("input_tokens"), made.alias("output_tokens"),
                                                     (given + made).alias("total_tokens"), F.lit(True).alias("estimated"))
    return K.usage_rollup(rows)


@query("usage_reconcile", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) - length(text) // 3 ELSE length(text) // 2 END AS input_tokens, length(text) // 3 AS output_tokens,
  CASE WHEN role = 'user' THEN length(text) ELSE length(text) // 2 + length(text) // 3 END AS total_tokens FROM conversations WHERE length(text) >= 3""")
def usage_reconcile(spark, d):
    n = F.length("text")
    user = F.col("role") == "user"
    third = F.floor(n / 3)
    fixed = X.reconcile_usage(F.when(user, 0).otherwise(F.floor(n / 2)), third, F.when(user, n).otherwise(0))
    return P.table(spark, d, "conversations").filter(n >= 3).select("conv_id", "turn", fixed.alias("u")).select("conv_id", "turn", "u.*")


_CLAIMS = """
WITH n AS (SELECT *, lead(rmse) OVER (PARTITION BY series_id ORDER BY ord) AS other FROM sup_pool)
"""


def claims(spark, d):
    """Sentences that cite each candidate's RMSE, next to the evidence of the other candidates."""
    bt = supplier_backtest(spark, d)
    pooled = M.forecast_metrics(bt.errors(bt.baselines()), ["series_id", "model"])
    told = pooled.select("series_id", "model", "rmse", F.format_string("Selected model: %s. It reached RMSE: %.4f over ARIMA", "model", "rmse").alias("text"))
    known = pooled.filter(F.col("model") != "Drift").groupBy("series_id").agg(F.collect_list("rmse").alias("evidence"), F.collect_list("model").alias("valid"))
    return told.join(known, "series_id")


@query("metric_claims_audit", """
SELECT a.series_id, a.model, count(*) FILTER (b.model <> 'Drift' AND abs(round(a.rmse, 4) - round(b.rmse, 4)) <= greatest(1e-3 * greatest(round(a.rmse, 4), round(b.rmse, 4)), 5e-3)) = 0 AS invented_rmse,
  1 AS invented_models, split_part(lower(a.model), ' ', 1) NOT IN ('naive') AS contradictory
FROM sup_pool a JOIN sup_pool b USING (series_id) GROUP BY a.series_id, a.model, a.rmse""")
def metric_claims_audit(spark, d):
    c = claims(spark, d)
    return c.select("series_id", "model", (F.size(X.invented_rmse(F.col("text"), F.col("evidence"))) > 0).alias("invented_rmse"),
                    F.size(X.invented_models(F.col("text"), F.col("valid"))).alias("invented_models"),
                    (F.size(X.contradictory_selection(F.col("text"), F.col("valid"))) > 0).alias("contradictory"))


@query("parsed_reviews", """
SELECT e.series_id, has_crit, CAST(count(f) AS BIGINT) AS n_flags, count(*) FILTER (f LIKE '%:critical:%') AS n_critical
FROM rule_vd e JOIN rule_fl USING (series_id) GROUP BY 1, 2 HAVING count(f) > 0""")
def parsed_reviews(spark, d):
    """Render the flags as a review text, then parse that text back."""
    rows = reviewed(spark, d).filter(F.size("flags") > 0)
    lines = F.transform("flags", lambda f: F.concat(F.lit("- ["), F.upper(f["severity"]), F.lit("] [agent: "), f["agent"], F.lit("] "),
                                                    f["issue"], F.lit(" | Recommendation: "), f["recommendation"]))
    critical = F.exists("flags", lambda f: f["severity"] == "critical")
    text = F.concat(F.lit("Verdict: "), F.when(critical, "FAIL").otherwise("PASS"), F.lit("\n## Flags\n"), F.array_join(lines, "\n"))
    parsed = rows.select("series_id", text.alias("text")).select(
        "series_id", (R.parse_verdict(F.col("text")) == "fail").alias("has_crit"), R.parse_flags(F.col("text")).alias("_f"))
    return parsed.select("series_id", "has_crit", F.size("_f").cast("long").alias("n_flags"),
                         F.size(F.filter("_f", lambda f: f["severity"] == "critical")).cast("long").alias("n_critical"))


@query("narrative_guards", r"""
SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])(drift|naive|constant|arima|sarima|ewma|holt-winters|mean forecast)([^a-z]|$)') AS names_model,
  regexp_matches(lower(text), '(downward|upward) (trajectory|trend)|trends (downward|upward)') AS directional, contains(lower(text), 'calibrat') AS calibration FROM documents""")
def narrative_guards(spark, d):
    docs = P.table(spark, d, "documents")
    t = F.col("text")
    return docs.select("doc_id", (F.size(X.other_models_mentioned(t, F.lit(""))) > 0).alias("names_model"),
                       X.contradicts_pattern(t, F.lit("Seasonal / variable")).alias("directional"),
                       X.claims_calibration(t, F.lit(None).cast("double")).alias("calibration"))


@query("narrative_audit")
def narrative_audit(spark, d):
    """Every guard over sentences written from each supplier's own evidence."""
    rows = reviewed(spark, d)
    t = F.format_string("Selected model: %s. ARIMA was selected. The path trends upward. Data quality is good. The %d outliers are negligible. "
                        "Consider recency weighting. There was no out-of-sample validation. Intervals are calibrated.", "model", "outlier_count")
    rows = rows.withColumn("_t", t)
    c = F.col
    return rows.select(
        "series_id", X.selected_model(c("_t"), F.lit("none")).alias("parsed_model"),
        F.array_join(X.other_models_mentioned(c("_t"), c("model")), ",").alias("other_models"),
        X.contradicts_choice(c("_t"), c("model")).alias("contradicts_choice"),
        X.contradicts_pattern(c("_t"), F.lit("Seasonal / variable")).alias("contradicts_pattern"),
        X.dismisses_anomalies(c("_t"), c("outlier_count")).alias("dismisses_anomalies"),
        X.contradicts_rating(c("_t"), F.when(c("missing_periods") > 0, "Fair").otherwise("Good")).alias("contradicts_rating"),
        X.unsequenced_break_options(c("_t"), c("has_breaks")).alias("unsequenced_breaks"),
        X.denies_validation(c("_t"), c("final_rmse").isNotNull()).alias("denies_validation"),
        X.claims_calibration(c("_t"), F.lit(None).cast("double")).alias("claims_calibration"))


@query("decision_loss", r"""
SELECT conv_id, turn, CASE WHEN m <> '' THEN m ELSE 'mase' END AS loss, CASE WHEN m <> '' THEN 'llm_recommended' ELSE 'llm_unavailable_fallback' END AS source
FROM (SELECT conv_id, turn, lower(regexp_extract(text, '(?i)recommended\s+decision\s+loss\s*:\s*(mase|wape|rmse|mae)\b', 1)) AS m FROM conversations)""")
def decision_loss(spark, d):
    c = P.table(spark, d, "conversations")
    return c.select("conv_id", "turn", S.resolve_decision_loss(F.lit("auto"), F.col("text")).alias("_l")).select("conv_id", "turn", "_l.*")


@query("run_retention", """
SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders
WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY)""")
def run_retention(spark, d):
    o = P.table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("completed_at"))
    now = o.agg(F.max("o_orderdate")).scalar()
    return K.keep_recent_runs(runs, now, 365, ("F", "O")).select("run_id", "status")


@query("runs_by_status", "SELECT o_custkey AS user_id, o_orderstatus AS status, count(*) AS runs FROM orders GROUP BY 1, 2")
def runs_by_status(spark, d):
    return K.runs_by_status(P.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status")))


@query("recent_runs", "SELECT o_orderkey AS run_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def recent_runs(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return K.recent_runs(o)


@query("reports_per_owner", "SELECT c_custkey AS owner_id, c_name AS name, count(*) AS reports FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def reports_per_owner(spark, d):
    owners = P.table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("name"))
    return K.reports_per_owner(owners, P.table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id")))


@query("report_limits", "SELECT o_custkey AS owner_id, count(*) AS reports, count(*) >= 10 AS at_limit FROM orders GROUP BY 1")
def report_limits(spark, d):
    return K.over_limit(P.table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id")), 10)


@query("owner_scan", "SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) = '7'")
def owner_scan(spark, d):
    rows = P.table(spark, d, "orders").withColumn("owner_id", F.col("o_custkey").cast("string"))
    return PN.visible_rows(rows, "7").select("o_orderkey")


@query("short_series_stop", """
SELECT series_id, ts, value FROM usr_raw WHERE series_id IN (SELECT series_id FROM usr_raw GROUP BY 1 HAVING count(value) >= 20)""")
def short_series_stop(spark, d):
    return PN.stop_short_series(P.user_day_raw(spark, d), F.lit("stop"))


@query("pruned_scan", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 100")
def pruned_scan(spark, d):
    e = I.load_columns(spark, f"{d}/events.parquet", "event_id", "ts", "value")
    return e.filter((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("value") > 100))


def _scratch(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_ingest", "SELECT o_orderstatus AS series_id, o_orderdate AS ts, CAST(o_totalprice AS DOUBLE) AS value FROM orders")
def csv_ingest(spark, d):
    """Write the orders as CSV, then ingest with detected columns."""
    path = _scratch(spark, "orders-csv")
    P.table(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    df = I.read_csv(spark, path)
    return I.finalise(df, series=F.col("o_orderstatus")).select("series_id", "ts", "value")


@query("json_column_ingest", "SELECT event_type AS series_id, ts, value FROM events")
def json_column_ingest(spark, d):
    """Column-oriented documents of a bounded number of events, turned back into rows."""
    path = _scratch(spark, "events-json")
    # ten thousand consecutive ids at most share a document, whatever the skew
    batch = F.floor(F.col("event_id") / 10_000)
    docs = P.table(spark, d, "events").groupBy("event_type", batch.alias("batch")).agg(
        F.collect_list("ts").alias("ts"), F.collect_list("value").alias("value"),
        F.collect_list("event_type").alias("series_id"))
    docs.select("series_id", "ts", "value").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    df = I.columns_to_rows(spark.read.json(path))
    return I.finalise(df, "ts", "value", F.col("series_id")).select("series_id", "ts", "value")


@query("column_detection", "SELECT 'o_orderdate' AS date_column, 'o_orderkey' AS value_column, count(*) AS n FROM orders")
def column_detection(spark, d):
    o = P.table(spark, d, "orders")
    date = I.detect_date_column(o)
    return o.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(date).alias("date_column"), F.lit(I.detect_value_column(o, date)).alias("value_column"), "n")


@query("panel_store", "SELECT series_id, ts, value FROM sup_raw")
def panel_store(spark, d):
    path = _scratch(spark, "panel-store")
    I.store_panel(P.supplier_raw(spark, d), path)
    return I.load_columns(spark, path, "series_id", "ts", "value")


@query("json_sink", """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload FROM orders""")
def json_sink(spark, d):
    return I.as_json_rows(P.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("file_gate")
def file_gate(spark, d):
    files = I.accept_files(I.manifest(spark, d))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "extension", "accepted", "reason")
