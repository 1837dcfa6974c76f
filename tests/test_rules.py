import zipfile

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import text as X
from seriesloom.operators import report, retrieval, review, selection
from seriesloom.sources import ingest

EVID = "series_id string, model string, ord int, status string, mase double, wape double, rmse double, mae double, mape double"


def ev(spark, rows):
    return spark.createDataFrame([("s", m, i, st, r, r, r, r, r) for i, (m, st, r) in enumerate(rows)], EVID)


def pick(spark, rows, **kw):
    return selection.select_models(ev(spark, rows), **kw).collect()[0]


def test_negligible_difference_prefers_the_simpler(spark):
    r = pick(spark, [("SARIMA", "ok", 10.0), ("EWMA", "ok", 10.4)])
    assert r.selected_model == "EWMA" and r.tie_broken
    assert pick(spark, [("SARIMA", "ok", 10.0), ("EWMA", "ok", 10.5)]).selected_model == "SARIMA"


def test_baseline_is_kept_unless_clearly_beaten(spark):
    assert pick(spark, [("SARIMA", "ok", 10.0), ("Naive", "ok", 10.9)]).selected_model == "Naive"
    r = pick(spark, [("SARIMA", "ok", 10.0), ("Naive", "ok", 11.0)])
    assert r.selected_model == "SARIMA" and not r.baseline_retained


def test_exclusions_and_reasons(spark):
    gone = spark.createDataFrame([("s", "ARIMA")], "series_id string, model string")
    r = pick(spark, [("ARIMA", "ok", 1.0), ("SARIMA", "failed", 2.0), ("EWMA", "ok", 3.0), ("Drift", "ok", None)], excluded=gone)
    assert r.selected_model == "EWMA" and r.n_rankable == 1 and r.n_candidates == 4
    assert r.exclusion_reasons["ARIMA"] == selection.EXCLUDED_BY_CALLER
    assert "failed" in r.exclusion_reasons["SARIMA"] and r.exclusion_reasons["Drift"] == selection.NO_METRICS


def test_nothing_rankable(spark):
    r = pick(spark, [("ARIMA", "failed", None)])
    assert r.selected_model == "" and r.n_rankable == 0


def test_zero_metric_disables_the_ratio_rules(spark):
    assert pick(spark, [("SARIMA", "ok", 0.0), ("EWMA", "ok", 0.0001)]).selected_model == "SARIMA"


def test_simplicity_ranks(spark):
    names = ["SARIMA", "ARIMA + Box-Cox", "Holt-Winters", "EWMA", "Seasonal Naive", "Naive", "Constant", "Other"]
    df = spark.createDataFrame([(n,) for n in names], "m string").select("m", selection.simplicity(F.col("m")).alias("s"))
    assert {r.m: r.s for r in df.collect()} == dict(zip(names, [3, 2, 1, 0, 1, 0, -1, 4]))


@pytest.mark.parametrize("asked,text,want", [
    ("rmse", "", ("rmse", "user_selected")), ("auto", "Recommended decision loss: WAPE", ("wape", "llm_recommended")),
    ("auto", "nothing", ("mase", "llm_unavailable_fallback")), ("bogus", "x", ("mase", "invalid_setting_fallback"))])
def test_loss_resolution(spark, asked, text, want):
    r = spark.range(1).select(selection.resolve_decision_loss(F.lit(asked), F.lit(text)).alias("l")).collect()[0].l
    assert (r.loss, r.source) == want


TEXT = """Verdict: WARN
## Flags
- [CRITICAL] [agent: model_selection] Wrong season | Recommendation: Use SARIMA
- [WARNING] [agent: forecasting] none | Recommendation: none
- [INFO] [agent: statistical] Outliers remain | Recommendation: Clip them
## Endorsements
- Good folds
- none
## Summary
Two concerns.
"""


def test_review_text_parsing(spark):
    c = F.col("t")
    r = spark.createDataFrame([(TEXT,)], "t string").select(
        review.parse_verdict(c).alias("v"), review.parse_flags(c).alias("f"), review.parse_endorsements(c).alias("e"),
        review.parse_summary(c).alias("s")).collect()[0]
    assert r.v == "warn" and [f.agent for f in r.f] == ["model_selection", "statistical"]
    assert r.f[0].recommendation == "Use SARIMA" and r.e == ["Good folds"] and r.s == "Two concerns."


def test_flags_merge_by_topic(spark):
    flag = lambda issue: F.struct(F.lit("forecasting").alias("agent"), F.lit("warning").alias("severity"),
                                  F.lit(issue).alias("issue"), F.lit("r").alias("recommendation"))
    df = spark.range(1).select(review.merge_flags(
        F.array(flag("Model residuals are autocorrelated")), F.array(flag("Residual Ljung-Box fails"), flag("New issue"), flag("new ISSUE!"))).alias("m"))
    assert len(df.collect()[0].m) == 2


@pytest.mark.parametrize("args,want", [((0, 0, 0, 0, True, 0.0), "Good"), ((0, 0, 0, 0, True, 0.06), "Fair"),
                                       ((5, 2, 3, 3, False, 0.0), "Fair"), ((6, 0, 0, 0, True, 0.0), "Poor")])
def test_quality_ratings(spark, args, want):
    cols = [F.lit(a) for a in args]
    assert spark.range(1).select(report.quality_rating(*cols).alias("q")).collect()[0].q == want


def test_confidence_does_not_count_a_concern_twice(spark):
    schema = ("series_id string, mape double, final_rmse double, rmse double, is_stationary_adf boolean, is_white_noise boolean, "
              "outlier_ratio double, missing_values long, missing_periods long, has_breaks boolean, verdict string, "
              "flags array<struct<agent:string,severity:string,issue:string,recommendation:string>>")
    rows = [("same", 25.0, None, 10.0, True, False, 0.0, 0, 0, False, "warn", [("f", "warning", "Forecast MAPE is 25%", "")]),
            ("other", 25.0, 13.0, 10.0, False, True, 0.06, 1, 0, True, "fail", [("f", "warning", "Something else", "")]),
            ("clean", 3.0, None, 10.0, True, False, 0.0, 0, 0, False, None, [])]
    got = {r.series_id: r for r in report.confidence(spark.createDataFrame(rows, schema)).collect()}
    assert got["same"].score == 80 and got["other"].score == 100 - 20 - 10 - 10 - 15 - 5 - 5 - 5 - 20
    assert got["clean"].score == 100 and got["clean"].confidence == "High" and len(got["clean"].factors) == 2


def _python_chunks(text, size=400, step=320):
    out, start = [], 0
    while start < len(text):
        piece = text[start:start + size].strip()
        if piece:
            out.append(piece)
        if start + size >= len(text):
            break
        start += step
    return out


@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 700, 720, 721, 5000])
def test_chunks_cover_the_whole_text(spark, n):
    text = "".join(chr(97 + i % 26) if i % 7 else " " for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(X.chunks(F.col("t")).alias("c")).collect()[0].c
    assert got == _python_chunks(text)


def test_text_guards(spark):
    one = spark.range(1)
    run = lambda col: one.select(col.alias("x")).collect()[0].x
    assert run(X.selected_model(F.lit("**Selected model:** Holt‑Winters"), F.lit("ARIMA"))) == "Holt-Winters"
    assert run(X.selected_model(F.lit("no idea"), F.lit("EWMA"))) == "EWMA"
    assert run(X.invented_rmse(F.lit("RMSE: 12.5 and RMSE=9.0"), F.array(F.lit(12.501)))) == [9.0]
    assert run(X.invented_models(F.lit("Prophet, ARIMA and Theta."), F.array(F.lit("ARIMA")))) == ["Prophet", "Theta"]
    assert run(X.contradicts_choice(F.lit("SARIMA was selected"), F.lit("EWMA")))
    assert not run(X.contradicts_choice(F.lit("SARIMA was selected"), F.lit("SARIMA")))
    assert run(X.contradicts_rating(F.lit("Overall data quality is good."), F.lit("Poor")))
    assert not run(X.contradicts_rating(F.lit("Collection data quality is good."), F.lit("Poor")))
    assert run(X.unsequenced_break_options(F.lit("Use recency weighting."), F.lit(True)))
    assert not run(X.unsequenced_break_options(F.lit("First validate; only if confirmed use segments."), F.lit(True)))
    assert run(X.token_estimate(F.lit(""))) == 0 and run(X.token_estimate(F.lit("abc"))) == 1


def test_upsert_last_version_wins(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "1", 0)], "id string, text string, v int")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "1", 1)], "id string, text string, v int")
    assert {(r.id, r.text) for r in retrieval.upsert(old, new, "id", "v").collect()} == {("a", "1"), ("b", "3"), ("c", "1")}


def test_json_and_csv_readers(spark, tmp_path):
    (tmp_path / "rec.json").write_text('[{"when": "2024-01", "v": 1}, {"when": "2024-02", "v": 2}]')
    (tmp_path / "col.json").write_text('{"when": ["2024-01-01", "2024-01-02"], "v": [1.5, 2.5]}')
    (tmp_path / "bad.json").write_text('{"when": ["2024-01-01"], "v": [1.5, 2.5]}')
    (tmp_path / "one.json").write_text('{"when": "2024-01-05", "v": 3}')
    (tmp_path / "t.csv").write_text("Month,Passengers\n1949-01,112\n1949-02,118\nbad,1\n")
    assert ingest.finalise(ingest.read_json(spark, str(tmp_path / "rec.json")), "when", "v").count() == 2
    assert [r.v for r in ingest.read_json(spark, str(tmp_path / "col.json")).orderBy("v").collect()] == [1.5, 2.5]
    assert ingest.read_json(spark, str(tmp_path / "one.json")).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        ingest.read_json(spark, str(tmp_path / "bad.json")).collect()
    panel = ingest.finalise(ingest.read_csv(spark, str(tmp_path / "t.csv")), "Month", "Passengers").orderBy("ts").collect()
    assert [r.value for r in panel] == [112.0, 118.0]


def test_workbook_reader(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = (f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
             '<row r="2"><c r="A2" t="inlineStr"><is><t>2024-01-01</t></is></c><c r="B2"><v>5.5</v></c></row>'
             '<row r="3"><c r="B3"><v>6</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>date</t></si><si><t>value</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = ingest.xlsx_table(ingest.read_xlsx(spark, str(tmp_path)), ["date", "value"]).orderBy("row").collect()
    assert [(r.date, r.value) for r in rows] == [("2024-01-01", "5.5"), (None, "6")]
    flags = ingest.signature_flags(spark.read.format("binaryFile").load(str(tmp_path))).select("is_zip").collect()
    assert flags[0].is_zip
    gate = ingest.accept_files(ingest.manifest(spark, str(tmp_path))).collect()
    assert all(r.accepted for r in gate)


def test_text_folder(spark, tmp_path):
    (tmp_path / "arima.txt").write_text("line one\nline two")
    r = retrieval.text_files(spark, str(tmp_path)).collect()[0]
    assert (r.source, r.text) == ("arima", "line one\nline two")
