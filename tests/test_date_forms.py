"""Date texts read by the form their rows vote for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.sources.dates import FORMS, date_vote, with_dates
from seriesloom.sources.ingest import finalise

WRITTEN = {
    "iso": "%Y-%m-%d", "month/day/year": "%m/%d/%Y", "day/month/year": "%d/%m/%Y", "year/month/day": "%Y/%m/%d", "day.month.year": "%d.%m.%Y",
    "month-day-year": "%m-%d-%Y", "day-month-year": "%d-%m-%Y", "compact": "%Y%m%d", "day name year": "%d %b %Y", "name day, year": "%b %d, %Y",
}


def texts(spark, groups):
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "office string, i int, day string")


def test_every_form(spark):
    days = [dt.date(2021, 1, 20) + dt.timedelta(days=9 * i) for i in range(20)]
    df = texts(spark, {form: [d.strftime(f) for d in days] for form, f in WRITTEN.items()})
    votes = date_vote(df, "day", ["office"])
    got = {r["office"]: (r["form"], r["parsed"], r["refused"], r["ambiguous"]) for r in votes.collect()}
    assert got == {form: (form, 20, 0, False) for form in WRITTEN}
    for r in with_dates(df, "day", votes, ["office"]).collect():
        assert r["ts"] == dt.datetime.combine(days[r["i"]], dt.time()), r


def test_months_and_times(spark):
    df = texts(spark, {"name": ["Jan 2020", "Feb 2020"], "number": ["1/2020", "12/2020"], "year": ["2019", "2020"], "iso": ["2020-01", "2020-02"], "time": ["31/1/2020 9:30", "1/2/2020 10:00:05"]})
    votes = date_vote(df, "day", ["office"])
    assert {r["office"]: r["form"] for r in votes.collect()} == {"name": "name year", "number": "month/year", "year": "iso", "iso": "iso", "time": "day/month/year"}
    got = {(r["office"], r["i"]): r["ts"] for r in with_dates(df, "day", votes, ["office"]).collect()}
    assert got["time", 0] == dt.datetime(2020, 1, 31, 9, 30) and got["time", 1] == dt.datetime(2020, 2, 1, 10, 0, 5)
    assert got["name", 1] == got["iso", 1] == dt.datetime(2020, 2, 1) and got["number", 1] == dt.datetime(2020, 12, 1) and got["year", 0] == dt.datetime(2019, 1, 1)


def test_day_or_month(spark):
    monthly = [f"01/{m:02d}/2020" for m in range(1, 13)]
    american = [f"{m:02d}/01/2020" for m in range(1, 13)]
    df = texts(spark, {"monthly": monthly, "american": american, "either": ["03/04/2020", "04/03/2020"], "one": ["02/03/2020"], "told": ["02/03/2020", "13/03/2020"]})
    got = {r["office"]: (r["form"], r["ambiguous"]) for r in date_vote(df, "day", ["office"]).collect()}
    assert got == {"monthly": ("day/month/year", False), "american": ("month/day/year", False), "either": ("month/day/year", True), "one": ("month/day/year", True), "told": ("day/month/year", False)}


def test_refused_blank_and_empty(spark):
    df = texts(spark, {"some": ["1/31/2020", "soon", " ", None, "30/1/2020"], "none": ["soon", "later"], "blank": ["", None]})
    votes = date_vote(df, "day", ["office"])
    got = {r["office"]: (r["form"], r["filled"], r["parsed"], r["refused"]) for r in votes.collect()}
    assert got == {"some": ("month/day/year", 3, 1, 2), "none": (None, 2, 0, 2), "blank": (None, 0, 0, 0)}
    read = with_dates(df, "day", votes, ["office"])
    assert read.count() == 9 and read.filter("ts is not null").count() == 1
    with pytest.raises(Exception, match="are no dates"):
        with_dates(df, "day", votes, ["office"], strict=True).collect()
    good = df.filter("office = 'blank' or day = '1/31/2020'")
    assert with_dates(good, "day", date_vote(good, "day", ["office"]), ["office"], strict=True).count() == 3
    # no grouping: one vote; an empty table has one too
    assert date_vote(df.limit(0), "day").collect()[0]["form"] is None
    assert with_dates(df, "day", date_vote(df, "day")).filter("ts is not null").count() == 1


def test_null_group(spark):
    df = spark.createDataFrame([(None, "5.6.2020"), (None, "25.6.2020"), ("a", "2020-06-05")], "office string, day string")
    got = with_dates(df, "day", date_vote(df, "day", ["office"]), ["office"]).orderBy("ts").collect()
    assert [r["ts"].day for r in got] == [5, 5, 25]


def test_upload_with_other_dates(spark):
    df = spark.createDataFrame([("25.01.2020", 1.0), ("26.01.2020", 2.0), ("unknown", 3.0)], "day string, sales double")
    got = finalise(df, "day", "sales", forms=True).orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in got] == [(dt.datetime(2020, 1, 25), 1.0), (dt.datetime(2020, 1, 26), 2.0)]
    # a column is only found by itself where over four fifths of its texts are dates
    with pytest.raises(ValueError):
        finalise(df, forms=True)
    more = spark.createDataFrame([(f"{i}.02.2020", float(i)) for i in range(1, 28)] + [("unknown", 3.0)], "at string, sales double")
    assert finalise(more, forms=True).count() == 27
    with pytest.raises(Exception, match="are no dates"):
        finalise(df, "day", "sales", forms=True, strict=True).collect()


def test_vote_reads_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    plan = date_vote(df, "day", ["o_orderpriority"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and len(FORMS) == 12
