"""Nested results written as JSON text and read back."""

import pytest
from pyspark.sql.types import StructType

from seriesloom.sources.nested import from_payload, to_payload

DDL = "name string, score double, parts array<struct<n: int, label: string>>, extra struct<at: timestamp_ntz, tags: map<string, int>>"


def test_round_trip(spark):
    schema = StructType.fromDDL("id long, " + DDL)
    import datetime as dt

    rows = [(1, 'a "quoted" é', 0.1, [(1, "x"), (2, None)], (dt.datetime(2020, 1, 1, 2, 3, 4), {"k": 1})), (2, None, None, [], (None, {})), (3, "", -1e300, None, None)]
    df = spark.createDataFrame(rows, schema)
    back = from_payload(to_payload(df, "id"), StructType.fromDDL(DDL))
    assert [r["status"] for r in back.collect()] == ["ok"] * 3
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect(), key=lambda r: r["id"])


def test_damage(spark):
    texts = ['{"name":"a","score":1.5}', '{"name":"a","score":1.5', '{"name":"a","score":"much"}', "[1,2]", "null", "7", "", None, '{"score":1}', '{"name":null,"score":2}',
             '{"name":"b","score":2,"unknown":1}', '{"name":"c","parts":[{"n":"one"}]}', "{}", '{"name":"d","extra":{"tags":{"k":3}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    got = {r["id"]: r for r in from_payload(df, StructType.fromDDL(DDL), required=["name"]).collect()}
    assert [got[i]["status"] for i in range(len(texts))] == ["ok", "corrupt", "corrupt", "corrupt", "corrupt", "corrupt", "missing", "missing", "incomplete", "incomplete", "ok", "corrupt", "incomplete", "ok"]
    assert got[2]["problem"] == texts[2] and got[2]["name"] is None and got[8]["problem"] == "name" and got[0]["problem"] is None
    assert got[13]["extra"]["tags"] == {"k": 3}
    nested = {r["id"]: r["status"] for r in from_payload(df, StructType.fromDDL(DDL), required=["extra.tags"]).collect()}
    assert nested[13] == "ok" and nested[0] == "incomplete"


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([], "id long, payload string, score double")
    with pytest.raises(ValueError, match="score"):
        from_payload(df, StructType.fromDDL(DDL))
    assert from_payload(df.drop("score"), StructType.fromDDL(DDL)).count() == 0
