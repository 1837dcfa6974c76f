"""Tables changed by rewriting only the parts with changed rows."""

import os

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import rewrites as W


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path / "data") for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = tmp_path / "table"
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("text"))
    W.create(rows, str(path), "id", parts=16)
    return path


def rows(spark, path, version=None):
    return {r["id"]: r["text"] for r in W.read_version(spark, str(path), version).collect()}


def test_upsert_touches_few_parts(spark, table):
    before = files(table)
    changes = spark.createDataFrame([(5, "new", 2), (5, "older", 1), (2000, "added", 1), (None, "nobody", 1)], "id long, text string, seq int")
    touched = W.upsert_parts(spark, str(table), changes, "id", "seq")
    assert 1 <= len(touched) <= 3
    want = {**{i: f"v{i}" for i in range(1000)}, 5: "new", 2000: "added", None: "nobody"}
    assert rows(spark, table) == want and W.read_version(spark, str(table)).count() == 1002
    # nothing that was there has changed, and the earlier version can still be read
    after = files(table)
    assert {f: after[f] for f in before} == before and len(after) - len(before) <= len(touched) * 2
    assert rows(spark, table, 1) == {i: f"v{i}" for i in range(1000)}
    kept = {r["part"]: r["folder"] for r in W.versions(spark, str(table)).filter("version = 1").collect()}
    now = W.current(spark, str(table))
    assert {p for p in now if now[p] != kept[p]} == set(touched) and len(now) == 16
    # a NULL key is replaced like others
    W.upsert_parts(spark, str(table), spark.createDataFrame([(None, "somebody")], "id long, text string"), "id")
    assert rows(spark, table) == {**want, None: "somebody"}


def test_delete(spark, table):
    before = files(table)
    touched = W.delete_rows(spark, str(table), "id", F.col("id") == 7)
    assert len(touched) == 1 and 7 not in rows(spark, table) and len(rows(spark, table)) == 999
    assert set(before) <= set(files(table))
    assert W.delete_rows(spark, str(table), "id", F.col("id") == 7) == [] and W.versions(spark, str(table)).agg(F.max("version")).first()[0] == 2
    # a condition that is NULL keeps the row; a table can become empty and be filled again
    assert W.delete_rows(spark, str(table), "id", F.col("text") == F.lit(None).cast("string")) == []
    W.delete_rows(spark, str(table), "id", F.lit(True))
    assert rows(spark, table) == {}
    W.upsert_parts(spark, str(table), spark.createDataFrame([(1, "again")], "id long, text string"), "id")
    assert rows(spark, table) == {1: "again"}


def test_second_writer_fails(spark, table):
    # another writer has taken the next version already
    W.versions(spark, str(table)).limit(0).coalesce(1).write.json(f"{table}/versions/2")
    with pytest.raises(Exception, match="already exists"):
        W.upsert_parts(spark, str(table), spark.createDataFrame([(1, "late")], "id long, text string"), "id")
    assert rows(spark, table)[1] == "v1"


def test_no_changes_and_empty(spark, table, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    assert W.upsert_parts(spark, str(table), none, "id") == []
    W.create(none, str(tmp_path / "empty"), "id", parts=4)
    assert W.read_version(spark, str(tmp_path / "empty")).columns == ["id", "text"] and rows(spark, tmp_path / "empty") == {}
