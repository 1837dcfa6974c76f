"""Nearest rows against brute force, for many queries and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.nearest import _best, nearest_rows
from seriesloom.operators.retrieval import cosine_top_k


def brute(corpus, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for key, w in corpus:
            if v is None or w is None or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), key))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("block, piece", [(4096, 65_536), (16, 64), (7, 1)])
def test_blocks_and_pieces(spark, block, piece):
    rng = np.random.default_rng(4)
    corpus = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    c, q = spark.createDataFrame(corpus, "vec_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = {}
    for r in nearest_rows(c, q, 3, block=block, piece=piece).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["similarity"], 9), r["vec_id"]))
    assert got == brute(corpus, queries, 3)


def test_odd_vectors_ties_and_empty(spark):
    one = [1.0, 0.0]
    corpus = [(i, one) for i in range(20, 0, -1)] + [(30, None), (31, [0.0, 0.0]), (32, [float("nan"), 1.0]), (33, [1.0]), (34, []), (35, [None, 1.0])]
    queries = [(1, one), (2, None), (3, [0.0, 0.0]), (4, [2.0]), (5, [1.0, 1.0, 1.0]), (6, []), (1, one)]
    c, q = spark.createDataFrame(corpus, "vec_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in nearest_rows(c, q, 3, piece=4).collect()}
    none = {(i, rank): (rank, None) for i in (2, 3, 5, 6) for rank in (1, 2, 3)}
    assert got == {(1, 1): (1, 1.0), (1, 2): (2, 1.0), (1, 3): (3, 1.0), (4, 1): (33, 1.0), (4, 2): (1, None), (4, 3): (2, None), **none}
    assert nearest_rows(c.limit(0), q).count() == 0 and nearest_rows(c, q.limit(0)).count() == 0


def test_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        score = rng.integers(0, 4, (5, rng.integers(1, 12))).astype(float)
        place = np.argsort(rng.random(score.shape), 1)
        best, at = _best(score, place, 3)
        for r in range(5):
            want = sorted(zip(-score[r], place[r]))[:3]
            assert sorted(zip(-best[r], at[r])) == want


def test_any_number_of_queries(spark, sf_dir):
    """More queries than fit a block, each found again by itself."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    times = 12_000 // e.count() + 1
    q = e.select(F.explode(F.sequence(F.lit(1), F.lit(times))).alias("i"), "*").select(F.concat_ws("_", "vec_id", "i").alias("query_id"), F.col("embedding").alias("vector"))
    got = cosine_top_k(e, q, 1)
    assert got.count() == e.count() * times and got.filter("similarity < 0.999999").count() == 0
