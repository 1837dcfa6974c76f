"""Whitening against a dense eigensolver on exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from seriesloom.llm import queries, whitening


def exact(vectors):
    """n, exact sums, exact deviations, covariance (from exact centred products), centred matrix."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    lifted = np.array([[n * r[j] - sums[j] for j in range(d)] for r in x], object)
    deviation = [int((r**2).sum()) for r in lifted]
    centred = lifted.astype(np.float64) / n
    return n, deviation, centred.T @ centred / n, centred


def check(df, ids, vectors, components=32):
    n, deviation, cov, centred = exact(vectors)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-10 * max(e[0], 0)).sum()) if e[0] > 1e-9 else 0)
    got = df.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == n * k
    if not k:
        return
    assert (got["n"] == n).all() and got["component"].tolist() == sorted(set(range(1, k + 1))) * n
    order = np.argsort(ids, kind="stable")
    assert got["deviation"].iloc[::k].tolist() == [deviation[i] for i in order]
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert (got["residual"] < 1e-12).all()
    assert np.allclose(got["explained"].to_numpy().reshape(n, k), e[:k] / np.trace(cov), rtol=1e-11)
    want = centred[order] @ u[:, :k] / np.sqrt(e[:k])
    have = got["whitened"].to_numpy().reshape(n, k)
    gap = np.min(np.abs(np.diff(np.r_[np.inf, e[: k + 1]])).reshape(-1)) if k < len(e) else np.min(np.abs(np.diff(np.r_[np.inf, e])))
    if gap > 1e-6 * e[0]:
        sign = np.sign((want * have).sum(0))
        assert np.abs(want - have * sign).max() < 1e-6 * e[0] / gap


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(queries.op13_whitening(spark, sf_dir), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize(("d", "wanted"), [(1, 4), (3, 2), (64, 32), (200, 8), (400, 10)])
@pytest.mark.parametrize("spread", [1.0, 8.0])
def test_eigenpairs(d, wanted, spread):
    """Any symmetric positive operator, clusters and small values included; few products."""
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(np.exp(-spread * rng.random(d)))[::-1]
    e[: min(3, d)] = e[0] * (1 + 1e-7 * np.arange(min(3, d))[::-1])
    matrix = (basis * e) @ basis.T
    calls = []
    values, vectors, residuals = whitening.eigenpairs(lambda x: calls.append(x.shape[1]) or matrix @ x, d, wanted)
    k = min(d, wanted)
    assert np.allclose(values, np.sort(e)[::-1][:k], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert residuals.max() <= 1e-13 * np.sqrt(d) * e[0]
    assert len(calls) < 250


def test_odd(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(x)) for x in rng.normal(3, [5, 0.01, 1, 0, 2, 2])]) for i in range(300)]
    good += [(1000 + i, v) for i, v in good[:7]]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, []), (906, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, n int, body string").repartition(5)
    check(whitening.whiten(df), [i for i, _ in good], [v for _, v in good])
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    assert whitening.whiten(one).collect() == [] == whitening.whiten(one.limit(1)).collect() == whitening.whiten(one.filter("false")).collect()
    assert whitening.whiten(df.filter("vec_id in (900, 905)")).collect() == []


def test_far_from_zero(spark):
    """Large offsets: centring first keeps every digit; deviations beyond 64 bits are null."""
    rng = np.random.default_rng(6)
    rows = [(i, [1e9 + float(x) for x in rng.normal(0, [3, 2, 1])]) for i in range(200)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), range(200), [v for _, v in rows])
    wide = [(i, [1e12 * float(x)]) for i, x in enumerate(rng.normal(0, 1, 50))]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    want = exact([v for _, v in wide])[1]
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["vec_id"])] == [v if v < 1 << 63 else None for v in want]
    assert Fraction(sum(r["whitened"] ** 2 for r in got)).limit_denominator(10**6) == 50
