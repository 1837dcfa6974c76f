"""Whitening of embeddings by Jacobi-Davidson.

The covariance is never formed. Vectors are written once as compact integer
blocks; every step needs products of the covariance with a few columns, which
one Spark job over the blocks gives for all columns together (centred before
multiplying). On the driver are matrices of dimension x columns only.

* Rayleigh-Ritz in the search space gives the current pairs.
* Each pair's correction equation, projected off the locked and the current
  vectors, is solved by a few steps of MINRES, all pairs in step, a job a step.
* The corrections widen the search space. Pairs whose residual has reached
  double precision are locked and leave it; when it is full it starts again
  from its best vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.arrays import released
from seriesloom.llm.tables import bounded_batches
from seriesloom.staging import stage

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
BLOCK = 4096
# entries beyond this have no exact place among the long values
LARGEST = 2.0**50
INNER_STEPS = 4
ROUNDS = 500
TOLERANCE = 1e-14
# directions with less of the largest variance have none
LEAST_VARIANCE = 1e-10
_WAYS = 8


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows whose vector has entries, all of them finite (and under 2**44), as doubles.

    Vectors of another length than the most frequent one (of equally frequent
    ones, the greater) go as well.
    """
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = rows.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / SCALE)))
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.filter(F.size("v") == (lengths["d"] if lengths else -1))


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of vectors as integers: n, d, kind (numpy type), body, ids. Written once, read by every product."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.floor(SCALE * part.column(1).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
                kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if x.size == 0 or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([x.size // part.num_rows], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary()), ids],
                                                 names=["n", "d", "kind", "body", "ids"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(released(work), f"n long, d long, kind string, body binary, ids array<{kind}>")


class Centre:
    """Number of vectors, and the mean of each dimension as a whole part and a rest."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.d, self.largest = n, len(sums), largest
        self.whole = np.array([s // n for s in sums], np.int64)
        self.over = np.array([s - n * (s // n) for s in sums], np.int64)

    def whole_numbers(self, kind: str, body: bytes) -> np.ndarray:
        return np.frombuffer(body, kind).reshape(-1, self.d).astype(np.int64) - self.whole

    def centred(self, kind: str, body: bytes) -> np.ndarray:
        return self.whole_numbers(kind, body) - self.over / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n*x - S)^2, null beyond 64 bits."""
        if self.d * (self.n * (2 * self.largest + 2)) ** 2 < 1 << 63:
            return pa.array(((self.n * x - self.over) ** 2).sum(1), pa.int64())
        exact = ((self.n * x.astype(object) - self.over.astype(object)) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def centre(written: DataFrame) -> Centre | None:
    """Exact sums of all blocks; None without vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, largest = 0, None, 0
        for batch in batches:
            for rows, d, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(body, kind).reshape(-1, d).astype(np.int64)
                n += rows
                total = x.sum(0).astype(object) + (0 if total is None else total)
                largest = max(largest, int(np.abs(x).max(initial=0)))
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, n), pa.int64()), pa.array(np.arange(k), pa.int64()), pa.array([str(v) for v in total]), pa.array(np.full(k, largest), pa.int64())],
                                             names=["n", "place", "total", "largest"])

    parts = bounded_batches(written.select("n", "d", "kind", "body")).mapInArrow(released(work), "n long, place long, total string, largest long")
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("largest").alias("largest")).orderBy("place").collect()
    return Centre(found[0]["n"], [int(r["total"]) for r in found], max(r["largest"] for r in found)) if found else None


def summed(written: DataFrame, fit: Centre, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``part`` makes of the centred vectors. Tasks add up, then a few tasks, then the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = part(fit.centred(kind, body))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for k, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(body, np.float64)
                total, first = (new, k) if total is None else (total + new, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "body"])

    parts = bounded_batches(written.select("kind", "body")).mapInArrow(work, "part long, body binary")
    dealt = parts.repartition(_WAYS, F.col("part") % _WAYS).sortWithinPartitions("part")
    found = sorted((r["part"], bytes(r["body"])) for r in dealt.mapInArrow(add, "part long, body binary").collect())
    return np.sum([np.frombuffer(b, np.float64) for _, b in found], axis=0)


def products(written: DataFrame, fit: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance times the columns of a matrix, by a job each time."""

    def times(columns: np.ndarray) -> np.ndarray:
        return summed(written, fit, lambda x: (x.T @ (x @ columns)).ravel()).reshape(columns.shape) / fit.n

    return times


def _orthonormal(new: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add what ``new`` has beyond the orthonormal ``to``."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - to @ (to.T @ new)
        if not new.shape[1]:
            return new
        left, weight, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, weight > 1e-10]
    return new


def corrections(times: Callable[[np.ndarray], np.ndarray], values: np.ndarray, residuals: np.ndarray, off: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for (I-QQ')(V - value)(I-QQ') t = -residual, a column for each value; ``off`` is Q."""

    def project(x: np.ndarray) -> np.ndarray:
        return x - off @ (off.T @ x)

    right = project(-residuals)
    size = np.linalg.norm(right, axis=0)
    tiny = 1e-300
    v, before = right / np.maximum(size, tiny), np.zeros_like(right)
    t, w, w_before = (np.zeros_like(right) for _ in range(3))
    beta, rest = np.zeros(len(size)), size.copy()
    c, s, c_before, s_before = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    live = size > 0
    for _ in range(steps):
        if not live.any():
            break
        p = project(times(v) - values * v) - beta * before
        alpha = (v * p).sum(0)
        p = p - alpha * v
        # columns are few and steps short: one more projection keeps them off Q
        p = project(p)
        after = np.linalg.norm(p, axis=0)
        # the tridiagonal column, turned by the two rotations before, and the new one
        upper = s_before * beta
        middle = c_before * c * beta + s * alpha
        lower = -c_before * s * beta + c * alpha
        length = np.hypot(lower, after)
        safe = np.maximum(length, tiny)
        c_before, s_before, c, s = c, s, lower / safe, after / safe
        w, w_before = (v - middle * w - upper * w_before) / safe, w
        live &= length > 1e-14 * np.maximum(np.abs(values), tiny)
        t = t + np.where(live, c * rest, 0.0) * w
        rest = -s * rest
        live &= after > 1e-14 * np.maximum(np.abs(values), tiny)
        before, v, beta = v, p / np.maximum(after, tiny), after
    return project(t)


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, steps: int = INNER_STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, their unit vectors and residual norms, of a symmetric operator of dimension ``d``.

    Residuals reach ``tolerance`` times the largest eigenvalue and the root of
    the dimension. Where rounding of the products holds them above that, the
    search ends once rounds no longer halve the worst of them.
    """
    wanted = min(wanted, d)
    room = min(d, 3 * wanted + 24)
    rng = np.random.default_rng(20)
    locked = images = np.zeros((d, 0))
    space = np.linalg.qr(rng.standard_normal((d, wanted)))[0]
    mapped = times(space)
    worst, idle = np.inf, 0
    for turns in range(ROUNDS):
        small = space.T @ mapped
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        missing = wanted - locked.shape[1]
        ritz, ritz_mapped = space @ turn, mapped @ turn
        residual = ritz_mapped - ritz * values
        # what lies along locked vectors is theirs
        residual -= locked @ (locked.T @ residual)
        norm = np.linalg.norm(residual, axis=0)
        top = max(float(np.abs(values).max(initial=0)), float(np.abs((locked * images).sum(0)).max(initial=0)))
        close = norm[:missing] <= tolerance * np.sqrt(d) * top
        full = space.shape[1] + locked.shape[1] >= d
        now = float(norm[:missing].max(initial=0))
        idle = idle + 1 if worst / 2 < now < 1e-12 * top else 0
        worst = min(worst, now)
        if close.all() or idle > 4 or (full and idle) or turns == ROUNDS - 1:
            locked, images = np.concatenate([locked, ritz[:, :missing]], 1), np.concatenate([images, ritz_mapped[:, :missing]], 1)
            break
        # lock the leading pairs that have converged, so their order is safe
        ready = int(np.argmin(close)) if not close.all() else missing
        if ready:
            locked, images = np.concatenate([locked, ritz[:, :ready]], 1), np.concatenate([images, ritz_mapped[:, :ready]], 1)
            worst, idle = np.inf, 0
        space, mapped, values, residual, missing = ritz[:, ready:], ritz_mapped[:, ready:], values[ready:], residual[:, ready:], missing - ready
        if full:
            # the space holds everything: only rounding is left, and a fresh product removes it
            space = _orthonormal(space, locked)
            mapped = times(space)
            continue
        off = np.concatenate([locked, space[:, :missing]], 1)
        # an eigenvalue lies within the residual's norm: the upper end keeps early corrections towards the largest ones
        new = corrections(times, values[:missing] + norm[ready : ready + missing], residual[:, :missing], off, steps)
        if space.shape[1] + missing + locked.shape[1] > max(room, wanted + missing) and space.shape[1] > missing:
            # start again from the best vectors and as many more
            keep = min(space.shape[1], missing + wanted // 2)
            space, mapped = space[:, :keep], mapped[:, :keep]
        new = _orthonormal(new, np.concatenate([locked, space], 1))[:, : d - locked.shape[1] - space.shape[1]]
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, 1)), np.concatenate([locked, space], 1))
        space, mapped = np.concatenate([space, new], 1), np.concatenate([mapped, times(new)], 1)
    small = locked.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], locked @ turn[:, ::-1]
    residual = np.linalg.norm(images @ turn[:, ::-1] - vectors * values, axis=0)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign), residual


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: its whitened coordinate.

    Vectors (see ``usable``) become x = floor(64 * entry) + 1000000. Returns vec_id,
    component (from 1, by falling variance), n, deviation (exact sum of
    (n*x - S)^2; null beyond 64 bits), whitened, explained, identity_error and
    residual (norm of V u - e u over the largest e). Directions without variance
    give no component: equal vectors, or a single one, give no row. Repeated
    rows count each; other columns are ignored.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    written = stage(blocks(usable(embeddings)), "whitening-blocks")
    fit = centre(written)
    if fit is None or not fit.d:
        return embeddings.sparkSession.createDataFrame([], fields)
    trace = float(summed(written, fit, lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) / fit.n
    values, vectors, residuals = eigenpairs(products(written, fit), fit.d, components) if trace > 0 else (np.zeros(0), np.zeros((fit.d, 0)), np.zeros(0))
    real = values > LEAST_VARIANCE * values.max(initial=0)
    values, vectors, residuals = values[real], vectors[:, real], residuals[real]
    k = len(values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], fields)
    turned = vectors / np.sqrt(values)

    def squares(x: np.ndarray) -> np.ndarray:
        w = x @ turned
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums = summed(written, fit, squares) / fit.n
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    explained, residuals = values / trace, residuals / values[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(2)[i].values
                whole = fit.whole_numbers(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                found, deviation = (whole - fit.over / fit.n) @ turned, fit.deviations(whole)
                for at in range(0, len(whole), BLOCK // 4):
                    m = min(BLOCK // 4, len(whole) - at)
                    who = pa.array(np.repeat(np.arange(at, at + m), k))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(who), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n), pa.int64()), deviation.take(who), pa.array(found[at : at + m].ravel()),
                         pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.tile(residuals, m))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return bounded_batches(written.select("kind", "body", "ids")).mapInArrow(released(work), fields)
