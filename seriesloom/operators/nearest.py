"""Exact nearest rows for any number of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# vectors of a query block and of a corpus piece, on average; corpus rows scored at a time
BLOCK, PIECE, STEP = 4096, 65_536, 512


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of length one for every vector of ``size`` numbers, and which rows have such a direction."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(lengths == size)
    numbers = column.values.to_numpy(zero_copy_only=False).astype(float)
    rows = np.zeros((len(column), size))
    rows[mine] = numbers[column.offsets.to_numpy()[mine][:, None] + np.arange(size)]
    norm = np.sqrt((rows * rows).sum(1))
    # a vector of zeros, or with a null or non-finite number, has no direction
    good = np.isfinite(norm) & (norm > 0)
    rows[~good] = 0
    return rows / np.where(good, norm, 1)[:, None], good


def _best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row of ``score``: greatest score, then smallest ``place``."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        # columns better than the k-th, then those level with it in the order of their places
        level = score == least
        room = k - (score > least).sum(1)[:, None]
        order = np.argsort(place, axis=1, kind="stable")
        taken = np.empty_like(level)
        np.put_along_axis(taken, order, np.take_along_axis(level, order, 1) & (np.cumsum(np.take_along_axis(level, order, 1), 1) <= room), 1)
        at = np.nonzero((score > least) | taken)
        score, place = score[at].reshape(len(score), k), place[at].reshape(len(place), k)
    return score, place


def _task(k: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        # ties go to the smaller key, so places follow the keys
        right = right.sort_by("key")
        vectors = left["vector"].combine_chunks()
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for size in np.unique(lengths):
            asked = np.flatnonzero(lengths == size)
            queries, directed = _units(vectors.take(pa.array(asked)), int(size))
            score, place = np.empty((len(asked), 0)), np.empty((len(asked), 0), np.int64)
            for start in range(0, len(right), STEP):
                rows, good = _units(right.slice(start, STEP)["vector"].combine_chunks(), int(size))
                new = np.where(directed[:, None] & good, queries @ rows.T, -np.inf)
                score, place = _best(np.hstack([score, new]), np.hstack([place, np.broadcast_to(start + np.arange(len(rows)), new.shape)]), k)
            found.append((np.repeat(asked, place.shape[1]), place.ravel(), score.ravel()))
        who, where, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": left["query_id"].take(pa.array(who)), "key": right["key"].take(pa.array(where)),
                         "similarity": pa.array(score, pa.float64(), mask=np.isinf(score))})

    return work


def nearest_rows(corpus: DataFrame, queries: DataFrame, k: int = 3, vector: str = "embedding", key: str = "vec_id", block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Exact ``k`` nearest corpus rows of every query by cosine similarity: query_id, ``key``, similarity, rank.

    ``queries`` has (query_id, vector). Blocks of about ``block`` queries meet pieces of
    about ``piece`` corpus rows, one pair of them a task, which scores a slice of the
    piece at a time and holds ``k`` rows a query; ranks then merge, first a few pieces at a time.
    So the corpus moves once per query block, and no task or array grows with either table.

    Ties go to the smaller key. A pair has a NULL similarity, and ranks last, where
    one vector is NULL, of zeros or has a null or non-finite number, or where their
    lengths differ. Equal query ids with equal vectors count once.
    """
    blocks = F.greatest(F.lit(1), F.ceil(queries.agg(F.count(F.lit(1))).scalar() / block)).cast("int")
    pieces = F.greatest(F.lit(1), F.ceil(corpus.agg(F.count(F.lit(1))).scalar() / piece)).cast("int")
    # dealt by id and vector, so that one id on many rows does not fill a block
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).distinct().select(
        "*", F.pmod(F.xxhash64("query_id", "vector"), blocks).alias("_block"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    held = corpus.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).select(
        "*", F.pmod(F.xxhash64("key", "vector"), pieces).cast("int").alias("_piece"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_block"))
    ids, keys = asked.schema["query_id"].dataType.simpleString(), held.schema["key"].dataType.simpleString()
    task = _task(k)

    def pair(names, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = task(left, right)
        return rows.append_column("_piece", pa.array(np.full(len(rows), names[1].as_py(), np.int32)))

    near = asked.groupBy("_block", "_piece").cogroup(held.groupBy("_block", "_piece")).applyInArrow(pair, f"query_id {ids}, key {keys}, similarity double, _piece int")
    order = [F.col("similarity").desc_nulls_last(), F.col("key")]
    # pieces of a stripe first, so that a query's last merge holds the square root of its rows
    stripe = F.floor(F.sqrt(pieces.cast("double"))).cast("int")
    some = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", F.pmod("_piece", stripe)).orderBy(*order))).filter(F.col("_r") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("key").alias(key), "similarity", "rank")
