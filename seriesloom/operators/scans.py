"""Segmented scans: ordered operators that do not need one task per series.

A window over ``series_id`` puts a whole series in one task. That is fine while
the calendar bounds the series, and fatal for a raw or hourly series that holds
a third of the table. Here the ordinal axis is cut into fixed blocks: one small
aggregate per (series, block) is scanned across blocks and joined back, and the
per-row window runs inside (series, block), which holds at most ``block`` rows
on a grid. The rows are exchanged once by (series, block); both the aggregate
and the window read that exchange.

Every function takes ``block=None`` for the plain single-window plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK = "_blk"


def in_blocks(df: DataFrame, keys: Sequence[str], pos: str, block: int) -> DataFrame:
    """Attach the block number and exchange once by (keys, block)."""
    out = df.withColumn(_BLK, F.floor(F.col(pos) / block))
    return out.repartition(*keys, _BLK)


def _ordered(keys: Sequence[str], order: Column, blocked: bool):
    parts = [*keys, _BLK] if blocked else list(keys)
    return Window.partitionBy(*parts).orderBy(order)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str,
               payload: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Add ``prev`` and ``next``: nearest non-null observation at or before / after.

    Both are structs ``(pos, value, *payload)``; NULL where none exists.
    """
    seen = F.when(
        F.col(value).isNotNull(), F.struct(F.col(pos), F.col(value), *[F.col(c) for c in payload])
    )
    rows = df.withColumn("_seen", seen)
    if block is not None:
        rows = in_blocks(rows, keys, pos, block)
        ends = rows.groupBy(*keys, _BLK).agg(
            F.max("_seen").alias("_last_in"), F.min("_seen").alias("_first_in")
        )
        up = _ordered(keys, F.col(_BLK), False).rowsBetween(Window.unboundedPreceding, -1)
        down = _ordered(keys, F.col(_BLK).desc(), False).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(
            *keys, _BLK,
            F.last("_last_in", True).over(up).alias("_before"),
            F.last("_first_in", True).over(down).alias("_after"),
        )
        rows = rows.join(carry, [*keys, _BLK])
    asc = _ordered(keys, F.col(pos), block is not None).rowsBetween(Window.unboundedPreceding, 0)
    desc = _ordered(keys, F.col(pos).desc(), block is not None).rowsBetween(Window.unboundedPreceding, 0)
    prev, nxt = F.last("_seen", True).over(asc), F.last("_seen", True).over(desc)
    if block is not None:
        prev, nxt = F.coalesce(prev, F.col("_before")), F.coalesce(nxt, F.col("_after"))
    out = rows.withColumn("prev", prev).withColumn("next", nxt)
    return out.drop("_seen", "_before", "_after", _BLK)


def running_sums(df: DataFrame, keys: Sequence[str], pos: str, sums: dict[str, Column],
                 block: int | None = None) -> DataFrame:
    """Inclusive prefix sums of several expressions along ``pos``."""
    rows = df.withColumns({f"_x_{k}": v for k, v in sums.items()})
    carried = {}
    if block is not None:
        rows = in_blocks(rows, keys, pos, block)
        totals = rows.groupBy(*keys, _BLK).agg(
            *[F.sum(f"_x_{k}").alias(f"_b_{k}") for k in sums]
        )
        before = _ordered(keys, F.col(_BLK), False).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *keys, _BLK,
            *[F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums],
        )
        rows = rows.join(carry, [*keys, _BLK])
        carried = {k: F.col(f"_c_{k}") for k in sums}
    w = _ordered(keys, F.col(pos), block is not None).rowsBetween(Window.unboundedPreceding, 0)
    # a block that opens on NULLs has a NULL partial sum, not a missing carry
    outs = {
        k: (F.coalesce(F.sum(f"_x_{k}").over(w), F.lit(0)) + carried[k]) if carried
        else F.sum(f"_x_{k}").over(w)
        for k in sums
    }
    tmp = [f"_x_{k}" for k in sums] + [f"_c_{k}" for k in sums]
    return rows.withColumns(outs).drop(_BLK, *tmp)


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
              block: int) -> DataFrame:
    """Copy block edges into the neighbouring block so bounded frames are exact.

    Adds ``_blk`` and ``_own``; rows with ``_own = false`` are context only.
    ``before``/``after`` are the frame reach in ordinals, at most one block.
    """
    if max(before, after) > block:
        raise ValueError("Frame reach exceeds the block; enlarge the block.")
    own = F.floor(F.col(pos) / block)
    offset = F.pmod(F.col(pos), F.lit(block))
    copies = F.filter(
        F.array(
            F.struct(own.alias("b"), F.lit(True).alias("own")),
            F.when(offset >= block - before, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))),
            F.when(offset < after, F.struct((own - 1).alias("b"), F.lit(False).alias("own"))),
        ),
        lambda s: s.isNotNull(),
    )
    out = df.withColumn("_copy", F.explode(copies))
    return out.withColumns({_BLK: F.col("_copy.b"), "_own": F.col("_copy.own")}).drop("_copy")


def framed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
           make, block: int | None = None) -> DataFrame:
    """Apply ``make(window_spec) -> {name: Column}`` with a bounded reach."""
    if block is None:
        return df.withColumns(make(_ordered(keys, F.col(pos), False)))
    rows = with_halo(df, keys, pos, before, after, block)
    out = rows.withColumns(make(_ordered(keys, F.col(pos), True)))
    return out.filter("_own").drop(_BLK, "_own")


def dense_ordinal(df: DataFrame, keys: Sequence[str], axis: str, order: Sequence[str],
                  out: str = "t", span: int | None = None) -> DataFrame:
    """Zero-based row number along ``order`` without one task per series.

    ``axis`` is an integer column monotone in ``order`` (for example epoch
    microseconds); blocks are ``span`` wide on it. ``span=None`` uses one window.
    """
    if span is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    rows = in_blocks(df, keys, axis, span)
    sizes = rows.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, _BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    w = Window.partitionBy(*keys, _BLK).orderBy(*order)
    joined = rows.join(carry, [*keys, _BLK])
    return joined.withColumn(out, F.row_number().over(w) - 1 + F.col("_c")).drop(_BLK, "_c")


def sum_before_after_gap(df: DataFrame, keys: Sequence[str], pos: str, value: str,
                         step_out: str, axis: str, span: int | None = None) -> DataFrame:
    """Difference to the previous row's ``value`` along an integer axis."""
    if span is None:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumn(step_out, F.col(value) - F.lag(value).over(w))
    rows = in_blocks(df, keys, axis, span)
    ends = rows.groupBy(*keys, _BLK).agg(F.max_by(value, pos).alias("_end"))
    up = Window.partitionBy(*keys).orderBy(_BLK)
    carry = ends.select(*keys, _BLK, F.lag("_end").over(up).alias("_prev"))
    w = Window.partitionBy(*keys, _BLK).orderBy(pos)
    joined = rows.join(carry, [*keys, _BLK])
    prev = F.coalesce(F.lag(value).over(w), F.col("_prev"))
    return joined.withColumn(step_out, F.col(value) - prev).drop(_BLK, "_prev")
