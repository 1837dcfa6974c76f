"""Recursive levels as scans of affine maps.

A stretch of a recursion ``level = a * level + b`` is one affine map of the level
that enters it, and its sum of squared one-step errors is a quadratic form of
that level. Neighbouring stretches compose, so a series is cut into blocks that
are folded where they lie and then composed, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.quantiles import list_quantile, series_quantiles
from seriesloom.operators.scans import _BLK
from seriesloom.staging import stage

#: Blocks composed in one row; two such levels span 2**18 blocks, a third the rest.
FAN = 512
#: Observations folded in one row.
BLOCK = 128
# Smoothing levels tried, 0.01 to 0.99 in steps of 0.01.
ALPHA_GRID = [i / 100 for i in range(1, 100)]


def _entered(maps: Column, level: Column, name: str) -> Column:
    """(name, level that enters it) for each of the ordered ``maps`` (name, a, b)."""
    start = F.struct(level.alias("x"), F.array().cast(f"array<struct<{name}:bigint,x:double>>").alias("out"))
    return F.aggregate(maps, start, lambda s, m: F.struct(
        (s["x"] * m["a"] + m["b"]).alias("x"), F.concat(s["out"], F.array(F.struct(m[name].alias(name), s["x"].alias("x")))).alias("out")), lambda s: s["out"])


def affine_carry(ends: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """(keys, _blk, x): the level that enters each block of ``ends`` (keys, _blk, a, b); 0 enters the first.

    Blocks compose in groups of ``fan``, groups in groups of ``fan``, so no row
    holds more than ``fan`` maps until a series has ``fan`` ** 3 blocks.
    """
    keys = list(keys)

    def grouped(df: DataFrame, name: str, upper: str) -> DataFrame:
        return df.withColumn(upper, F.floor(F.col(name) / fan)).groupBy(*keys, upper).agg(F.array_sort(F.collect_list(F.struct(name, "a", "b"))).alias("_m"))

    def composed(df: DataFrame, upper: str) -> DataFrame:
        whole = F.aggregate("_m", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, m: F.struct(
            (s["a"] * m["a"]).alias("a"), (s["b"] * m["a"] + m["b"]).alias("b")))
        return df.select(*keys, upper, whole.alias("w")).select(*keys, upper, "w.*")

    one = grouped(ends.select(*keys, F.col(_BLK).cast("long").alias(_BLK), "a", "b"), _BLK, "_g")
    two = grouped(composed(one, "_g"), "_g", "_h")
    top = composed(two, "_h").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_h", "a", "b"))).alias("_m"))
    into_h = top.select(*keys, F.inline(_entered(F.col("_m"), F.lit(0.0), "_h")))
    into_g = two.join(into_h, [*keys, "_h"]).select(*keys, F.inline(_entered(F.col("_m"), F.col("x"), "_g")))
    return one.join(into_g, [*keys, "_g"]).select(*keys, F.inline(_entered(F.col("_m"), F.col("x"), _BLK)))


def _step(s: Column, y: Column, alpha: Column) -> Column:
    """State of a stretch after one more value: the map (a, b), and the error form q0 + q1 x + q2 x^2."""
    miss = y - s["b"]
    return F.struct(((1 - alpha) * s["a"]).alias("a"), ((1 - alpha) * s["b"] + alpha * y).alias("b"),
                    (s["q0"] + miss * miss).alias("q0"), (s["q1"] - 2 * s["a"] * miss).alias("q1"), (s["q2"] + s["a"] * s["a"]).alias("q2"))


def _state(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), *(F.lit(0.0).alias(q) for q in ("q0", "q1", "q2")))


def _then(s: Column, m: Column) -> Column:
    """Two stretches in a row as one."""
    return F.struct(
        (m["a"] * s["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b"),
        (s["q0"] + m["q0"] + m["q1"] * s["b"] + m["q2"] * s["b"] * s["b"]).alias("q0"),
        (s["q1"] + m["q1"] * s["a"] + 2 * m["q2"] * s["a"] * s["b"]).alias("q1"), (s["q2"] + m["q2"] * s["a"] * s["a"]).alias("q2"))


def level_blocks(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(keys, carry, _blk, xs, _first, n_train, v0): ordered non-null values, less the first one ``v0``, of each block of positions ``t``."""
    keys = list(keys)
    # a window without a key gets no fit
    known = F.col("value").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    seen = rows.filter(known).select(*keys, *carry, F.floor(F.col("t") / block).alias(_BLK), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("v"))
    blocks = seen.groupBy(*keys, _BLK).agg(*[F.first(c).alias(c) for c in carry], F.array_sort(F.collect_list(F.struct("t", "v"))).alias("xs"))
    # blocks, not rows, meet once more for what they share
    w = Window.partitionBy(*keys)
    blocks = blocks.withColumns({"_least": F.min(_BLK).over(w), "n_train": F.sum(F.size("xs").cast("long")).over(w), "v0": F.min_by(F.element_at("xs", 1)["v"], _BLK).over(w)})
    # measured from the first value, so that forms of a level series cancel exactly
    shifted = F.transform("xs", lambda x: F.struct(x["t"].alias("t"), (x["v"] - F.col("v0")).alias("v")))
    return blocks.withColumns({"_first": F.col(_BLK) == F.col("_least"), "xs": shifted}).drop("_least")


def level_grid(blocks: DataFrame, keys: Sequence[str], alphas: Sequence[float] = tuple(ALPHA_GRID), fan: int = FAN) -> DataFrame:
    """(keys, k, alpha, level over ``v0``, sse) for every level of the grid, all advanced together block by block."""
    keys = list(keys)

    def folded(alpha: Column) -> Column:
        # the first value is the level; it has no error
        start = F.when(F.col("_first"), _state(F.lit(0.0), F.element_at("xs", 1)["v"])).otherwise(_state(F.lit(1.0), F.lit(0.0)))
        rest = F.when(F.col("_first"), F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1)))).otherwise(F.col("xs"))
        return F.aggregate(rest, start, lambda s, x: _step(s, x["v"], alpha))

    grid = F.transform(F.array(*map(F.lit, alphas)), folded)
    maps = blocks.select(*keys, F.col(_BLK).cast("long").alias("_p"), F.posexplode(grid).alias("k", "m"))

    def merged(df: DataFrame, into: Column | None) -> DataFrame:
        by = [*keys, "k"] + (["_q"] if into is not None else [])
        some = df if into is None else df.withColumn("_q", into)
        one = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "m"))).alias("_ms"))
        total = F.aggregate(F.slice("_ms", 2, F.size("_ms")), F.element_at("_ms", 1)["m"], lambda s, x: _then(s, x["m"]))
        return one.select(*by, total.alias("m")).withColumnRenamed("_q", "_p")

    whole = merged(merged(maps, F.floor(F.col("_p") / fan)), None)
    return whole.select(*keys, "k", F.element_at(F.array(*map(F.lit, alphas)), F.col("k") + 1).alias("alpha"), F.col("m.b").alias("level"), F.col("m.q0").alias("sse"))


def whole_grid(windows: DataFrame, keys: Sequence[str], kept: Sequence[str] = (), alphas: Sequence[float] = tuple(ALPHA_GRID)) -> DataFrame:
    """(keys, kept, alpha, sse, level over ``v0``): the best level of windows that are one block each; a trial makes no row.

    A one-step error is the step from the value before plus (1 - alpha) times the error before.
    """
    # a window costs milliseconds: dealt evenly, not by bytes
    windows = windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = F.zip_with(F.slice("xs", 2, F.size("xs") - 1), F.slice("xs", 1, F.size("xs") - 1), lambda y, x: y["v"] - x["v"])
    rows = windows.select(*keys, *kept, F.element_at("xs", -1)["v"].alias("_y"), steps.alias("_d"))
    trials = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(1.0 - a).alias("r")) for k, a in enumerate(alphas)])

    def tried(trial: Column) -> Column:
        # ``s`` holds the squares of the errors before ``e``
        start = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("s"))
        return F.aggregate("_d", start, lambda z, d: F.struct((d + trial["r"] * z["e"]).alias("e"), (z["s"] + z["e"] * z["e"]).alias("s")), lambda z: F.struct(
            (z["s"] + z["e"] * z["e"]).alias("sse"), trial["k"].alias("k"), trial["a"].alias("alpha"), (F.col("_y") - trial["r"] * z["e"]).alias("level")))

    return rows.withColumn("_b", F.array_min(F.transform(trials, tried))).select(*keys, *kept, "_b.alpha", "_b.sse", "_b.level")


def _error_list(entered: Column) -> Column:
    """One-step errors of a block's values with the level that ``entered`` it; the first value of a window has none."""
    errors = F.aggregate("xs", F.struct(entered.alias("x"), F.array().cast("array<double>").alias("out")), lambda s, x: F.struct(
        ((1 - F.col("alpha")) * s["x"] + F.col("alpha") * x["v"]).alias("x"), F.concat(s["out"], F.array(x["v"] - s["x"])).alias("out")), lambda s: s["out"])
    return F.when(F.col("_first"), F.slice(errors, 2, F.greatest(F.size("xs") - 1, F.lit(1)))).otherwise(errors)


def level_errors(blocks: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _blk, resid): the one-step errors of each block, in order, under the ``chosen`` (keys, alpha)."""
    keys = list(keys)
    mine = blocks.join(chosen.select(*keys, "alpha"), keys)
    a = F.when(F.col("_first"), F.lit(0.0)).otherwise(F.pow(1 - F.col("alpha"), F.size("xs")))
    start = F.when(F.col("_first"), F.element_at("xs", 1)["v"]).otherwise(F.lit(0.0))
    b = F.aggregate("xs", start, lambda s, x: (1 - F.col("alpha")) * s + F.col("alpha") * x["v"])
    entered = mine.join(affine_carry(mine.select(*keys, _BLK, a.alias("a"), b.alias("b")), keys), [*keys, _BLK])
    first = F.when(F.col("_first"), F.element_at("xs", 1)["v"]).otherwise(F.col("x"))
    return entered.select(*keys, _BLK, _error_list(first).alias("resid"))


def level_fit(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), with_resid: bool = False, unbounded: bool = False, block: int = BLOCK) -> DataFrame:
    """Simple smoothing of (keys, t, value): the level with the least squared one-step error on the grid.

    Adds status, alpha, sse, level, band_lo and band_hi (exact residual quantiles,
    which resampling the residuals converges to), n_train; ``with_resid`` also the
    residuals as an array (for windows that fit a row). Under three values a window is
    ``not_estimable`` with its last value as level. ``unbounded`` is for windows
    whose residuals one row should not hold. A window of one block is fitted
    where it lies; only longer ones send a row for each trial through exchanges.
    """
    keys, carry = list(keys), list(carry)
    blocks = stage(level_blocks(rows, keys, carry, block), "level-blocks")
    n, last = F.col("n_train"), F.element_at("xs", -1)["v"]
    whole = blocks.filter((n >= 3) & (F.size("xs") == n))
    one = whole_grid(whole, keys, [*carry, "n_train", "v0", "xs", "_first"]).withColumn("resid", _error_list(F.element_at("xs", 1)["v"]))

    def ended(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in [*carry, "n_train", "v0"]], F.max_by(last, _BLK).alias("_last"))

    short = ended(blocks.filter(n < 3))
    cut = blocks.filter((n >= 3) & (F.size("xs") < n))
    best = level_grid(cut, keys).groupBy(*keys).agg(F.min(F.struct("sse", "k", "alpha", "level")).alias("_b")).select(*keys, "_b.alpha", "_b.sse", "_b.level")
    errors = level_errors(cut, best, keys)
    many = ended(cut).join(best, keys)
    if with_resid or not unbounded:
        lists = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(_BLK, "resid"))).alias("_r"))
        many = many.join(lists.select(*keys, F.flatten(F.transform("_r", lambda r: r["resid"])).alias("resid")), keys)
    probs = {"band_lo": 0.025, "band_hi": 0.975}

    def banded(df: DataFrame) -> DataFrame:
        ordered = df.withColumn("_o", F.array_sort("resid"))
        return ordered.withColumns({name: list_quantile(F.col("_o"), p) for name, p in probs.items()}).drop("_o")

    if unbounded:
        band = series_quantiles(errors.select(*keys, F.explode("resid").alias("resid")), keys, "resid", list(probs.values()), True)
        many = many.join(band.select(*keys, F.col("q0").alias("band_lo"), F.col("q1").alias("band_hi")), keys)
    else:
        many = banded(many)
    fields = ["alpha", "sse", "level", *probs] + (["resid"] if with_resid else [])
    none = {c: F.lit(None).cast("double") for c in fields} | ({"resid": F.array().cast("array<double>")} if with_resid else {})
    out = None
    for part, status in ((banded(one), "ok"), (many, "ok"), (short.withColumns(none).withColumn("level", F.col("_last")), "not_estimable")):
        part = part.select(*keys, *carry, F.lit(status).alias("status"), *[(F.col(c) + F.col("v0")).alias(c) if c == "level" else F.col(c) for c in fields], n.cast("int").alias("n_train"))
        out = part if out is None else out.unionByName(part)
    # a caller's filter on a fit would else be pushed below the search and repeat it
    return stage(out, "level-fit")
