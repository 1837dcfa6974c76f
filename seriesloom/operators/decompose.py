"""Classical additive decomposition and the imputer built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.impute import interpolate_time
from seriesloom.operators.scans import framed

KEYS = ("series_id",)


def classical_decompose(df: DataFrame, period: int, keys: Sequence[str] = KEYS,
                        block: int | None = None) -> DataFrame:
    """Trend, seasonal and residual of a gap-free gridded panel.

    The trend is a centred moving average (half weights at both ends for an
    even period); edges follow a line through the ``period`` nearest trend
    points. Seasonal means are centred on zero.
    """
    half = period // 2
    whole = Window.partitionBy(*keys)
    if block is None:
        # windows of one exchange: what a join would make again for each of its sides is made once
        rows = df.dropna(subset=list(keys)).withColumn("n", F.count(F.lit(1)).over(whole))
    else:
        rows = df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys))

    def centred(w):
        total = F.sum("value").over(w.rowsBetween(-half, half))
        if period % 2:
            return {"_ma": total / period}
        ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
        return {"_ma": (total - 0.5 * ends) / period}

    ma = framed(rows, keys, "t", half, half, centred, block)
    inside = (F.col("t") >= half) & (F.col("t") <= F.col("n") - 1 - half)
    ma = ma.withColumn("_ma", F.when(inside, F.col("_ma")))
    # end lines: the first `period` trend points, and `period` points before the last one
    last = F.col("n") - 1 - half
    head = F.when((F.col("t") < F.least(F.lit(half + period), last)), F.col("_ma"))
    tail = F.when((F.col("t") >= F.greatest(F.lit(half), last - period)) & (F.col("t") < last), F.col("_ma"))
    t = F.col("t").cast("double")
    ends = {"_ks": F.regr_slope(head, t), "_ki": F.regr_intercept(head, t), "_es": F.regr_slope(tail, t), "_ei": F.regr_intercept(tail, t)}
    if block is None:
        lined = ma.withColumns({name: line.over(whole) for name, line in ends.items()})
    else:
        lined = ma.join(ma.groupBy(*keys).agg(*[line.alias(name) for name, line in ends.items()]), list(keys))
    trended = lined.withColumn(
        "trend",
        F.when(F.col("t") < half, F.col("_ki") + F.col("_ks") * F.col("t"))
        .when(F.col("t") > last, F.col("_ei") + F.col("_es") * F.col("t"))
        .otherwise(F.col("_ma")),
    )
    trended = trended.withColumn("_phase", F.pmod(F.col("t"), F.lit(period)))
    mean = F.avg(F.col("value") - F.col("trend"))
    if block is None:
        same = Window.partitionBy(*keys, "_phase")
        means = trended.withColumns({"_s": mean.over(same), "_i": F.row_number().over(same.orderBy("t"))})
        # each phase counts once in the level
        level = F.avg(F.when(F.col("_i") == 1, F.col("_s"))).over(whole)
        out = means.withColumn("seasonal", F.col("_s") - level).filter(F.col("_phase").isNotNull())
    else:
        means = trended.groupBy(*keys, "_phase").agg(mean.alias("_s"))
        level = means.groupBy(*keys).agg(F.avg("_s").alias("_sbar"))
        seasonal = means.join(level, list(keys)).select(*keys, "_phase", (F.col("_s") - F.col("_sbar")).alias("seasonal"))
        out = trended.join(seasonal, [*keys, "_phase"])
    return out.select(*keys, "t", "ts", "value", "n", "trend", "seasonal",
                      (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def seasonal_strength(resid: Column, seasonal: Column) -> Column:
    """Aggregate: share of de-trended variance the seasonal part explains, in [0, 1]."""
    combined = F.var_pop(resid + seasonal)
    return F.when(combined == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.var_pop(resid) / combined))
    )


def impute_seasonal(df: DataFrame, period: int, keys: Sequence[str] = KEYS,
                    block: int | None = None) -> DataFrame:
    """Fill gaps with trend + seasonal; series under two cycles are interpolated."""
    filled = interpolate_time(df, keys, edges=True, block=block)
    plain = interpolate_time(df, keys, block=block).select(*keys, "t", F.col("value").alias("_plain"))
    parts = classical_decompose(filled, period, keys, block).select(
        *keys, "t", "n", (F.col("trend") + F.col("seasonal")).alias("_model"), F.col("value").alias("_edge")
    )
    joined = df.join(parts, [*keys, "t"]).join(plain, [*keys, "t"])
    value = F.when(F.col("n") < 2 * period, F.coalesce("value", "_plain")).otherwise(
        F.coalesce("value", "_model", "_edge")
    )
    return joined.withColumn("value", value).drop("n", "_model", "_edge", "_plain")
