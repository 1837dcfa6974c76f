"""Autocorrelation, partial autocorrelation and white-noise tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.tails import chi2_sf
from seriesloom.operators.scans import framed

KEYS = ("series_id",)


def lag_products(df: DataFrame, max_lag: int, keys: Sequence[str] = KEYS, value: str = "value",
                 pos: str = "t", demean: bool = True, block: int | None = None) -> DataFrame:
    """``n, mean, c0, c[1..max_lag]``: sums of lagged products.

    All lags share one window, so the rows are exchanged and sorted once and the
    sums combine map-side. A calendar-bounded series is one window over its
    non-null values; a finer one (``block`` given, positions without gaps) is cut
    into blocks with a halo of ``max_lag``.
    """
    if block is None:
        df = df.filter(F.col(value).isNotNull())
    stats = {"n": F.count(value), "mean": F.avg(value)}
    if block is None:
        whole = Window.partitionBy(*keys)
        rows = df.dropna(subset=list(keys)).withColumns({name: stat.over(whole) for name, stat in stats.items()})
    else:
        rows = df.join(df.groupBy(*keys).agg(*[stat.alias(name) for name, stat in stats.items()]), list(keys))
    rows = rows.withColumn("_d", F.col(value) - F.col("mean") if demean else F.col(value))
    lagged = framed(rows, keys, pos, max_lag, 0,
                    lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}, block)
    agg = lagged.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("c0"),
        *[F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}")
          for k in range(1, max_lag + 1)],
    )
    return agg.select(*keys, "n", "mean", "c0",
                      F.array(*[F.col(f"_c{k}") for k in range(1, max_lag + 1)]).alias("c"))


def acf_arrays(df: DataFrame, max_lag: int = 40, keys: Sequence[str] = KEYS,
               block: int | None = None) -> DataFrame:
    """Biased autocorrelations per series, ``min(max_lag, n/2 - 1)`` lags."""
    prod = lag_products(df, max_lag, keys, block=block)
    lags = F.greatest(F.least(F.lit(max_lag), F.floor(F.col("n") / 2) - 1), F.lit(0)).cast("int")
    rho = F.transform(F.slice("c", 1, lags), lambda c: c / F.when(F.col("c0") > 0, F.col("c0")))
    return prod.select(*keys, "n", lags.alias("lags"), rho.alias("acf"))


def partial_from_acf(acf: Column) -> Column:
    """Durbin-Levinson recursion over an autocorrelation array."""
    empty = F.array().cast("array<double>")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state, k):
        phi = state["phi"]
        past = F.slice(acf, 1, k - 1)
        top = F.element_at(acf, k) - dot(phi, F.reverse(past))
        kk = top / (1 - dot(phi, past))
        nxt = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - kk * b), F.array(kk))
        return F.struct(nxt.alias("phi"), F.concat(state["out"], F.array(kk)).alias("out"))

    start = F.struct(empty.alias("phi"), empty.alias("out"))
    result = F.aggregate(F.sequence(F.lit(1), F.size(acf)), start, step, lambda s: s["out"])
    return F.when(F.size(acf) > 0, result).otherwise(empty)


def acf_table(df: DataFrame, max_lag: int = 40, keys: Sequence[str] = KEYS,
              block: int | None = None) -> DataFrame:
    """Long table ``lag, acf, pacf, band`` (lag 0 included, band = 1.96/sqrt(plotted))."""
    arrays = acf_arrays(df, max_lag, keys, block).withColumn("pacf", partial_from_acf(F.col("acf")))
    one = F.array(F.lit(1.0))
    pairs = F.arrays_zip(F.concat(one, F.col("acf")).alias("acf"), F.concat(one, F.col("pacf")).alias("pacf"))
    band = F.lit(1.96) / F.sqrt(F.col("lags") + 1)
    rows = arrays.select(*keys, band.alias("band"), F.posexplode(pairs).alias("lag", "_v"))
    return rows.select(*keys, "lag", "_v.acf", "_v.pacf", "band")


def ljung_box(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", pos: str = "t",
              df_adjust: int = 0, half_cap: bool = False, block: int | None = None) -> DataFrame:
    """White-noise statistic over ``min(10, max(1, n/5))`` lags with its tail.

    ``half_cap`` limits the lag to n/2; ``df_adjust`` is the fitted AR+MA order.
    """
    prod = lag_products(df, 10, keys, value, pos, block=block)
    n = F.col("n")
    lag = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(n / 5)))
    if half_cap:
        lag = F.greatest(F.lit(1), F.least(lag, F.floor(n / 2)))
    lag = lag.cast("int")
    terms = F.transform(
        F.slice("c", 1, lag),
        lambda c, i: F.pow(c / F.when(F.col("c0") > 0, F.col("c0")), 2) / (n - i - 1),
    )
    stat = n * (n + 2) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    out = prod.select(*keys, "n", lag.alias("lag"), stat.alias("statistic"))
    dof = F.greatest(F.lit(1), F.col("lag") - df_adjust).cast("double")
    return out.withColumn("p_value", chi2_sf("statistic", dof)).withColumn(
        "is_white_noise", F.col("p_value") > 0.05
    )
