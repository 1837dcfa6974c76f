"""The canonical panel and its selection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.guards import finite


def require_columns(df: DataFrame, date_col: str, value_col: str) -> None:
    """Schema-only checks made before any job starts."""
    if date_col == value_col:
        raise ValueError("Date column and value column must be different.")
    for name in (date_col, value_col):
        if name not in df.columns:
            raise ValueError(f"Column '{name}' was not found.")


def to_stamp(df: DataFrame, name: str) -> Column:
    """Coercing timestamp cast: unparsable text becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        # zone-less parse; accepts yyyy-MM and full stamps alike
        return F.trim(F.col(name)).try_cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def to_number(df: DataFrame, name: str) -> Column:
    """Coercing numeric cast: unparsable text, NaN and infinities become NULL."""
    return finite(F.col(name).try_cast("double"))


def select_panel(df: DataFrame, date_col: str, value_col: str,
                 series: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Project to ``(series_id, ts, value, seq)`` and drop rows without a date."""
    require_columns(df, date_col, value_col)
    return df.select(
        (series if series is not None else F.lit("series")).cast("string").alias("series_id"),
        to_stamp(df, date_col).alias("ts"),
        to_number(df, value_col).alias("value"),
        (seq if seq is not None else F.monotonically_increasing_id()).alias("seq"),
    ).filter(F.col("ts").isNotNull())


def stop_short_series(panel: DataFrame, choice: Column, minimum: int = 20) -> DataFrame:
    """Drop series with fewer usable rows than ``minimum`` where the user chose ``stop``."""
    usable = panel.groupBy("series_id").agg(F.count("value").alias("_usable"))
    keep = usable.filter(~((F.col("_usable") < minimum) & (choice == "stop"))).select("series_id")
    return panel.join(keep, "series_id", "left_semi")


def visible_rows(df: DataFrame, user: str, is_admin: bool = False) -> DataFrame:
    """Owner-scoped scan: a row is visible to its owner and to administrators."""
    return df if is_admin else df.filter(F.col("owner_id") == F.lit(user))
