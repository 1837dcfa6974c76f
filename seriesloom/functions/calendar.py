"""Calendar ordinals: every regular frequency is an integer axis.

A period ordinal turns "is this row on the grid", "how many periods are
missing" and "which block does this row belong to" into integer arithmetic, so
gap detection and segmented scans need no per-series sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seasonal period per frequency alias. Three lookups exist with
# different defaults (12, none, 12); they agree on the listed aliases.
CLEANING_PERIODS = {
    "M": 12, "ME": 12, "MS": 12, "Q": 4, "QE": 4, "QS": 4,
    "W": 52, "D": 7, "B": 5, "H": 24, "h": 24,
}
DIAGNOSTIC_PERIODS = {
    "D": 7, "B": 5, "W": 52, "MS": 12, "ME": 12, "M": 12,
    "QS": 4, "QE": 4, "Q": 4, "H": 24, "h": 24,
    "YS": 1, "YE": 1, "Y": 1, "A": 1,
}
# Approximate upper bound of the number of periods a nanosecond calendar
# (1677..2262) can hold, i.e. the longest series a grid can produce.
MAX_PERIODS = {
    "YS": 600, "QS": 2_400, "MS": 7_200, "W": 31_000, "B": 153_000,
    "D": 214_000, "h": 5_130_000,
}
# Longest series ordered in one task. Coarser grids than this bound are
# ordered with plain windows, finer ones with segmented scans.
SINGLE_TASK_ROWS = 250_000
SCAN_BLOCK = 4_096

_EPOCH_DATE = "DATE'1970-01-01'"


def normalise_alias(freq: str) -> str:
    """Map an alias onto the canonical unit used for ordinals."""
    base = freq.split("-")[0]
    table = {
        "H": "h", "h": "h", "D": "D", "B": "B", "W": "W",
        "M": "MS", "MS": "MS", "ME": "MS", "Q": "QS", "QS": "QS", "QE": "QS",
        "Y": "YS", "A": "YS", "YS": "YS", "YE": "YS",
    }
    if base not in table:
        raise ValueError(f"Unsupported frequency alias: {freq}")
    return table[base]


def block_for(freq: str) -> int | None:
    """Block length for ordered operators on a grid of this frequency.

    ``None`` means the calendar itself bounds a series below
    ``SINGLE_TASK_ROWS``, so one window per series is safe.
    """
    return None if MAX_PERIODS[normalise_alias(freq)] <= SINGLE_TASK_ROWS else SCAN_BLOCK


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, without a zone cast."""
    days = F.datediff(ts.cast("date"), F.expr(_EPOCH_DATE)).cast("long")
    secs = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long")
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (days * 86_400 + secs) * 1_000_000 + micros


def period_index(ts: Column, freq: str) -> Column:
    """Integer ordinal of the period that contains ``ts``."""
    unit = normalise_alias(freq)
    days = F.datediff(ts.cast("date"), F.expr(_EPOCH_DATE)).cast("long")
    if unit == "h":
        return days * 24 + F.hour(ts)
    if unit == "D":
        return days
    if unit == "B":  # weekdays only; Saturday and Sunday fall on Friday
        week = F.floor((days + 3) / 7)
        return week * 5 + F.least(F.pmod(days + 3, F.lit(7)), F.lit(4))
    if unit == "W":  # weeks labelled by their Sunday
        return F.floor((days + 3) / 7).cast("long")
    if unit == "MS":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")
    if unit == "QS":
        return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")
    return F.year(ts).cast("long")


def period_stamp(index: Column, freq: str) -> Column:
    """Grid timestamp of a period ordinal (inverse of ``period_index``)."""
    unit = normalise_alias(freq)
    epoch = F.expr(_EPOCH_DATE)
    i = index.cast("int")
    if unit == "h":
        day = F.date_add(epoch, F.floor(index / 24).cast("int")).cast("timestamp_ntz")
        return day + F.make_dt_interval(hours=F.pmod(index, F.lit(24)).cast("int"))
    if unit == "D":
        return F.date_add(epoch, i).cast("timestamp_ntz")
    if unit == "B":
        day = F.floor(index / 5) * 7 + F.pmod(index, F.lit(5)) - 3
        return F.date_add(epoch, day.cast("int")).cast("timestamp_ntz")
    if unit == "W":
        return F.date_add(epoch, i * 7 + 3).cast("timestamp_ntz")
    if unit == "MS":
        return F.add_months(epoch, i - 1970 * 12).cast("timestamp_ntz")
    if unit == "QS":
        return F.add_months(epoch, (i - 1970 * 4) * 3).cast("timestamp_ntz")
    return F.add_months(epoch, (i - 1970) * 12).cast("timestamp_ntz")


def bucket(ts: Column, freq: str) -> Column:
    """Truncate a timestamp to its grid stamp."""
    return period_stamp(period_index(ts, freq), freq)


def normalise_frequency(freq: Column) -> Column:
    """Collapse an alias column onto MS/QS/W/D/YS by prefix."""
    f = F.upper(F.coalesce(freq, F.lit("")))
    f = F.regexp_replace(f, "^-+", "")
    return (
        F.when(f.startswith("M"), "MS")
        .when(f.startswith("Q"), "QS")
        .when(f.startswith("W"), "W")
        .when(f.startswith("D"), "D")
        .when(f.startswith("Y") | f.startswith("A"), "YS")
        .otherwise(f)
    )


def seasonal_period(freq: Column, default: int | None = 12,
                    table: dict[str, int] | None = None) -> Column:
    """Seasonal period of an alias column; anchors such as ``W-SUN`` are cut."""
    pairs = []
    for alias, period in (table or CLEANING_PERIODS).items():
        pairs += [F.lit(alias), F.lit(period)]
    lookup = F.try_element_at(F.create_map(*pairs), F.split_part(freq, F.lit("-"), F.lit(1)))
    return F.coalesce(lookup, F.lit(default).cast("int"))


def future_stamps(last_ts: Column, horizon: int, freq: str) -> Column:
    """Array of the next ``horizon`` grid stamps after ``last_ts``."""
    base = period_index(last_ts, freq)
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda h: period_stamp(base + h, freq)
    )
