"""Date texts of unknown form: the rows vote, and what doesn't follow the vote is counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = "[ H:mm[:ss]]"
#: Forms by name. Later ones are preferred less where a column fits several equally well.
FORMS = {
    "iso": None,
    "month/day/year": f"M/d/yyyy{_TIME}",
    "day/month/year": f"d/M/yyyy{_TIME}",
    "year/month/day": f"yyyy/M/d{_TIME}",
    "day.month.year": f"d.M.yyyy{_TIME}",
    "month-day-year": f"M-d-yyyy{_TIME}",
    "day-month-year": f"d-M-yyyy{_TIME}",
    "compact": "yyyyMMdd",
    "day name year": f"d MMM yyyy{_TIME}",
    "name day, year": f"MMM d, yyyy{_TIME}",
    "name year": "MMM yyyy",
    "month/year": "M/yyyy",
}
# the two readings of one shape
_TWINS = (("month/day/year", "day/month/year"), ("month-day-year", "day-month-year"))


def parsed(text: Column, form: str) -> Column:
    """``text`` read in one form; NULL where it doesn't fit."""
    if form == "iso":
        # a bare number of up to six digits would pass as a year; eight digits are the compact form
        return F.when(~F.trim(text).rlike(r"^\d+$") | F.trim(text).rlike(r"^\d{4}$"), F.trim(text).try_cast("timestamp_ntz"))
    return F.try_to_timestamp(F.trim(text), F.lit(FORMS[form])).cast("timestamp_ntz")


def date_vote(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The form of the date texts in column ``name``, one row per group of ``by``.

    Rows: ``form, filled, parsed, refused, ambiguous``. The form that reads most texts
    wins. Day and month in either order often read equally many texts (no day
    beyond the 12th); then the part with fewer different values is the day, as in a
    monthly panel, and ``ambiguous`` says that even this did not decide, so that
    the month comes first. Blank and NULL texts count nowhere; a group without any
    text has form NULL. One aggregate over all rows, of fixed size per group.
    """
    text = F.trim(F.col(name).cast("string"))
    filled = F.length(text) > 0
    read = df.select(*by, F.when(filled, text).alias("_text")).select("*", *[parsed(F.col("_text"), f).alias(f"_f{i}") for i, f in enumerate(FORMS)])
    at = {f: f"_f{i}" for i, f in enumerate(FORMS)}
    masks = []
    for first, second in _TWINS:
        # the parts as the first reading sees them: at most 12 months and 31 days, a bit each
        both = F.when(F.col(at[second]).isNotNull(), F.col(at[first]))
        masks += [F.bit_or(F.call_function("shiftleft", F.lit(1), F.month(both))).alias(f"{at[first]}_left"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(both) % 32)).alias(f"{at[first]}_right")]
    votes = read.groupBy(*by).agg(F.count("_text").alias("filled"), *[F.count(c).alias(c) for c in at.values()], *masks)
    ranks, unsure = [], F.lit(False)
    firsts = {first: second for first, second in _TWINS}
    seconds = {second: first for first, second in _TWINS}
    for place, (form, c) in enumerate(at.items()):
        if form in firsts or form in seconds:
            head = form if form in firsts else seconds[form]
            left, right = (F.bit_count(F.coalesce(f"{at[head]}_{side}", F.lit(0))) for side in ("left", "right"))
            # the reading whose day takes fewer values
            evidence = F.when((right < left) if form in firsts else (left < right), 1).otherwise(0)
            if form in firsts:
                unsure = unsure | ((F.col(c) > 0) & (F.col(c) == F.col(at[firsts[form]])) & (left == right) & (F.col(c) == F.greatest(*at.values())))
        else:
            evidence = F.lit(0)
        ranks.append(F.struct(F.col(c).alias("n"), evidence.alias("evidence"), F.lit(-place).alias("place"), F.lit(form).alias("form")))
    best = F.array_max(F.array(*ranks))
    out = votes.select(*by, "filled", best.alias("_b"), unsure.alias("_u"))
    none = F.col("_b.n") == 0
    return out.select(*by, F.when(~none, F.col("_b.form")).alias("form"), "filled", F.col("_b.n").alias("parsed"), (F.col("filled") - F.col("_b.n")).alias("refused"), F.coalesce("_u", F.lit(False)).alias("ambiguous"))


def with_dates(df: DataFrame, name: str, votes: DataFrame, by: Sequence[str] = (), to: str = "ts", strict: bool = False) -> DataFrame:
    """``df`` with the stamp ``to`` of column ``name``, read in the form its group voted for.

    Lenient: a text that doesn't fit becomes NULL (``votes.refused`` counts them).
    Strict: the first such text ends the job with its group's count. Blank texts
    are NULL in both.
    """
    row = votes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("form").alias("_form"), F.col("refused").alias("_refused"))
    if by:
        same = None
        for c in by:
            test = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
            same = test if same is None else same & test
        joined = df.join(row, same, "left")
    else:
        # one row in all
        joined = df.withColumn("_v", row.select(F.struct("_form", "_refused")).scalar()).withColumns({"_form": F.col("_v._form"), "_refused": F.col("_v._refused")}).drop("_v")
    text = F.trim(F.col(name).cast("string"))
    stamp = F.lit(None).cast("timestamp_ntz")
    for form in FORMS:
        stamp = F.when(F.col("_form") == form, parsed(text, form)).otherwise(stamp)
    if strict:
        why = F.concat(F.col("_refused").cast("string"), F.lit(f" text(s) of column '{name}' are no dates, among them: "), text)
        stamp = F.when((F.length(text) > 0) & stamp.isNull(), F.raise_error(why).cast("timestamp_ntz")).otherwise(stamp)
    return joined.withColumn(to, stamp).drop("_form", "_refused", *[f"_by_{c}" for c in by])
