"""What became of every forecast that was due: origins that succeeded, failed or were skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.guards import finite

ORIGIN = ("series_id", "fold", "kind")
# an origin with less training is left out
LEAST_TRAINING = 2


def due(folds: DataFrame, candidates: DataFrame, origin: Sequence[str] = ORIGIN) -> DataFrame:
    """The expected frame: a row (origin, model, h) for every step of every fold and candidate.

    ``folds`` as from ``fold_plan``; ``candidates`` has (series_id, model), one row for
    each candidate that a series should be given.
    """
    rows = folds.join(candidates.select("series_id", "model"), "series_id")
    return rows.select(*origin, "train_end", "model", F.explode(F.sequence(F.lit(1), F.greatest("horizon", F.lit(1)).cast("int"))).alias("h"), "horizon")


def same_candidates(folds: DataFrame, models: Sequence[str]) -> DataFrame:
    """(series_id, model) with the same candidates for every series that has a fold."""
    return folds.select("series_id").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))


def aligned(expected: DataFrame, predictions: DataFrame, actuals: DataFrame, origin: Sequence[str] = ORIGIN) -> DataFrame:
    """Expected steps, predictions and actuals side by side, none of them lost.

    Adds ``due``, ``predicted`` and ``observed`` flags, ``yhat`` and ``y``. A prediction
    that nobody expected (a wrong length, an unknown candidate) keeps its row with
    ``due`` false; a missing one has ``predicted`` false; a step behind the end of the
    panel has ``observed`` false. A step predicted twice counts as wrong length.
    """
    keys = [*origin, "model", "h"]
    made = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_made"), F.first("yhat").alias("yhat"))
    both = expected.withColumn("due", F.lit(True)).join(made, keys, "full")
    seen = actuals.select(*origin, "h", "y").withColumn("observed", F.lit(True))
    out = both.join(seen, [*origin, "h"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(*keys, "train_end", "horizon", flag("due").alias("due"), (F.coalesce("_made", F.lit(0)) > 0).alias("predicted"),
                      (F.coalesce("_made", F.lit(0)) > 1).alias("repeated"), flag("observed").alias("observed"), "yhat", "y")


def _fit_status(fits: DataFrame | None, origin: Sequence[str]) -> DataFrame | None:
    return None if fits is None else fits.groupBy(*origin, "model").agg(F.min("status").alias("_fit"), F.min("reason").alias("_why"))


def origin_status(rows: DataFrame, fits: DataFrame | None = None, origin: Sequence[str] = ORIGIN) -> DataFrame:
    """(origin, model, status, reason): one row for every origin and candidate of ``aligned`` rows.

    * ``skipped``: under two rows of training, or no actual to compare with;
    * the fit's own status, where ``fits`` (origin, model, status, reason) has one that isn't ok;
    * ``not_estimable``: the candidate gave nothing;
    * ``failed``: another number of steps than was due;
    * ``ok``.
    """
    one = rows.groupBy(*origin, "model").agg(
        F.max("train_end").alias("_train"), F.count_if("due").alias("_due"), F.count_if("predicted").alias("_made"),
        F.count_if(F.col("due") != F.col("predicted")).alias("_odd"), F.count_if("repeated").alias("_again"), F.count_if(F.col("due") & F.col("observed")).alias("_seen"))
    named = _fit_status(fits, origin)
    if named is not None:
        one = one.join(named, [*origin, "model"], "left")
    else:
        one = one.withColumns({"_fit": F.lit(None).cast("string"), "_why": F.lit(None).cast("string")})
    wrong = (F.col("_odd") > 0) | (F.col("_again") > 0)
    steps = F.concat(F.col("_made").cast("string"), F.lit(" of "), F.col("_due").cast("string"))

    def told(pick) -> Column:
        return (F.when(F.coalesce(F.col("_train"), F.lit(0)) < LEAST_TRAINING, pick("skipped", F.lit("training")))
                .when(F.col("_seen") == 0, pick("skipped", F.lit("no_actual")))
                .when(F.coalesce(F.col("_fit"), F.lit("ok")) != "ok", pick(F.col("_fit"), F.col("_why")))
                .when(F.col("_made") == 0, pick("not_estimable", F.lit("no_prediction")))
                .when(wrong, pick("failed", F.concat(F.lit("steps "), steps)))
                .otherwise(pick("ok", F.lit(None).cast("string"))))

    return one.select(*origin, "model", told(lambda s, why: F.lit(s) if isinstance(s, str) else s).alias("status"), told(lambda s, why: why).alias("reason"))


def origin_counts(status: DataFrame, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Origins that succeeded and that failed; skipped ones count as neither."""
    return status.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("n_origins"),
        F.count_if(~F.col("status").isin("ok", "skipped")).alias("n_failed_origins"))


def scored(rows: DataFrame, status: DataFrame, origin: Sequence[str] = ORIGIN) -> DataFrame:
    """The pairs that metrics may use: steps of origins that are ``ok``; non-finite sides become NULL."""
    good = status.filter(F.col("status") == "ok").select(*origin, "model")
    return rows.filter("due").join(good, [*origin, "model"], "left_semi").select(*origin, "model", "h", finite(F.col("y")).alias("y"), finite(F.col("yhat")).alias("yhat"))
