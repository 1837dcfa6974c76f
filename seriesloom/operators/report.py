"""Report scores and tables as expressions over one evidence row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.guards import label_or_na
from seriesloom.operators.quality import present

# Deductions, thresholds, bands and labels; callers may override them.
RULES = {
    "mape_above_20": 20, "mape_above_10": 10, "mape_above_5": 5, "non_stationary_adf": 10, "white_noise": 15,
    "outlier_ratio_high": 5, "missing_data": 5, "review_warn": 10, "review_fail": 20, "structural_breaks": 5,
    "recent_holdout_degradation": 10, "holdout_ratio": 1.25, "holdout_stronger": 0.8, "outlier_review": 0.05,
    "high_min": 75, "medium_min": 50, "visual_mape_high": 15.0, "visual_mape_moderate": 10.0,
    "visual_outlier": 0.05, "visual_slope": 0.01,
}
GOOD = {"missing": 0, "duplicates": 0, "gaps": 0, "issues": 0}
FAIR = {"missing": 5, "duplicates": 2, "gaps": 3, "issues": 3}
MAPE_BANDS = ((10.0, "high (MAPE < 10%)"), (20.0, "acceptable (MAPE 10–20%)"), (50.0, "moderate (MAPE 20–50%)"))
MAPE_LAST = "low (MAPE > 50% — treat with caution)"
CONCERNS = {
    "mape": ("mape", "prediction error"), "recent_holdout": ("untouched holdout", "final-test", "final test"),
    "non_stationary": ("non-stationary", "nonstationary"), "white_noise": ("white noise",),
    "outliers": ("outlier", "anomal"), "missing_data": ("missing value", "missing timestamp", "data gap"),
    "structural_breaks": ("structural break", "change point"),
}
PRIORITY = {"fail": ("High", "High", "High"), "warn": ("Medium", "Medium", "Medium"), "pass": ("Medium", "Low", "Low")}


def rules(overrides: dict | None = None) -> dict:
    """Tunable thresholds with their defaults."""
    unknown = set(overrides or {}) - set(RULES)
    if unknown:
        raise ValueError(f"Unknown rules: {sorted(unknown)}")
    return {**RULES, **(overrides or {})}


def holdout_ratio(final_rmse: Column, pooled_rmse: Column) -> Column:
    """Latest holdout error over pooled error; NULL unless both are usable."""
    return F.when(pooled_rmse > 0, final_rmse / pooled_rmse)


def holdout_assessment(ratio: Column, r: dict = RULES) -> Column:
    return (F.when(ratio >= r["holdout_ratio"], "weaker").when(ratio <= r["holdout_stronger"], "stronger")
            .when(ratio.isNotNull(), "consistent"))


def confidence_label(score: Column, r: dict = RULES) -> Column:
    return F.when(score >= r["high_min"], "High").when(score >= r["medium_min"], "Medium").otherwise("Low")


def mape_band(mape: Column) -> Column:
    out = F.when(mape.isNull(), F.lit(None).cast("string"))
    for limit, text in MAPE_BANDS:
        out = out.when(mape < limit, text)
    return out.otherwise(MAPE_LAST)


def quality_rating(missing: Column, duplicates: Column, gaps: Column, issues: Column, regular: Column,
                   outlier_ratio: Column | float = 0.0, r: dict = RULES) -> Column:
    """Good / Fair / Poor; a high outlier ratio caps Good at Fair."""
    within = lambda b: ((missing <= b["missing"]) & (duplicates <= b["duplicates"])
                        & (gaps <= b["gaps"]) & (issues <= b["issues"]))
    ratio = outlier_ratio if isinstance(outlier_ratio, Column) else F.lit(outlier_ratio)
    return (F.when(within(GOOD) & regular, F.when(ratio > r["outlier_review"], "Fair").otherwise("Good"))
            .when(within(FAIR), "Fair").otherwise("Poor"))


def distinct_concern(flags: Column, scored: Column) -> Column:
    """True when some flag raises a topic not scored yet, or none is listed."""
    topics = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(m) for m in v]).alias("m")) for k, v in CONCERNS.items()])

    def fresh(f):
        low = F.lower(f["issue"])
        matched = F.transform(F.filter(topics, lambda t: F.exists(t["m"], lambda m: F.contains(low, m))), lambda t: t["k"])
        return (F.size(matched) == 0) | (F.size(F.array_except(matched, scored)) > 0)

    return (F.size(flags) == 0) | F.exists(flags, fresh)


def confidence(evidence: DataFrame, r: dict = RULES) -> DataFrame:
    """Score from 100 with deductions, its label and the contributing factors.

    Expects: ``mape, final_rmse, rmse, is_stationary_adf, is_white_noise,
    outlier_ratio, missing_values, missing_periods, has_breaks, verdict, flags``.
    """
    c = F.col
    ratio = holdout_ratio(c("final_rmse"), c("rmse"))
    band = F.when(c("mape") > 20, F.lit(r["mape_above_20"])).when(c("mape") > 10, F.lit(r["mape_above_10"])).when(
        c("mape") > 5, F.lit(r["mape_above_5"]))
    parts = [
        ("mape", band, F.format_string("validation error (MAPE %.1f%%)", c("mape"))),
        ("recent_holdout", F.when(ratio >= r["holdout_ratio"], F.lit(r["recent_holdout_degradation"])),
         F.format_string("latest holdout RMSE is %.2fx the pooled RMSE", ratio)),
        ("non_stationary", F.when(~c("is_stationary_adf"), F.lit(r["non_stationary_adf"])), F.lit("series is non-stationary")),
        ("white_noise", F.when(c("is_white_noise"), F.lit(r["white_noise"])), F.lit("series resembles random noise")),
        ("outliers", F.when(c("outlier_ratio") > r["outlier_review"], F.lit(r["outlier_ratio_high"])),
         F.format_string("outlier ratio %.1f%% is above the review threshold", c("outlier_ratio") * 100)),
        ("missing_data", F.when((c("missing_values") > 0) | (c("missing_periods") > 0), F.lit(r["missing_data"])),
         F.lit("missing values or gaps")),
        ("structural_breaks", F.when(c("has_breaks"), F.lit(r["structural_breaks"])), F.lit("candidate change points")),
    ]
    scored = present(*[F.when(cost.isNotNull(), F.lit(key)) for key, cost, _ in parts])
    rows = evidence.withColumn("_scored", scored)
    extra = distinct_concern(c("flags"), c("_scored"))
    review_cost = F.when(c("verdict").isNotNull() & extra, F.when(c("verdict") == "warn", F.lit(r["review_warn"])).when(
        c("verdict") == "fail", F.lit(r["review_fail"])))
    total = sum((F.coalesce(cost, F.lit(0)) for _, cost, _ in parts), F.lit(100) * 0) + F.coalesce(review_cost, F.lit(0))
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - total)).cast("int"))
    factors = present(*[F.when(cost.isNotNull(), text) for _, cost, text in parts],
                      F.when(review_cost.isNotNull(), F.concat(F.lit("review verdict: "), c("verdict"))))
    factors = F.when(F.size(factors) > 0, factors).otherwise(
        F.array(F.lit("low validation error"), F.lit("stable statistical properties")))
    rows = rows.withColumns({"confidence": confidence_label(c("score"), r), "factors": factors})
    return rows.withColumn("explanation_text", F.concat(
        F.lit("Confidence is "), F.lower("confidence"), F.lit(" based on: "),
        F.array_join(F.slice("factors", 1, 2), "; "), F.lit("."))).drop("_scored")


def health_indicators(rows: DataFrame) -> DataFrame:
    """Six indicator rows per series. Expects the confidence columns plus ``quality``."""
    c = F.col
    trend = F.when(c("has_trend") & ~c("is_stationary_adf"), "Changing").otherwise("Stable")
    season = F.when(c("seasonal_period") > 1, "Strong").otherwise("None")
    breaks = F.when(c("has_breaks"), "Monitor").otherwise("None detected")
    bad = (F.coalesce(~c("is_uncorrelated"), F.lit(False)) | F.coalesce(~c("is_normal"), F.lit(False))
           | c("is_white_noise") | F.coalesce(c("mape") > 20, F.lit(False)))
    items = [("Data Quality", c("quality")), ("Trend Stability", trend), ("Seasonality", season),
             ("Forecast Confidence", c("confidence")), ("Structural Breaks", breaks),
             ("Residual Diagnostics", F.when(bad, "Concerning").otherwise("Acceptable"))]
    table = F.array(*[F.struct(F.lit(k).alias("indicator"), v.alias("status")) for k, v in items])
    return rows.select("series_id", F.inline(table))


def path_summary(forecasts: DataFrame) -> DataFrame:
    """First, last, peak and pattern of each forecast path (``series_id, h, ts, yhat``)."""
    packed = forecasts.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("h", "yhat", "ts"))).alias("_p"),
        F.max(F.struct(F.col("yhat").alias("v"), (-F.col("h")).alias("n"), F.col("ts").alias("ts"))).alias("_peak"))
    y = F.transform("_p", lambda p: p["yhat"])
    steps = F.zip_with(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(1))), F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(1))),
                       lambda b, a: b - a)
    tol = F.greatest(F.array_max(F.transform(y, F.abs)) * 1e-9, F.lit(1e-12))
    pattern = (F.when(F.size(y) < 2, "Flat").when(F.forall(steps, lambda s: s >= -tol), "Upward")
               .when(F.forall(steps, lambda s: s <= tol), "Downward").otherwise("Seasonal / variable"))
    first, last, peak = F.element_at(y, 1), F.element_at(y, -1), F.col("_peak.v")
    change = F.when(first != 0, (last - first) / F.abs(first) * 100).otherwise(0.0)
    return packed.select(
        "series_id", F.size("_p").alias("horizon"), first.alias("first_value"), last.alias("last_value"),
        change.alias("pct_change"),
        F.when(change > 0, "Upward").when(change < 0, "Downward").otherwise("Flat").alias("endpoint_direction"),
        pattern.alias("pattern"), peak.alias("peak_value"), F.col("_peak.ts").alias("peak_ts"),
        F.when(first != 0, (peak - first) / F.abs(first) * 100).alias("peak_change_pct"))


def interval_state(forecasts: DataFrame) -> DataFrame:
    """Whether every dated point has finite bounds."""
    ok = F.col("lo").isNotNull() & F.col("hi").isNotNull() & ~F.isnan("lo") & ~F.isnan("hi")
    return forecasts.groupBy("series_id").agg(F.bool_and(ok).alias("bounds_available")).withColumn(
        "interval_label", F.when(F.col("bounds_available"), "prediction_interval").otherwise("unavailable"))


def model_comparison(metrics: DataFrame, chosen: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Rounded metrics per candidate, the selected mark and a rejection reason."""
    rows = metrics.join(chosen.select("series_id", F.col("model").alias("_sel")), "series_id")
    selected = F.col("model") == F.col("_sel")
    base = F.when(F.col("model").isin("Naive", "Seasonal Naive", "Mean Forecast", "Drift"), "Baseline model for comparison.")
    if reasons is not None:
        rows = rows.join(reasons.select("series_id", "model", "reason"), ["series_id", "model"], "left")
        base = F.coalesce(base, F.col("reason"))
    return rows.select(
        "series_id", "model", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 2).alias("mape"),
        F.round(F.col("wape") * 100, 2).alias("wape"), F.round("mase", 4).alias("mase"), selected.alias("selected"),
        F.when(~selected, base).alias("rejected_reason"))


def metric_bars(metrics: DataFrame) -> DataFrame:
    """Long RMSE / MAE / MAPE table for comparison charts."""
    return metrics.unpivot(["series_id", "model"], ["rmse", "mae", "mape"], "metric", "value")


def _collection_issue() -> Column:
    return ((F.col("missing_values") > 0) | (F.col("duplicate_stamps") > 0) | (F.col("missing_periods") > 0)
            | ~F.col("is_regular"))


def recommendations(rows: DataFrame, r: dict = RULES) -> DataFrame:
    """Up to five prioritised recommendations with evidence references."""
    c = F.col
    ratio = holdout_ratio(c("final_rmse"), c("rmse"))
    by_label = lambda p: F.when(c("confidence") == "High", p[0]).when(c("confidence") == "Medium", p[1]).otherwise(p[2])
    priority = F.when(c("verdict") == "fail", by_label(PRIORITY["fail"])).when(
        c("verdict") == "warn", by_label(PRIORITY["warn"])).otherwise(by_label(PRIORITY["pass"]))
    monitor = (F.when(ratio >= r["holdout_ratio"], "monitor_closely").when(c("final_rmse").isNotNull(), "monitor_after_holdout")
               .otherwise("monitor_actuals"))
    ref = lambda name, v: F.struct(F.lit(name).alias("metric"), v.alias("value"))
    rec = lambda cond, p, code, *refs: F.when(cond, F.struct(
        p.alias("priority"), code.alias("recommendation"), F.array(*refs).alias("evidence")))
    items = present(
        rec(F.lit(True), priority, monitor, ref("MAPE", label_or_na(c("mape"), 2)),
            ref("Confidence Score", F.concat(c("score").cast("string"), F.lit("/100"))),
            ref("Holdout ratio", label_or_na(ratio, 2))),
        rec(c("has_breaks"), F.lit("High"), F.lit("validate_breaks"), ref("Change Points", F.lit("candidates"))),
        rec(_collection_issue(), F.lit("Medium"), F.lit("improve_collection"), ref("Data Quality Rating", c("quality"))),
        rec(c("seasonal_period") > 1, F.lit("Medium"), F.lit("plan_seasonal_capacity"),
            ref("Seasonal Period", c("seasonal_period").cast("string"))),
        rec(F.lit(True), F.lit("Low"), F.lit("re_estimate_rolling"), ref("Model", c("model"))),
    )
    return rows.select("series_id", F.posexplode(items).alias("pos", "_i")).select("series_id", "pos", "_i.*")


def risks(rows: DataFrame) -> DataFrame:
    """Up to five risks with severity and evidence."""
    c = F.col
    risk = lambda cond, cat, code, sev, *ev: F.when(cond, F.struct(
        F.lit(cat).alias("category"), F.lit(code).alias("risk"), sev.alias("severity"), F.array(*ev).alias("evidence")))
    items = present(
        risk(c("mape") > 20, "Model", "high_error", F.lit("High"), F.concat(F.lit("MAPE "), label_or_na(c("mape"), 2)),
             F.concat(F.lit("RMSE "), label_or_na(c("rmse")))),
        risk(c("has_breaks"), "Data", "structural_break", F.lit("Medium"), F.lit("candidate change points")),
        risk(c("quality") == "Poor", "Data", "poor_quality", F.lit("High"), F.concat(F.lit("missing values "), c("missing_values").cast("string"))),
        risk(c("verdict").isin("warn", "fail"), "Model", "review_concern", F.when(c("verdict") == "fail", "High").otherwise("Medium"),
             F.concat(F.size("flags").cast("string"), F.lit(" flag(s)"))),
        risk(F.lit(True), "Model", "horizon_decay", F.lit("Low"), F.lit("distance from the last observation")),
    )
    return rows.select("series_id", F.posexplode(items).alias("pos", "_i")).select("series_id", "pos", "_i.*")


def dashboard(rows: DataFrame, r: dict = RULES) -> DataFrame:
    """Seven widgets. Expects the scored evidence joined with the path summary."""
    c = F.col
    ratio = holdout_ratio(c("final_rmse"), c("rmse"))
    weak = F.coalesce(ratio >= r["holdout_ratio"], F.lit(False))
    status3 = lambda col, a, b: F.when(col == a, "positive").when(col == b, "warning").otherwise("negative")
    growth = F.when(c("pct_change") > 0, "positive").when(c("pct_change") < 0, "negative").otherwise("neutral")
    pattern = F.when(c("pattern") == "Upward", "positive").when(c("pattern") == "Downward", "negative").when(
        c("pattern") == "Flat", "neutral").otherwise("info")
    hit = lambda v, s: F.struct(F.lit(v).alias("v"), F.lit(s).alias("s"))
    risk = (F.when(c("verdict") == "fail", hit("critical_review", "negative"))
            .when(c("quality") == "Poor", hit("poor_quality", "negative"))
            .when(c("mape") > 20, hit("high_error", "warning")).when(c("has_breaks"), hit("structural_break", "warning"))
            .otherwise(hit("horizon_decay", "neutral")))
    audit = c("verdict").isin("warn", "fail")
    action = (F.when(audit & weak, hit("review_audit_monitor_closely", "warning")).when(audit, hit("review_audit", "warning"))
              .when(weak, hit("monitor_closely", "warning"))
              .when((c("quality") != "Good") & _collection_issue(), hit("improve_collection", "warning"))
              .when((c("quality") != "Good") & (c("outlier_count") > 0), hit("review_anomalies", "warning"))
              .when(c("quality") != "Good", hit("review_quality", "warning"))
              .otherwise(hit("use_near_term", "positive")))
    widget = lambda title, value, status: F.struct(F.lit(title).alias("title"), value.alias("value"), status.alias("status"))
    table = F.array(
        widget("Forecast Pattern", c("pattern"), pattern),
        widget("Forecast Endpoint Change", F.format_string("%+.1f%%", c("pct_change")), growth),
        widget("Forecast Confidence", F.format_string("%d/100 — %s", c("score"), c("confidence")), status3(c("confidence"), "High", "Medium")),
        widget("Data Quality", c("quality"), status3(c("quality"), "Good", "Fair")),
        widget("Model Selected", c("model"), F.lit("info")),
        widget("Primary Risk", risk["v"], risk["s"]), widget("Recommended Action", action["v"], action["s"]))
    return rows.select("series_id", F.posexplode(table).alias("_i", "_w")).select(
        "series_id", (F.col("_i") + 1).alias("priority"), "_w.*")


def visual_strategy(rows: DataFrame, r: dict = RULES) -> DataFrame:
    """Recommended charts by thresholds. Expects ``interval_label`` and ``model``."""
    c = F.col
    on = lambda cond, name: F.when(cond, name)
    band = (F.when(c("interval_label") == "unavailable", "Forecast Error Monitoring")
            .when(c("interval_label") == "experimental", "Estimated 95% Prediction Intervals (coverage not evaluated)")
            .otherwise("Model-Based 95% Prediction Intervals"))
    charts = present(
        on(c("seasonal_period") > 1, F.lit("STL Decomposition")), on(c("mape") > r["visual_mape_high"], band),
        on(c("model") == "SARIMA", F.lit("ACF/PACF")), on(c("outlier_ratio") > r["visual_outlier"], F.lit("Box Plot")),
        on(c("has_trend") & (F.abs("trend_slope") > r["visual_slope"]), F.lit("Trend Analysis")),
        on(c("mape") > r["visual_mape_moderate"], F.lit("Forecast Error Plot")), F.lit("Histogram"))
    return rows.select("series_id", F.posexplode(charts).alias("pos", "chart"))


def assumptions(rows: DataFrame) -> DataFrame:
    """Five assumption rows per series."""
    low = F.lower("model")
    stability = (F.when(low.isin("holt-winters", "holt winters", "ewma"), "level_trend_season_stable")
                 .when(low.isin("arima", "sarima"), "differenced_dependence_stable")
                 .when(F.col("is_stationary_adf") & F.col("is_stationary_kpss"), "observed_structure_stable")
                 .otherwise("historical_pattern_stable"))
    season = F.when(F.col("seasonal_period") > 1, F.format_string("cycle_of_%d_continues", F.col("seasonal_period"))).otherwise(
        "no_seasonality")
    items = F.array(F.lit("past_drivers_persist"), stability, season,
                    F.concat(F.lit("frequency_stays_"), F.coalesce(F.col("frequency"), F.lit("unknown"))),
                    F.lit("no_external_variables"))
    return rows.select("series_id", F.posexplode(items).alias("pos", "assumption"))


def preference(seasonal: Column, has_trend: Column, slope: Column, noise: Column) -> Column:
    """Heuristic order of model families from the statistics."""
    order = lambda *names: F.array(*[F.lit(n) for n in names])
    return (F.when(seasonal > 1, order("SARIMA", "Holt-Winters", "ARIMA", "EWMA"))
            .when(has_trend & (F.abs(slope) > 0.1), order("Holt-Winters", "ARIMA", "SARIMA", "EWMA"))
            .when(noise, order("EWMA", "ARIMA", "Holt-Winters", "SARIMA"))
            .otherwise(order("ARIMA", "Holt-Winters", "SARIMA", "EWMA")))


def preferred_without(order: Column, excluded: Column) -> Column:
    """First preference that is not excluded; the original one when all are."""
    rest = F.filter(order, lambda m: F.coalesce(m != excluded, F.lit(True)))
    return F.coalesce(F.get(rest, F.lit(0)), F.get(order, F.lit(0)))


def suitability(rows: DataFrame) -> DataFrame:
    """Assessment points per model family as long rows."""
    c = F.col
    seasonal, trend, moving = c("seasonal_period") > 1, c("has_trend"), ~c("is_stationary_adf")
    pick = lambda cond, yes, no=None: F.when(cond, yes).otherwise(F.lit(no).cast("string"))
    points = {
        "Holt-Winters": present(pick(seasonal, "models_seasonality", "seasonal_part_unneeded"),
                                pick(trend, "models_trend", "simple_smoothing_may_do"), pick(moving, "needs_no_differencing"),
                                F.lit("robust_on_short_series")),
        "ARIMA": present(pick(seasonal, "ignores_seasonality", "suits_non_seasonal"),
                         pick(moving, "differences_non_stationary", "no_difference_needed"), pick(trend, "differencing_removes_trend"),
                         F.lit("models_autocorrelation")),
        "SARIMA": present(pick(seasonal, "models_seasonality", "would_overfit"), pick(seasonal, "standard_for_seasonal"),
                          pick(moving, "seasonal_differencing"), F.lit("needs_two_cycles")),
        "EWMA": present(pick(trend, "lags_trend", "suits_stable_series"),
                        pick(c("outlier_ratio") > 0.05, "sensitive_to_outliers", "few_outliers"),
                        pick(c("is_white_noise"), "as_good_on_noise"), F.lit("short_term"), F.lit("fast")),
    }
    table = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("points")) for m, p in points.items()])
    return rows.select("series_id", F.inline(table)).select("series_id", "model", F.posexplode("points").alias("pos", "point"))


def metric_text(name: str, v: Column) -> Column:
    """``WAPE`` is shown in percent; unavailable values get the standard phrase."""
    if name == "wape":
        shown = F.format_string("WAPE %.2f%%", v * 100)
    elif name == "mape":
        shown = F.format_string("MAPE %.2f%%", v)
    else:
        shown = F.format_string(f"{name.upper()} %.4f", v)
    return F.when(v.isNotNull(), shown).otherwise(f"{name.upper()} not available")


def metric_lines(metrics: DataFrame) -> DataFrame:
    """One text line of metrics per candidate."""
    order = ("mase", "wape", "rmse", "mae", "mape")
    return metrics.select("series_id", "model", F.concat_ws(", ", *[metric_text(m, F.col(m)) for m in order]).alias("line"))


def rejection_reasons(metrics: DataFrame, chosen: DataFrame) -> DataFrame:
    """Why each other candidate was not chosen, by its first available metric."""
    order = ("mase", "wape", "rmse", "mae", "mape")
    first = F.coalesce(*[F.when(F.col(m).isNotNull(), F.struct(
        F.lit(m).alias("m"), F.col(m).alias("v"), metric_text(m, F.col(m)).alias("s"))) for m in order])
    rows = metrics.select("series_id", "model", first.alias("own"))
    best = chosen.select("series_id", F.col("model").alias("_sel"))
    ref = rows.join(best, "series_id").filter(F.col("model") == F.col("_sel")).select("series_id", "_sel", F.col("own").alias("ref"))
    pairs = rows.join(ref, "series_id").filter(F.col("model") != F.col("_sel"))
    o, s = F.col("own"), F.col("ref")
    return pairs.select(
        "series_id", "model",
        F.when((o["m"] == s["m"]) & (o["v"] > s["v"]), F.concat(F.lit("higher_error: "), o["s"], F.lit(" versus "), s["s"]))
        .when(o["m"] == s["m"], "competitive_but_weaker_choice")
        .when(o.isNotNull() & s.isNotNull(), F.concat(F.lit("less_favorable: "), o["s"], F.lit(" compared with "), s["s"]))
        .alias("reason"))


def narratives(rows: DataFrame) -> DataFrame:
    """Deterministic section sentences used when no other text exists."""
    c = F.col
    items = {
        "reliability": F.concat_ws(" ", c("explanation_text"), F.concat(F.lit("Metrics: "), metric_text("rmse", c("rmse")),
                                                                       F.lit(", "), metric_text("mape", c("mape")), F.lit("."))),
        "data_quality": F.format_string("Data quality is %s with %d missing values, %d duplicates and %d gaps.",
                                        F.lower("quality"), c("missing_values"), c("duplicate_stamps"), c("missing_periods")),
        "outlook": F.format_string("%s projects a %s path.", c("model"), F.lower("pattern")),
    }
    table = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("text")) for k, v in items.items()])
    return rows.select("series_id", F.inline(table))


def statistical_audit(rows: DataFrame) -> DataFrame:
    """Verdict, concerns (critical and warning issues) and follow-ups per series."""
    concerns = F.transform(F.filter("flags", lambda f: f["severity"].isin("critical", "warning")), lambda f: f["issue"])
    follow = F.transform(F.filter("flags", lambda f: F.length(f["recommendation"]) > 0), lambda f: f["recommendation"])
    default = F.array(F.lit("Monitor forecast performance against future actuals."))
    return rows.select("series_id", "verdict", concerns.alias("key_concerns"),
                       F.when(F.size(follow) > 0, follow).otherwise(default).alias("follow_up"))


def explainability(rows: DataFrame) -> DataFrame:
    """Findings with their evidence, long form."""
    c = F.col
    item = lambda cond, code, evid: F.when(cond, F.struct(F.lit(code).alias("finding"), evid.alias("evidence")))
    items = present(
        item(c("seasonal_period") > 1, "seasonal_pattern", F.format_string("Seasonal period: %d", c("seasonal_period"))),
        item(c("has_trend") & (c("trend_slope") > 0), "upward_trend", F.format_string("Trend slope: %.6f", c("trend_slope"))),
        item(c("has_trend") & (c("trend_slope") <= 0), "downward_trend", F.format_string("Trend slope: %.6f", c("trend_slope"))),
        item(c("mape") < 10, "low_validation_error", F.format_string("MAPE: %.2f%%", c("mape"))),
        item(c("is_uncorrelated"), "residuals_acceptable", F.lit("no significant autocorrelation")),
        item(~c("is_uncorrelated"), "residuals_need_monitoring", F.concat(F.lit("Ljung-Box p: "), label_or_na(c("ljung_box_p")))),
        item(F.lit(True), "confidence", F.format_string("Confidence score: %d/100", c("score"))),
    )
    return rows.select("series_id", F.posexplode(items).alias("pos", "_i")).select("series_id", "pos", "_i.*")


def executive_summary(rows: DataFrame, r: dict = RULES) -> DataFrame:
    """Outlook, growth, confidence, primary risk and action codes. Expects scored evidence with the path summary."""
    c = F.col
    weak = F.coalesce(holdout_ratio(c("final_rmse"), c("rmse")) >= r["holdout_ratio"], F.lit(False))
    risk = (F.when(c("verdict") == "fail", "critical_review").when(c("quality") == "Poor", "poor_quality")
            .when(c("mape") > 20, "high_error").otherwise("horizon_decay"))
    action = (F.when(weak, "monitor_closely").when(c("verdict").isin("warn", "fail"), "review_audit").otherwise("use_near_term"))
    return rows.select(
        "series_id", F.lower("pattern").alias("outlook"), F.format_string("%+.1f%%", c("pct_change")).alias("expected_growth"),
        F.format_string("%d/100 — %s", c("score"), c("confidence")).alias("confidence_level"),
        risk.alias("primary_risk"), action.alias("recommended_action"))


def report_metadata(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Provenance of a report: models evaluated, choice, frequency, quality and size."""
    seen = models.groupBy("series_id").agg(F.array_sort(F.collect_set("model")).alias("models_evaluated"))
    return rows.join(seen, "series_id").select(
        "series_id", "models_evaluated", F.col("model").alias("selected_model"),
        F.coalesce("frequency", F.lit("unknown")).alias("dataset_frequency"), F.col("quality").alias("data_quality_rating"), "row_count")


def appendix(rows: DataFrame) -> DataFrame:
    """Raw metrics map; unavailable values stay NULL."""
    names = {"rmse": 4, "mae": 4, "mape": 2, "trend_slope": 6, "outlier_ratio": 4, "final_rmse": 4}
    pairs = [x for k, d in names.items() for x in (F.lit(k), F.round(F.col(k), d))]
    return rows.select("series_id", F.create_map(*pairs).alias("raw_metrics"))
