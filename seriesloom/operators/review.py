"""Review rules: each rule is one nullable struct column over a one-row-per-series evidence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.guards import label_or_na
from seriesloom.operators.quality import present

# Model families, thresholds and labels of the rules.
FAMILIES = ("ARIMA", "SARIMA", "Holt-Winters", "EWMA")
HIGH_MAPE = 20.0
OUTLIER_RATIO = 0.05
RMSE_RATIO = 1.5
FLAG_TYPE = "array<struct<agent:string,severity:string,issue:string,recommendation:string>>"


def _flag(cond: Column, agent: str, severity: str, issue: Column, advice: str) -> Column:
    return F.when(cond, F.struct(
        F.lit(agent).alias("agent"), F.lit(severity).alias("severity"), issue.alias("issue"),
        F.lit(advice).alias("recommendation")))


def _false(flag: str) -> Column:
    """True only for a test that ran and failed; NULL means not tested."""
    return F.coalesce(~F.col(flag), F.lit(False))


def explanation_mismatch(explanation: Column, model: Column) -> Column:
    """First other family named early in the text while the chosen one is not."""
    head = F.lower(F.left(explanation, F.lit(200)))
    others = F.filter(F.array(*[F.lit(m) for m in FAMILIES]),
                      lambda m: (m != model) & F.contains(head, F.lower(m)))
    return F.when((F.size(others) > 0) & ~F.contains(head, F.lower(model)), F.get(others, F.lit(0)))


def rule_flags() -> Column:
    """All rules as an array column.

    Expects: ``model, selection_method, explanation, seasonal_period,
    is_stationary_adf, has_trend, trend_slope, outlier_ratio, remediation,
    mape, rmse, best_rmse, best_model, is_uncorrelated, ljung_box_p, is_normal,
    shapiro_p, is_zero_mean, residual_mean``.
    """
    c = F.col
    ratio = F.when((c("best_model") != c("model")) & (c("best_rmse") > 0), c("rmse") / c("best_rmse"))
    bad_ratio = F.coalesce(ratio > RMSE_RATIO, F.lit(False))
    policy = c("selection_method") == "deterministic"
    other = explanation_mismatch(c("explanation"), c("model"))
    rmse_text = lambda head: F.format_string(
        head + " %s has RMSE %.4f, %.1fx the best candidate %s (%.4f).",
        c("model"), c("rmse"), ratio, c("best_model"), c("best_rmse"))
    return present(
        _flag((c("seasonal_period") > 1) & (c("model") == "ARIMA"), "model_selection", "critical",
              F.format_string("Seasonal period %d was found but ARIMA was selected.", c("seasonal_period")),
              "Prefer a seasonal model."),
        _flag(~c("is_stationary_adf") & (c("model") == "EWMA"), "model_selection", "critical",
              F.lit("The series is non-stationary but EWMA was selected."), "Prefer a differencing model."),
        _flag(c("mape") > HIGH_MAPE, "forecasting", "warning",
              F.format_string("Forecast MAPE is %.2f%%: prediction error is high.", c("mape")),
              "Check model adequacy and data transformations."),
        _flag((c("outlier_ratio") > OUTLIER_RATIO) & (F.size("remediation") == 0), "statistical", "warning",
              F.format_string("Outlier ratio is %.1f%% and no remediation was chosen.", c("outlier_ratio") * 100),
              "Consider clipping or a robust transform."),
        _flag(c("has_trend") & (c("model") == "EWMA"), "model_selection", "warning",
              F.format_string("A trend (slope %.4f) is present but EWMA was selected.", c("trend_slope")),
              "Prefer a model with a trend component."),
        _flag(other.isNotNull(), "model_selection", "critical",
              F.format_string("The explanation names %s while %s was selected.", other, c("model")),
              "Repeat the selection."),
        _flag(~policy & bad_ratio, "model_selection", "critical", rmse_text("Chosen model"), "Re-evaluate the selection."),
        _flag(policy & bad_ratio, "model_selection", "critical", rmse_text("Policy choice"),
              "Check the exclusion reasons of the best candidate."),
        _flag(_false("is_uncorrelated"), "forecasting", "warning",
              F.concat(F.lit("Model residuals are autocorrelated (Ljung-Box p "), label_or_na(c("ljung_box_p")), F.lit(").")),
              "Compare residuals of viable alternatives."),
        _flag(_false("is_normal"), "forecasting", "warning",
              F.concat(F.lit("Model residuals are not normal (Shapiro-Wilk p "), label_or_na(c("shapiro_p")), F.lit(").")),
              "Treat prediction intervals with caution."),
        _flag(_false("is_zero_mean"), "forecasting", "warning",
              F.format_string("Model residuals have a non-zero mean (%.4f).", c("residual_mean")),
              "The forecast may be biased."),
    )


def flag_key(issue: Column) -> Column:
    """Topic key used to recognise the same concern in different words."""
    low = F.lower(issue)
    has = lambda s: F.contains(low, F.lit(s))
    return (
        F.when(has("residual") & (has("autocorrel") | has("ljung-box")), "residual_autocorrelation")
        .when(has("change point") | has("structural break"), "change_points")
        .when(has("outlier"), "outliers")
        .otherwise(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")))
    )


def merge_flags(rules: Column, parsed: Column) -> Column:
    """Rule flags first; a parsed flag is added only when its topic is new."""
    empty = F.array().cast(FLAG_TYPE)

    def add(acc, f):
        seen = F.exists(acc, lambda a: flag_key(a["issue"]) == flag_key(f["issue"]))
        return F.when(seen, acc).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(F.coalesce(parsed, empty), F.coalesce(rules, empty).cast(FLAG_TYPE), add)


def override_reasons(flags: Column) -> Column:
    """Critical selection or forecasting issues: what may override the policy."""
    hits = F.filter(flags, lambda f: (f["severity"] == "critical") & f["agent"].isin("model_selection", "forecasting"))
    return F.transform(hits, lambda f: f["issue"])


def override_allowed(method: Column, flags: Column) -> Column:
    return (method != "deterministic") | (F.size(override_reasons(flags)) > 0)


def final_verdict(base: Column, rules: Column) -> Column:
    """A critical rule lifts ``pass`` to ``warn``; other verdicts stand."""
    critical = F.exists(rules, lambda f: f["severity"] == "critical")
    return F.when(critical & (base == "pass"), "warn").otherwise(base)


def parse_verdict(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, r"(?i)Verdict:\s*(PASS|WARN|FAIL)", 1))
    return F.when(found != "", found).otherwise("warn")


_FLAG = (r"(?i)-\s*\[(CRITICAL|WARNING|INFO)\]\s*\[agent:\s*(statistical|model_selection|forecasting)\]"
         r"\s*(.*?)\s*\|\s*Recommendation:\s*(.*)")


def parse_flags(text: Column) -> Column:
    """Flag lines of a review text; ``none`` entries are skipped."""
    whole = F.regexp_extract_all(text, F.lit(_FLAG), F.lit(0))
    part = lambda s, i: F.trim(F.regexp_extract(s, _FLAG, i))
    rows = F.transform(whole, lambda s: F.struct(
        F.lower(part(s, 2)).alias("agent"), F.lower(part(s, 1)).alias("severity"),
        part(s, 3).alias("issue"), part(s, 4).alias("recommendation")))
    return F.filter(rows, lambda f: F.lower(f["issue"]) != "none")


def _section(text: Column, name: str) -> Column:
    """Body between a heading and the next one; NULL without the heading."""
    body = F.regexp_extract(text, rf"(?is)## {name}\s*\n(.*)", 1)
    cut = F.regexp_replace(body, r"(?s)##\s.*", "")
    return F.when(text.rlike(rf"(?is)## {name}\s*\n"), cut)


def parse_endorsements(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(_section(text, "Endorsements"), F.lit("")), r"\r?\n"), F.trim)
    kept = F.filter(lines, lambda s: s.startswith("- ") & (F.lower(s) != "- none"))
    return F.transform(kept, lambda s: F.trim(F.substring(s, F.lit(3), F.char_length(s))))


def parse_summary(text: Column) -> Column:
    body = _section(text, "Summary")
    stripped = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.coalesce(stripped, F.lit("Statistical review completed."))


def review(evidence: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Flags, verdict and override decision per series; ``texts`` are optional review texts."""
    rows = evidence.withColumn("_rules", rule_flags().cast(FLAG_TYPE))
    if texts is not None:
        rows = rows.join(texts.select("series_id", F.col("text").alias("_text")), "series_id", "left")
        parsed = F.when(F.col("_text").isNotNull(), parse_flags(F.col("_text")))
        base = F.when(F.col("_text").isNotNull(), parse_verdict(F.col("_text"))).otherwise("pass")
    else:
        parsed, base = F.array().cast(FLAG_TYPE), F.lit("pass")
    rows = rows.withColumn("flags", merge_flags(F.col("_rules"), parsed)).withColumn(
        "verdict", final_verdict(base, F.col("_rules")))
    return rows.withColumn("override_allowed", override_allowed(F.col("selection_method"), F.col("_rules"))).withColumn(
        "override_reasons", override_reasons(F.col("_rules"))).drop("_rules", "_text")


def flag_rows(reviewed: DataFrame) -> DataFrame:
    """One row per flag."""
    return reviewed.select("series_id", F.inline("flags"))
