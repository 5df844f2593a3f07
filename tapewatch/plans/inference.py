"""Bars in, detections out: one plan for tables, batches and micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.operators.features import complete_rows, history_features, latest_features
from tapewatch.operators.labels import is_suspicious, risk_level
from tapewatch.operators.lookups import error_rows, latest_for_requests
from tapewatch.operators.scaling import Scaler
from tapewatch.operators.scoring import closed_form_scores, detections, training_ensemble
from tapewatch.operators.series import lay_out
from tapewatch.operators.single_point import features_by_mode, missing_features, simple_features
from tapewatch.schema import FEATURES, STORED_PARAMETERS

RESULT = (
    "symbol", "ensemble_score", "classifier_probability", "anomaly_score", "is_suspicious",
    "risk_level", "alerts")


def score_features(features: DataFrame, scaler: Scaler, model=closed_form_scores, **options) -> DataFrame:
    """Detections of ready feature rows."""
    return detections(model(scaler.transform(features)), **options)


def score_history(bars: DataFrame, scaler: Scaler, max_rows: int | None = None, **options) -> DataFrame:
    """Detections of every bar with complete features."""
    rows = complete_rows(history_features(lay_out(bars, max_rows)).rows())
    return score_features(rows.dropna(subset=list(FEATURES)), scaler, **options)


def score(
    bars: DataFrame, scaler: Scaler, mode: str = "latest", max_rows: int | None = None, **options
) -> DataFrame:
    """Detections for the mode of the caller.

    ``latest`` takes full features of each symbol's last bar; ``simple`` treats
    every bar as having no history; ``single`` and ``batch`` choose by the number
    of bars a symbol has.
    """
    if mode == "latest":
        features = latest_features(history_features(lay_out(bars, max_rows)))
    elif mode == "simple":
        features = simple_features(bars)
    elif mode in ("single", "batch"):
        features = features_by_mode(bars, mode == "batch", max_rows)
    else:
        raise ValueError("mode must be 'latest', 'simple', 'single' or 'batch'")
    return score_features(features, scaler, **options)


def score_requests(requests: DataFrame, detected: DataFrame, message: Column | None = None) -> DataFrame:
    """One result per requested symbol: its detection or an error row."""
    found = latest_for_requests(requests, detected)
    good = found.filter(F.col("error").isNull()).select(*RESULT)
    bad = error_rows(found.filter(F.col("error").isNotNull()), F.col("error") if message is None else message)
    return good.unionByName(bad)


def batch_summary(results: DataFrame) -> DataFrame:
    """Processed and failed counts of a request batch."""
    failed = F.col("risk_level") == "ERROR"
    return results.agg(
        F.count_if(~failed).alias("processed_count"), F.count_if(failed).alias("failed_count"))


def batch_errors(results: DataFrame) -> DataFrame:
    """One row per failed symbol with its message."""
    return results.filter(F.col("risk_level") == "ERROR").select(
        "symbol", F.col("alerts")[0].alias("message"))


def score_given(requests: DataFrame, given: str, scaler: Scaler, model=closed_form_scores) -> DataFrame:
    """Score feature dictionaries; a row that lacks a feature gets an error."""
    rows = requests.withColumns({
        "missing": missing_features(given),
        **{c: F.try_element_at(given, F.lit(c)) for c in FEATURES}})
    scored = detections_only(model(scaler.transform(rows)))
    complete = F.size("missing") == 0
    return scored.withColumns({
        **{c: F.when(complete, F.col(c)) for c in (
            "ensemble_score", "anomaly_score", "classifier_probability", "is_suspicious", "risk_level")},
        "error": F.when(~complete, F.concat(F.lit("Missing features: "), F.concat_ws(", ", "missing")))})


def detections_only(scored: DataFrame) -> DataFrame:
    """Ensemble, flag and risk by the training form, keeping the input columns."""
    threshold = F.lit(STORED_PARAMETERS["autoencoder_f1_threshold"])
    df = scored.withColumns({
        "ensemble_score": training_ensemble(F.col("error"), F.col("classifier_probability"), threshold),
        "anomaly_score": (F.col("error") > threshold).cast("int")})
    return df.withColumns({
        "is_suspicious": is_suspicious(F.col("ensemble_score")),
        "risk_level": risk_level(F.col("ensemble_score"))})
