"""Scores of a standardised feature row and the detection built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.functions.expr import clamp, computed_once, ratio
from tapewatch.operators.features import market_data
from tapewatch.operators.labels import SUSPICIOUS, is_suspicious, risk_level, with_alerts
from tapewatch.schema import FEATURES, STORED_PARAMETERS

# Closed-form scorer: reconstruction from two fixed orthonormal directions and a
# logistic of four standardised features.  It needs no training.
LOGIT_INTERCEPT = -3.0
LOGIT_WEIGHTS = {"Volume_Ratio": 1.2, "Volatility_10d": 0.6, "Price_Range": 0.4, "BB_Position": 0.2}

# Weights of the training form.
TRAINING_AE_WEIGHT, TRAINING_CLF_WEIGHT = 0.4, 0.6


def _total(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def closed_form_scores(df: DataFrame) -> DataFrame:
    """Add ``error`` and ``classifier_probability`` from the ``z_`` columns."""
    z = [F.col(f"z_{c}") for c in FEATURES]
    # The directions are orthonormal, so the residual is the norm less both projections.
    flat = _total(z)
    comb = _total([v if i % 2 == 0 else -v for i, v in enumerate(z)])
    df = df.withColumns({"_norm": _total([v * v for v in z]), "_flat": flat, "_comb": comb})
    n = len(z)
    residual = F.col("_norm") - (F.col("_flat") * F.col("_flat") + F.col("_comb") * F.col("_comb")) / n
    logit = F.lit(LOGIT_INTERCEPT) + _total([F.lit(w) * F.col(f"z_{c}") for c, w in LOGIT_WEIGHTS.items()])
    scored = computed_once(df, error=residual / n, classifier_probability=1 / (1 + F.exp(-logit)))
    return scored.drop("_norm", "_flat", "_comb")


def training_ensemble(error: Column, probability: Column, threshold: Column) -> Column:
    """Weighted sum of the anomaly flag and the probability."""
    anomalous = (error > threshold).cast("double")
    return TRAINING_AE_WEIGHT * anomalous + TRAINING_CLF_WEIGHT * probability


def normalised_error(error: Column, low: Column, high: Column) -> Column:
    return clamp(ratio(error - low, high - low), 0, 1)


def scoring_ensemble(error: Column, probability: Column, parameters: dict[str, float] = STORED_PARAMETERS) -> Column:
    """Weighted sum of the error, normalised and clipped, and the probability."""
    scaled = normalised_error(
        error, F.lit(parameters["reconstruction_error_min"]), F.lit(parameters["reconstruction_error_max"]))
    return parameters["best_ensemble_ae_weight"] * scaled + (
        parameters["best_ensemble_clf_weight"] * probability)


def anomaly_flag(error: Column, parameters: dict[str, float], mode: str) -> Column:
    """1 for an anomalous row.

    ``threshold`` compares the error itself; ``normalized`` truncates the clipped
    error, so only an error at the top of the stored range counts.
    """
    if mode == "threshold":
        return (error > parameters["autoencoder_f1_threshold"]).cast("int")
    if mode == "normalized":
        return normalised_error(
            error, F.lit(parameters["reconstruction_error_min"]),
            F.lit(parameters["reconstruction_error_max"])).cast("int")
    raise ValueError("mode must be 'threshold' or 'normalized'")


def detections(
    scored: DataFrame,
    parameters: dict[str, float] = STORED_PARAMETERS,
    anomaly_mode: str = "threshold",
    threshold: float = SUSPICIOUS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Ensemble, flags, risk and alerts for rows with error and probability; ``keep`` names further columns."""
    error, probability = F.col("error"), F.col("classifier_probability")
    df = computed_once(
        scored,
        ensemble_score=scoring_ensemble(error, probability, parameters),
        anomaly_score=anomaly_flag(error, parameters, anomaly_mode))
    df = with_alerts(df.withColumns({
        "is_suspicious": is_suspicious(F.col("ensemble_score"), threshold),
        "risk_level": risk_level(F.col("ensemble_score"))}))
    return df.select(
        *keep, "symbol", F.unix_seconds("ts").alias("timestamp"), "ensemble_score", "classifier_probability",
        "anomaly_score", "is_suspicious", "risk_level", market_data().alias("market_data"),
        "alerts", "alert_codes")

