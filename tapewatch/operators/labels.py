"""Rule labels, risk levels and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.functions.expr import finite, flag

# ---------------------------------------------------------------- fixed values
# Thresholds of labels, risk levels and alerts, and the wording of alerts.
HIGH_RISK, MEDIUM_RISK, SUSPICIOUS = 0.7, 0.3, 0.5
VOLUME_HIGH, VOLUME_EXTREME, VOLUME_LOW = 3.0, 5.0, 0.1
LARGE_MOVE, MANIPULATED_MOVE, LARGE_GAP = 0.05, 0.03, 0.02
BAND_UPPER, BAND_LOWER = 0.95, 0.05
OPENING_HOUR, CLOSING_HOUR = 9, 16
OVERBOUGHT, OVERSOLD, VOLATILE = 80.0, 20.0, 0.05
SCORE_HIGH, SCORE_MEDIUM, CLASSIFIER_SURE = 0.8, 0.6, 0.9
TEXTS = {
    "VOLUME_EXTREME": "Extremely high volume: %.2fx normal",
    "VOLUME_HIGH": "High volume detected: %.2fx normal",
    "VOLUME_LOW": "Unusually low volume: %.2fx normal",
    "PRICE_MOVE": "Large price %s: %.2f%%",
    "OVERBOUGHT": "Overbought condition (RSI: %.1f)",
    "OVERSOLD": "Oversold condition (RSI: %.1f)",
    "BAND_UPPER": "Price near upper Bollinger Band (potential reversal)",
    "BAND_LOWER": "Price near lower Bollinger Band (potential reversal)",
    "VOLATILE": "High volatility detected: %.2f%%",
    "GAP": "Gap %s: %.2f%%",
    "RISK_HIGH": "HIGH RISK: Multiple fraud indicators detected",
    "RISK_MEDIUM": "MEDIUM RISK: Suspicious trading pattern",
    "ANOMALY": "Anomaly detected: Trading pattern deviates from normal",
    "CLASSIFIER": "Classifier: Very high probability of suspicious activity",
}
# ------------------------------------------------------------ end fixed values


def rule_labels(df: DataFrame) -> DataFrame:
    """Synthetic labels of a feature row; an unknown feature, NaN and infinite ones included, never matches."""
    volume, move = finite(F.col("Volume_Ratio")), F.abs(finite(F.col("Price_Change")))
    unusual = (volume > VOLUME_HIGH) | (volume < VOLUME_LOW)
    extreme = move > LARGE_MOVE
    manipulated = (
        (volume > VOLUME_EXTREME) & (move > MANIPULATED_MOVE) & (finite(F.col("BB_Position")) > BAND_UPPER))
    return df.withColumns({
        "Unusual_Volume": flag(unusual),
        "Extreme_Price_Move": flag(extreme),
        "Gap_Trading": flag(F.abs(finite(F.col("Gap"))) > LARGE_GAP),
        "After_Hours_Activity": flag((F.col("Hour") < OPENING_HOUR) | (F.col("Hour") > CLOSING_HOUR)),
        "Suspicious_Activity": flag(unusual & extreme),
        "Potential_Manipulation": flag(manipulated),
        "Target": flag((unusual & extreme) | manipulated),
    })


def is_suspicious(score: Column, threshold: float = SUSPICIOUS) -> Column:
    return score > threshold


def risk_level(score: Column) -> Column:
    return F.when(score > HIGH_RISK, "HIGH").when(score > MEDIUM_RISK, "MEDIUM").otherwise("LOW")


def _alert_rules() -> list[list[tuple[Column, str, Column]]]:
    """Groups of (condition, code, text) in order; in a group the first true condition wins."""
    volume, move, rsi, position, shaky, gap, score, anomaly, classifier = (finite(F.col(c)) for c in (
        "Volume_Ratio", "Price_Change", "RSI", "BB_Position", "Volatility_10d", "Gap",
        "ensemble_score", "anomaly_score", "classifier_probability"))

    def rule(condition: Column, code: str, *values: Column) -> tuple[Column, str, Column]:
        return condition, code, F.format_string(TEXTS[code], *values) if values else F.lit(TEXTS[code])

    return [
        [rule(volume > VOLUME_EXTREME, "VOLUME_EXTREME", volume),
         rule(volume > VOLUME_HIGH, "VOLUME_HIGH", volume),
         rule(volume < VOLUME_LOW, "VOLUME_LOW", volume)],
        [rule(F.abs(move) > LARGE_MOVE, "PRICE_MOVE",
              F.when(move > 0, "increase").otherwise("decrease"), F.abs(move) * 100)],
        [rule(rsi > OVERBOUGHT, "OVERBOUGHT", rsi), rule(rsi < OVERSOLD, "OVERSOLD", rsi)],
        [rule(position > BAND_UPPER, "BAND_UPPER"), rule(position < BAND_LOWER, "BAND_LOWER")],
        [rule(shaky > VOLATILE, "VOLATILE", shaky * 100)],
        [rule(F.abs(gap) > LARGE_GAP, "GAP", F.when(gap > 0, "up").otherwise("down"), F.abs(gap) * 100)],
        [rule(score > SCORE_HIGH, "RISK_HIGH"), rule(score > SCORE_MEDIUM, "RISK_MEDIUM")],
        [rule(anomaly == 1, "ANOMALY")],
        [rule(classifier > CLASSIFIER_SURE, "CLASSIFIER")],
    ]


def _first_match(group, pick) -> Column:
    chain = None
    for rule in group:
        value = pick(rule)
        chain = F.when(rule[0], value) if chain is None else chain.when(rule[0], value)
    return chain


def with_alerts(df: DataFrame) -> DataFrame:
    """``alerts`` (texts) and ``alert_codes``, parallel and in fixed order."""
    groups = _alert_rules()
    return df.withColumns({
        "alerts": F.array_compact(F.array(*[_first_match(g, lambda r: r[2]) for g in groups])),
        "alert_codes": F.array_compact(F.array(*[_first_match(g, lambda r: F.lit(r[1])) for g in groups])),
    })


def alert_counts(df: DataFrame) -> DataFrame:
    return (
        df.select(F.explode("alert_codes").alias("alert_code"))
        .groupBy("alert_code").agg(F.count("*").alias("n_alerts")))
