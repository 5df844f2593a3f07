"""Labels, alerts, single-point modes and plan-time checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import features as ft
from tapewatch.operators import labels as lb
from tapewatch.operators import single_point as sp
from tapewatch.operators.series import lay_out
from tapewatch.schema import FEATURES

# The demonstration row, in stored feature order.
DEMO = [0.08, 0.12, 0.02, 4.5, 1000.0, 6.0, 85.0, 0.5, 0.3, 0.2, 0.15, 0.98, 0.1, 0.15, 0.03, 0.025, 14.0, 2.0, 0.0, 0.0]


def alerts(spark, score=0.0, anomaly=0, classifier=0.0, **features):
    row = {**dict(zip(FEATURES, [0.0] * 20)), "Volume_Ratio": 1.0, "RSI": 50.0, "BB_Position": 0.5, **features}
    row |= {"ensemble_score": float(score), "anomaly_score": anomaly, "classifier_probability": float(classifier)}
    got = lb.with_alerts(spark.createDataFrame([row])).first()
    assert len(got.alerts) == len(got.alert_codes)
    return got


def test_demo_row_alerts(spark):
    got = alerts(spark, **dict(zip(FEATURES, DEMO)))
    assert got.alerts == [
        "Extremely high volume: 6.00x normal", "Large price increase: 8.00%",
        "Overbought condition (RSI: 85.0)", "Price near upper Bollinger Band (potential reversal)"]


@pytest.mark.parametrize("given, code", [
    ({"Volume_Ratio": 5.0}, "VOLUME_HIGH"), ({"Volume_Ratio": 5.01}, "VOLUME_EXTREME"),
    ({"Volume_Ratio": 3.0}, None), ({"Volume_Ratio": 0.1}, None), ({"Volume_Ratio": 0.09}, "VOLUME_LOW"),
    ({"Price_Change": 0.05}, None), ({"Price_Change": -0.051}, "PRICE_MOVE"),
    ({"RSI": 80.0}, None), ({"RSI": 80.1}, "OVERBOUGHT"), ({"RSI": 19.9}, "OVERSOLD"), ({"RSI": 20.0}, None),
    ({"BB_Position": 0.95}, None), ({"BB_Position": 0.96}, "BAND_UPPER"), ({"BB_Position": 0.04}, "BAND_LOWER"),
    ({"Volatility_10d": 0.05}, None), ({"Volatility_10d": 0.06}, "VOLATILE"),
    ({"Gap": 0.02}, None), ({"Gap": -0.03}, "GAP"),
    ({"score": 0.8}, "RISK_MEDIUM"), ({"score": 0.81}, "RISK_HIGH"), ({"score": 0.6}, None),
    ({"anomaly": 1}, "ANOMALY"), ({"classifier": 0.9}, None), ({"classifier": 0.91}, "CLASSIFIER"),
])
def test_alert_thresholds_are_strict(spark, given, code):
    assert alerts(spark, **given).alert_codes == ([code] if code else [])


def test_alert_texts(spark):
    got = alerts(spark, Price_Change=-0.0812, Gap=-0.031, Volatility_10d=0.0625, RSI=10.0)
    assert got.alerts == [
        "Large price decrease: 8.12%", "Oversold condition (RSI: 10.0)", "High volatility detected: 6.25%", "Gap down: 3.10%"]


@pytest.mark.parametrize("score, level", [(0.71, "HIGH"), (0.7, "MEDIUM"), (0.31, "MEDIUM"), (0.3, "LOW"), (0.0, "LOW")])
def test_risk_level(spark, score, level):
    assert spark.range(1).select(lb.risk_level(F.lit(score))).first()[0] == level


def test_pump_is_labelled(bars):
    """Quiet bars, then ten times the volume on a jump."""
    closes = [100 + 0.1 * (i % 3) for i in range(40)] + [108.2]
    rows = lb.rule_labels(ft.history_features(lay_out(bars({"A": closes}, {"A": [100] * 40 + [1000]}))).rows())
    last = rows.orderBy(F.desc("ts")).first()
    assert (last.Potential_Manipulation, last.Suspicious_Activity, last.Target) == (1, 1, 1)
    assert rows.agg(F.sum("Target")).first()[0] == 1


def smoke_bar(spark):
    row = ("JNJ", dt.datetime(2025, 9, 22, 2, 28, 58), 174.69, 177.16, 173.33, 176.19, 25617300, 174.16, 0)
    return spark.createDataFrame(
        [row], "symbol string, ts timestamp, open double, high double, low double, close double, volume long, previous_close double, seq long")


def test_simple_mode_of_the_smoke_bar(spark):
    got = sp.simple_features(smoke_bar(spark)).first()
    assert got.Price_Change == pytest.approx(0.0116559, abs=1e-7)
    assert got.Gap == pytest.approx(0.0030432, abs=1e-7)
    assert got.Price_Range == pytest.approx(0.0217379, abs=1e-7) == got.Volatility_10d
    assert got.BB_Width == pytest.approx(7.0476)
    assert (got.RSI, got.Volume_Ratio, got.Hour, got.DayOfWeek, got.IsMonday, got.IsFriday) == (50, 1, 2, 0, 1, 0)


def test_enhanced_mode_of_the_smoke_bar(spark):
    got = sp.enhanced_features(smoke_bar(spark)).first()
    assert got.RSI == pytest.approx(61.6559, abs=1e-4)
    assert got.MACD == pytest.approx(0.116559, abs=1e-6)
    assert got.MACD_Signal == pytest.approx(0.0932476, abs=1e-6)
    assert got.BB_Width == pytest.approx(0.0869516, abs=1e-6)
    assert (got.BB_Position, got.Volume_Ratio, got.Hour) == (pytest.approx(0.5), pytest.approx(1.25), 0)


@pytest.mark.parametrize("previous", [None, 0.0])
def test_unusable_previous_close(spark, previous):
    bar = smoke_bar(spark).withColumn("previous_close", F.lit(previous).cast("double"))
    for features in (sp.simple_features(bar), sp.enhanced_features(bar)):
        assert (features.first().Price_Change, features.first().Gap) == (0.0, 0.0)


def test_zero_prices_do_not_raise(spark):
    bar = smoke_bar(spark).withColumns({c: F.lit(0.0) for c in ("open", "high", "low", "close")}).withColumn("volume", F.lit(0).cast("long"))
    got = sp.simple_features(bar).first()
    assert (got.Price_Range, got.Volume_Price_Ratio, got.Volatility_10d) == (0.0, 0.0, 0.01)
    got = sp.enhanced_features(bar).first()
    assert (got.BB_Width, got.Volume_Ratio, got.Intraday_Return, got.Liquidity_Risk) == (0.04, 1.0, 0.0, 0.001)


def test_missing_feature_column_fails_at_plan_time(spark):
    with pytest.raises(ValueError, match="Gap"):
        ft.feature_vector(spark.createDataFrame([dict(zip(FEATURES, DEMO))]).drop("Gap"))


def test_features_by_mode_read_the_bars_once(spark, bars):
    from tapewatch.operators.single_point import features_by_mode
    from tapewatch.session import scratch

    made = bars({"A": [10.0 + i % 5 for i in range(40)], "B": [7.0], "C": [3.0, float("nan")]}).withColumn("previous_close", F.lit(6.5))
    path = scratch(spark, "bars")
    made.write.parquet(path)
    for batch, mode in ((True, "enhanced"), (False, "simple")):
        found = features_by_mode(spark.read.parquet(path), batch, 1000)
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        rows = {r.symbol: r for r in found.collect()}
        assert {s: (r.points, r["mode"]) for s, r in rows.items()} == {"A": (40, "full"), "B": (1, mode), "C": (1, mode)}
        assert round(rows["B"].Price_Change, 6) == round(0.5 / 6.5, 6) and rows["A"].RSI is not None
