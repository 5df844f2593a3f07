"""Indicators against pandas, the chunked layout, and edge series."""

import numpy as np
import pandas as pd
import pytest

from tapewatch.functions.ema import Average, with_averages
from tapewatch.operators import features as ft
from tapewatch.operators.series import lay_out, number_by_sort
from tapewatch.schema import FEATURES


def walk(n, seed=1):
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n))))


def expected(closes, volumes):
    """The published pandas definitions."""
    c, v = pd.Series(closes, dtype=float), pd.Series(volumes, dtype=float)
    out = pd.DataFrame({"Price_Change": c.pct_change(), "Volume_Ratio": v / v.rolling(20, min_periods=1).mean()})
    d = c.diff()
    up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    out["RSI"] = np.where(down == 0, 100, 100 - 100 / (1 + up / down))
    out["MACD"] = (c.ewm(span=12, min_periods=12, adjust=False).mean()
                   - c.ewm(span=26, min_periods=26, adjust=False).mean())
    out["MACD_Signal"] = out["MACD"].ewm(span=9, min_periods=9, adjust=False).mean()
    middle, deviation = c.rolling(20, min_periods=20).mean(), c.rolling(20, min_periods=20).std(ddof=0)
    out["BB_Width"] = 4 * deviation / middle
    out["BB_Position"] = (c - (middle - 2 * deviation)) / (4 * deviation)
    out["Volatility_10d"] = out["Price_Change"].rolling(10, min_periods=1).std()
    return out


def by_time(df, symbol="A"):
    return df.filter(f"symbol = '{symbol}'").orderBy("ts", "seq").toPandas()


@pytest.mark.parametrize("n", [1, 2, 13, 14, 25, 26, 33, 34, 60, 2500])
def test_features_equal_pandas(bars, n):
    closes, volumes = walk(n), list(np.random.default_rng(2).integers(1, 1000, n))
    got = by_time(ft.history_features(lay_out(bars({"A": closes}, {"A": volumes}))).rows())
    want = expected(closes, volumes)
    for column in want:
        np.testing.assert_allclose(
            got[column].astype(float), want[column].astype(float), rtol=1e-9, atol=1e-9, err_msg=column)


def test_chunked_layout_equals_whole(bars):
    """A symbol over several chunks gives what one window gives."""
    frame = bars({"A": walk(9000), "B": walk(700, 3)}).cache()
    whole = ft.smoothed_closes(ft.history_features(lay_out(frame, 10_000)), True)
    cut = lay_out(frame, rows_per_task=2048)
    assert cut.chunked and not whole.chunked
    cut = ft.smoothed_closes(ft.history_features(cut), True)
    columns = [*FEATURES, "EMA_12", "EMA_26", "rn"]
    for symbol in "AB":
        a, b = by_time(whole.rows(), symbol), by_time(cut.rows(), symbol)
        assert len(a) == len(b)
        for c in columns:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    filled = by_time(ft.fill_defaults(cut))
    assert filled[list(FEATURES)].notna().all().all()


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 2 / 27, 2 / 10, 0.45])
def test_average_over_many_blocks(bars, alpha):
    closes = walk(5000, 7)
    series = lay_out(bars({"A": closes}))
    got = by_time(with_averages(series, [
        Average("plain", "close", alpha), Average("weighted", "close", alpha, adjusted=True)]))
    s = pd.Series(closes)
    np.testing.assert_allclose(got["plain"], s.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["weighted"], s.ewm(alpha=alpha, adjust=True).mean(), rtol=1e-10)


def test_flat_series(bars):
    got = by_time(ft.history_features(lay_out(bars({"A": [100.0] * 40}, {"A": [10] * 40}))).rows())
    assert got["BB_Position"].isna().all()
    assert (got["RSI"].dropna() == 100).all() and len(got["RSI"].dropna()) == 27
    filled = by_time(ft.fill_defaults(ft.history_features(lay_out(bars({"A": [100.0] * 40})))))
    assert (filled["BB_Position"] == 0.5).all()


def test_zero_close_gives_null_not_an_error(bars):
    closes = walk(40)
    closes[20] = 0.0
    got = by_time(ft.history_features(lay_out(bars({"A": closes}))).rows())
    assert np.isnan(got["Price_Change"][21]) and got["Price_Change"][20] == -1.0
    assert np.isnan(got["Price_Range"][20])


def test_first_33_bars_have_no_signal(bars):
    rows = ft.history_features(lay_out(bars({"A": walk(50)}))).rows()
    assert rows.dropna(subset=list(FEATURES)).count() == 50 - 33


def test_ties_are_ordered_by_seq_and_spread(spark):
    """One instant holds most rows; numbering stays exact."""
    rows = [("A", "2024-01-01", i) for i in range(5000)] + [("B", "2024-01-02", 1)]
    df = spark.createDataFrame(rows, "symbol string, day string, seq long").selectExpr(
        "symbol", "cast(day as timestamp) ts", "seq")
    got = number_by_sort(df.repartition(7), ["symbol"], ["ts", "seq"])
    assert got.filter("symbol = 'A' and rn <> seq + 1").count() == 0
    assert got.count() == 5001


def test_latest_equals_last_of_filled(bars):
    series = ft.history_features(lay_out(bars({"A": walk(45), "B": walk(5, 4)})))
    last = {r.symbol: r for r in ft.latest_features(series).collect()}
    for symbol in "AB":
        row = by_time(ft.fill_defaults(series), symbol).iloc[-1]
        for c in FEATURES:
            assert last[symbol][c] == pytest.approx(row[c], rel=1e-9, abs=1e-9), c


@pytest.mark.parametrize("chunks", [None, 8192])
@pytest.mark.parametrize("adjusted", [False, True])
def test_averages_of_any_span_equal_pandas(spark, chunks, adjusted):
    import numpy as np
    import pandas as pd
    draw = np.random.default_rng(3).normal(100, 5, 30_000)
    start = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({"symbol": "A", "ts": start + pd.to_timedelta(np.arange(30_000), "s"), "seq": 0, "close": draw})
    spans = (1, 2, 12, 50, 100, 200) if chunks else (1, 2, 12, 50, 100, 200, 3000, 50_000)
    layout = {"rows_per_task": chunks, "halo": 4096} if chunks else {}
    series = lay_out(spark.createDataFrame(frame), **layout)
    assert series.chunked == bool(chunks)
    wanted = [Average.span(f"e{s}", "close", s, adjusted=adjusted) for s in spans]
    got = series.on(with_averages(series, wanted)).rows().orderBy("ts").toPandas()
    for s in spans:
        want = pd.Series(draw).ewm(span=s, adjust=adjusted).mean()
        assert np.abs(got[f"e{s}"] - want).max() < 1e-9, s


def test_averages_refuse_what_they_cannot_do(spark):
    with pytest.raises(ValueError):
        Average("e", "close", 1.5)
    with pytest.raises(ValueError):
        Average("e", "close", "2D / n_rows")
    ticks = spark.range(5000).selectExpr("'A' as symbol", "timestamp_seconds(id) as ts", "0L as seq", "1D as close")
    with pytest.raises(ValueError, match="halo"):
        with_averages(lay_out(ticks, rows_per_task=2048), [Average.span("e", "close", 200)])
