"""Per-bar features on a stream, with a fixed-size state per symbol.

The state holds the last rows of the rolling windows and the running averages.
Bars of a symbol in one micro-batch are put in time order first; how many those
are is bounded by the source's limit in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewatch.operators.features import BAND_ROWS, FAST_ROWS, RSI_ROWS, SIGNAL_ROWS, SLOW_ROWS
from tapewatch.operators.series import priced
from tapewatch.schema import FEATURES
from tapewatch.session import ship_package

KEEP = 20  # rows of look-back of the widest rolling window
FORGET_AFTER = 366 * 86400  # seconds behind the newest bar until a symbol's state goes

INPUT = "ts timestamp, seq long, open double, high double, low double, close double, volume long"
OUTPUT = "symbol string, ts timestamp, seq long, rn long, close double, volume long, late boolean, " + ", ".join(
    f"{c} double" for c in FEATURES)
STATE = (
    "last_ts timestamp, last_seq long, rows long, closes array<double>, volumes array<double>, changes array<double>, "
    "up double, down double, fast double, slow double, signal double")
OUTPUT_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
NAN = float("nan")


def _running(values: pd.Series, alpha: float, before: float) -> pd.Series:
    """Unadjusted average continued from its value before these rows."""
    if np.isnan(before):
        return values.ewm(alpha=alpha, adjust=False).mean()
    seeded = pd.concat([pd.Series([before]), values], ignore_index=True)
    return seeded.ewm(alpha=alpha, adjust=False).mean().iloc[1:].reset_index(drop=True)


def _divide(top: pd.Series, bottom: pd.Series) -> pd.Series:
    return top / bottom.where(bottom != 0)


def advance(bars: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Features of new bars of one symbol, and the state after them."""
    seen, closes, volumes, changes, up, down, fast, slow, signal = state or (0, [], [], [], NAN, NAN, NAN, NAN, NAN)
    n, old = len(bars), len(closes)
    close = pd.concat([pd.Series(closes, dtype=float), bars["close"].astype(float)], ignore_index=True)
    volume = pd.concat([pd.Series(volumes, dtype=float), bars["volume"].astype(float)], ignore_index=True)
    rn = pd.Series(np.arange(seen + 1, seen + n + 1))
    previous, price = close.shift(1), close.iloc[old:].reset_index(drop=True)

    def new(s: pd.Series) -> pd.Series:
        return s.iloc[old:].reset_index(drop=True)

    out = pd.DataFrame({"ts": bars["ts"], "seq": bars["seq"], "rn": rn, "close": price, "volume": bars["volume"]})
    before, size = new(previous), new(volume)
    change = _divide(price, before) - 1
    out["Price_Change"] = change
    out["Price_Range"] = _divide(bars["high"] - bars["low"], price)
    out["Gap"] = _divide(bars["open"] - before, before)
    out["Volume_Change"] = _divide(size, new(volume.shift(1))) - 1
    out["Volume_Price_Ratio"] = _divide(size, price)
    out["Volume_Ratio"] = _divide(size, new(volume.rolling(20, min_periods=1).mean()))
    for width in (10, 20):
        out[f"Price_vs_SMA{width}"] = _divide(price, new(close.rolling(width, min_periods=1).mean())) - 1
    all_changes = pd.concat([pd.Series(changes, dtype=float), change], ignore_index=True)
    for width in (10, 20):
        spread = all_changes.rolling(width, min_periods=1).std()
        out[f"Volatility_{width}d"] = spread.iloc[old:].reset_index(drop=True)

    middle = new(close.rolling(BAND_ROWS, min_periods=BAND_ROWS).mean())
    reach = 2 * new(close.rolling(BAND_ROWS, min_periods=BAND_ROWS).std(ddof=0))
    out["BB_Width"] = _divide(2 * reach, middle)
    out["BB_Position"] = _divide(price - (middle - reach), 2 * reach)

    move = (price - before).fillna(0.0)
    ups = _running(move.clip(lower=0.0), 1 / RSI_ROWS, up)
    downs = _running((-move).clip(lower=0.0), 1 / RSI_ROWS, down)
    rsi = (100 - 100 / (1 + _divide(ups, downs))).where(downs != 0, 100.0)
    out["RSI"] = rsi.where(rn >= RSI_ROWS)
    fasts, slows = _running(price, 2 / (FAST_ROWS + 1), fast), _running(price, 2 / (SLOW_ROWS + 1), slow)
    macd = (fasts - slows).where(rn >= SLOW_ROWS)
    started = macd.dropna()
    signals = pd.Series(NAN, index=macd.index)
    if len(started):
        signals.loc[started.index] = _running(started.reset_index(drop=True), 2 / (SIGNAL_ROWS + 1), signal).to_numpy()
        signal = float(signals.iloc[-1])
    out["MACD"] = macd
    out["MACD_Signal"] = signals.where(rn >= SLOW_ROWS + SIGNAL_ROWS - 1)
    out["MACD_Histogram"] = out["MACD"] - out["MACD_Signal"]

    weekday = bars["ts"].dt.weekday
    out["Hour"], out["DayOfWeek"] = bars["ts"].dt.hour, weekday
    out["IsMonday"], out["IsFriday"] = (weekday == 0), (weekday == 4)
    out[list(FEATURES)] = out[list(FEATURES)].astype(float)

    after = (
        seen + n, close.iloc[-KEEP:].tolist(), volume.iloc[-KEEP:].tolist(),
        all_changes.iloc[-KEEP:].tolist(), float(ups.iloc[-1]), float(downs.iloc[-1]),
        float(fasts.iloc[-1]), float(slows.iloc[-1]), signal)
    return out, after


def _per_symbol(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Features of the bars after the last one; earlier ones come out as late, without features."""
    if state.hasTimedOut:
        state.remove()
        return
    bars = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], ignore_index=True)
    last_ts, last_seq, kept = None, None, None
    if state.exists:
        last_ts, last_seq, *kept = state.get
    if last_ts is not None:
        last_ts = pd.Timestamp(last_ts)
        late = (bars["ts"] < last_ts) | ((bars["ts"] == last_ts) & (bars["seq"] <= last_seq))
    else:
        late = pd.Series(False, index=bars.index)
    if late.any():
        refused = bars.loc[late, ["ts", "seq", "close", "volume"]].reset_index(drop=True)
        refused["rn"], refused["late"] = 0, True
        refused[list(FEATURES)] = NAN
        refused.insert(0, "symbol", key[0])
        yield refused[OUTPUT_COLUMNS]
    bars = bars.loc[~late].reset_index(drop=True)
    if len(bars):
        out, after = advance(bars, tuple(kept) if kept else None)
        state.update((bars["ts"].iloc[-1].to_pydatetime(), int(bars["seq"].iloc[-1]), *after))
        newest = int(bars["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        out.insert(0, "symbol", key[0])
        out["late"] = False
        yield out[OUTPUT_COLUMNS]


def rolling_features(bars: DataFrame, forget_after: int = FORGET_AFTER) -> DataFrame:
    """The features of every streamed bar, equal to the table form.

    Bars without known, finite prices are left out, as there.  A bar that isn't later than the last one of
    its symbol in an earlier micro-batch comes out with ``late`` and no features; ``state.ordered_features`` waits for
    such bars instead.  A symbol whose last bar is more than ``forget_after`` seconds behind the newest of all is forgotten and
    starts anew, and bars that far behind when they come are left out.
    """
    ship_package(bars.sparkSession)
    columns = ["symbol", *[c.split()[0] for c in INPUT.split(", ")]]
    return priced(bars).select(*columns).withWatermark("ts", f"{forget_after} seconds").groupBy("symbol").applyInPandasWithState(
        _per_symbol, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
