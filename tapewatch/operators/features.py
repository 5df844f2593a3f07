"""Per-bar features over a symbol's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewatch.functions.ema import Average, averages, block_columns, with_averages
from tapewatch.functions.expr import calendar, finite, ratio
from tapewatch.operators.series import Series, series_length
from tapewatch.schema import FEATURES, KEY_FEATURES, require

# Warm-up rows and window widths of the indicators.
RSI_ROWS, FAST_ROWS, SLOW_ROWS, SIGNAL_ROWS, BAND_ROWS = 14, 12, 26, 9, 20


def row_features() -> dict[str, Column]:
    """Features that need no other row."""
    return {
        "Price_Range": ratio(F.col("high") - F.col("low"), F.col("close")),
        "Volume_Price_Ratio": ratio(F.col("volume").cast("double"), F.col("close")),
        **calendar(F.col("ts")),
    }


def lagged_features(series: Series) -> Series:
    """Changes against the bar before, and the plain rolling means."""
    w = series.window()
    frame = series.frame.withColumns({
        "prev_close": F.lag("close").over(w),
        "prev_volume": F.lag("volume").over(w),
        "Volume_MA": F.avg("volume").over(series.last_rows(20)),
        "SMA_10": F.avg("close").over(series.last_rows(10)),
        "SMA_20": F.avg("close").over(series.last_rows(20)),
        "_band_std": F.stddev_pop("close").over(series.last_rows(BAND_ROWS)),
        **block_columns(),
    })
    volume = F.col("volume").cast("double")
    move = F.coalesce(F.col("close") - F.col("prev_close"), F.lit(0.0))
    return series.on(frame.withColumns({
        **row_features(),
        "Price_Change": ratio(F.col("close"), F.col("prev_close")) - 1,
        "Gap": ratio(F.col("open") - F.col("prev_close"), F.col("prev_close")),
        "Volume_Change": ratio(volume, F.col("prev_volume").cast("double")) - 1,
        "Volume_Ratio": ratio(volume, F.col("Volume_MA")),
        "Price_vs_SMA10": ratio(F.col("close"), F.col("SMA_10")) - 1,
        "Price_vs_SMA20": ratio(F.col("close"), F.col("SMA_20")) - 1,
        "_up": F.greatest(move, F.lit(0.0)),
        "_down": F.greatest(-move, F.lit(0.0)),
    }))


def volatility(series: Series) -> Series:
    """Sample deviation of the price change over 10 and 20 rows."""
    return series.on(series.frame.withColumns({
        "Volatility_10d": F.stddev_samp("Price_Change").over(series.last_rows(10)),
        "Volatility_20d": F.stddev_samp("Price_Change").over(series.last_rows(20)),
    }))


def bands(series: Series) -> Series:
    """Mean plus and minus two population deviations of the last 20 closes."""
    ready = F.col("rn") >= BAND_ROWS
    middle, reach = F.col("SMA_20"), 2 * F.col("_band_std")
    return series.on(series.frame.withColumns({
        "BB_Middle": F.when(ready, middle),
        "BB_Upper": F.when(ready, middle + reach),
        "BB_Lower": F.when(ready, middle - reach),
        "BB_Width": F.when(ready, ratio(2 * reach, middle)),
        "BB_Position": F.when(ready, ratio(F.col("close") - (middle - reach), 2 * reach)),
    }))


def momentum(series: Series) -> Series:
    """RSI and MACD."""
    wilder = 1.0 / RSI_ROWS
    series, value, helpers = averages(series, [
        Average("up", "_up", wilder),
        Average("down", "_down", wilder),
        Average.span("fast", "close", FAST_ROWS),
        Average.span("slow", "close", SLOW_ROWS),
    ])
    rsi = F.when(value["down"] == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + ratio(value["up"], value["down"])))
    series = series.on(series.frame.withColumns({
        "RSI": F.when(F.col("rn") >= RSI_ROWS, rsi),
        "MACD": F.when(F.col("rn") >= SLOW_ROWS, value["fast"] - value["slow"]),
    }))
    series, value, more = averages(series, [Average.span("signal", "MACD", SIGNAL_ROWS, first=SLOW_ROWS)])
    signal = F.when(F.col("rn") >= SLOW_ROWS + SIGNAL_ROWS - 1, value["signal"])
    return series.on(series.frame.withColumns({
        "MACD_Signal": signal,
        "MACD_Histogram": F.col("MACD") - signal,
    }).drop(*helpers, *more))


def smoothed_closes(series: Series, short_frames: bool = False) -> Series:
    """Weight-adjusted averages ``EMA_12`` and ``EMA_26``.

    ``short_frames`` narrows the span to the symbol's row count, the scoring
    form of the operator.
    """
    def alpha(span: int) -> float | str:
        return f"(2D / (least({span}, n_rows) + 1))" if short_frames else 2.0 / (span + 1)

    if short_frames:
        series = series_length(series)
    return series.on(with_averages(series, [
        Average("EMA_12", "close", alpha(FAST_ROWS), adjusted=True, least_alpha=2.0 / (FAST_ROWS + 1)),
        Average("EMA_26", "close", alpha(SLOW_ROWS), adjusted=True, least_alpha=2.0 / (SLOW_ROWS + 1)),
    ]))


def history_features(series: Series) -> Series:
    """All features of every bar; unknown values are NULL."""
    for step in (lagged_features, volatility, bands, momentum):
        series = step(series)
    return series.on(series.frame.drop("_j", "_block", "_up", "_down", "_band_std"))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows whose key features are all known."""
    return df.dropna(subset=list(KEY_FEATURES))


def finite_features(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Infinities and NaN to NULL, for features computed elsewhere."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def default_of(column: str) -> float | None:
    """The fixed default of a feature while it is unknown; None means its mean."""
    if column == "RSI":
        return 50.0
    if column == "BB_Position":
        return 0.5
    if column == "Volume_Ratio":
        return 1.0
    if "Change" in column or "Gap" in column:
        return 0.0
    return None


def fill_defaults(series: Series, columns=FEATURES) -> DataFrame:
    """Every bar with unknown features replaced: fixed default or symbol mean."""
    averaged = [c for c in columns if default_of(c) is None]
    frame = series.frame
    means = {f"_m_{c}": F.avg(c) for c in averaged}
    if series.chunked:
        rows = series.rows()
        stats = rows.groupBy("symbol").agg(*[m.alias(n) for n, m in means.items()])
        rows = rows.join(stats, "symbol")
    else:
        whole = Window.partitionBy(*series.keys)
        rows = frame.withColumns({n: m.over(whole) for n, m in means.items()})
    return rows.withColumns({c: _filled(c) for c in columns}).drop(*means)


def _filled(column: str) -> Column:
    default = default_of(column)
    if default is not None:
        return F.coalesce(F.col(column).cast("double"), F.lit(default))
    return F.coalesce(F.col(column).cast("double"), F.col(f"_m_{column}"), F.lit(0.0))


def latest_row(df: DataFrame) -> DataFrame:
    """The last bar of each symbol by (ts, seq)."""
    columns = [c for c in df.columns if c != "symbol"]
    last = F.max_by(F.struct(*columns), F.struct("ts", "seq"))
    return df.groupBy("symbol").agg(last.alias("_last")).select("symbol", "_last.*")


def latest_features(series: Series, columns=FEATURES) -> DataFrame:
    """The last bar of each symbol with defaults filled, in one aggregation."""
    rows = series.rows()
    keep = [c for c in rows.columns if c != "symbol"]
    averaged = [c for c in columns if default_of(c) is None]
    one = rows.groupBy("symbol").agg(
        F.max_by(F.struct(*keep), F.struct("ts", "seq")).alias("_last"),
        F.count("*").alias("points"),
        *[F.avg(c).alias(f"_m_{c}") for c in averaged])
    means = [f"_m_{c}" for c in averaged]
    flat = one.select("symbol", "points", "_last.*", *means)
    return flat.withColumns({c: _filled(c) for c in columns}).drop(*means)


def feature_vector(df: DataFrame, columns=FEATURES, name: str = "features") -> DataFrame:
    """The features as one array in stored order; unknown or non-finite is 0."""
    require(df.columns, columns)
    parts = [F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns]
    return df.withColumn(name, F.array(*parts))


def market_data() -> Column:
    """The ten fields echoed with a detection."""
    return F.struct(
        "open", "high", "low", "close", "volume",
        F.coalesce(F.col("Price_Change"), F.lit(0.0)).alias("price_change"),
        F.coalesce(F.col("Volume_Ratio"), F.lit(1.0)).alias("volume_ratio"),
        F.coalesce(F.col("RSI"), F.lit(50.0)).alias("rsi"),
        F.coalesce(F.col("MACD"), F.lit(0.0)).alias("macd"),
        F.coalesce(F.col("BB_Position"), F.lit(0.5)).alias("bb_position"),
    )

