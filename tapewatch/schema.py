"""Column layouts, feature order and stored parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Names, order and constants below must equal the published model's.
FEATURES = (
    "Price_Change", "Price_Range", "Gap", "Volume_Change", "Volume_Price_Ratio",
    "Volume_Ratio", "RSI", "MACD", "MACD_Signal", "MACD_Histogram",
    "BB_Width", "BB_Position", "Price_vs_SMA10", "Price_vs_SMA20",
    "Volatility_10d", "Volatility_20d", "Hour", "DayOfWeek", "IsMonday", "IsFriday",
)

# A bar enters training only when all of these are known.
KEY_FEATURES = (
    "Price_Change", "Volume_Ratio", "RSI", "MACD", "BB_Position", "SMA_10", "SMA_20",
)

STORED_PARAMETERS = {
    "classifier_f1_threshold": 0.986153781414032,
    "autoencoder_f1_threshold": 0.3402666668139994,
    "best_ensemble_ae_weight": 0.6,
    "best_ensemble_clf_weight": 0.4,
    "best_ensemble_threshold": 0.39451431697249734,
    "reconstruction_error_min": 0.0022566922013410283,
    "reconstruction_error_max": 3481.8570963597826,
}

DEFAULT_SYMBOLS = (
    "AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "NVDA", "META", "NFLX", "AMD", "INTC",
    "BABA", "JPM", "JNJ", "V", "PG", "UNH", "HD", "MA", "PYPL", "DIS",
    "VZ", "ADBE", "CRM", "CMCSA", "PFE", "KO", "PEP", "ABT", "TMO",
)
# ------------------------------------------------------------ end fixed values

BAR = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("previous_close", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])
BAR_COLUMNS = tuple(BAR.fieldNames())
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def require(columns, needed) -> None:
    """Fail at plan time when a needed column is not there."""
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
