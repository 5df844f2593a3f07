"""Provider payloads: quote snapshots, quote lists, charts, symbol lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: stand-in for an unknown previous close.
APPROXIMATE_PREVIOUS = 0.99


def snapshot_to_bars(quotes: DataFrame, now: Column | None = None) -> DataFrame:
    """Nullable quote fields to a bar; only the previous close may stay unknown."""
    def price(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    now = F.current_timestamp() if now is None else now
    return quotes.select(
        "symbol",
        F.coalesce(F.timestamp_seconds("regularMarketTime"), now).alias("ts"),
        price("regularMarketOpen").alias("open"),
        price("regularMarketDayHigh").alias("high"),
        price("regularMarketDayLow").alias("low"),
        price("regularMarketPrice").alias("close"),
        F.coalesce(F.col("regularMarketVolume"), F.lit(0).cast("long")).alias("volume"),
        F.col("regularMarketPreviousClose").alias("previous_close"))


def latest_of_list(df: DataFrame, quotes: str = "quotes") -> DataFrame:
    """Last quote of an ordered array; the one before gives the previous close.

    An empty array gives a row with ``error`` set.
    """
    last = F.try_element_at(quotes, F.lit(-1))
    before = F.try_element_at(quotes, F.lit(-2))
    return df.select(
        "symbol",
        *[last[c].alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.coalesce(before["close"], last["close"] * APPROXIMATE_PREVIOUS).alias("previous_close"),
        F.when(F.size(quotes) < 1, F.concat(F.lit("No quotes returned for symbol: "), F.col("symbol"))).alias("error"))


def latest_of_table(bars: DataFrame) -> DataFrame:
    """The table form: last bar per symbol and the close of the one before, also where both
    have one time and ``seq``.

    Each task keeps the two newest bars of a symbol before anything is shuffled.
    """
    columns = ["ts", "seq", "open", "high", "low", "close", "volume"]
    back = Window.partitionBy("symbol").orderBy(*(F.col(c).desc() for c in ("ts", "seq", *columns[2:])))
    newest = bars.select("symbol", *columns).withColumn("back", F.row_number().over(back)).filter("back <= 2")
    pair = newest.groupBy("symbol").agg(
        F.max_by(F.struct(*columns), -F.col("back")).alias("l"),
        F.max(F.when(F.col("back") == 2, F.col("close"))).alias("before"))
    return pair.select("symbol", "l.*", F.coalesce("before", F.col("l.close") * APPROXIMATE_PREVIOUS).alias("previous_close"))


def chart_to_bars(charts: DataFrame) -> DataFrame:
    """Parallel arrays of a chart payload to one row per position."""
    zipped = F.arrays_zip("open", "high", "low", "close", "volume")
    return charts.select("symbol", "previous_close", F.posexplode(zipped).alias("position", "q")).select(
        "symbol", "position", "q.*", "previous_close")


def symbol_list(text: Column, limit: Column | int | None = None) -> Column:
    """Comma list to upper-case symbols, the first ``limit`` of them.

    An empty list is an error.
    """
    symbols = F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s)))
    if limit is not None:
        symbols = F.slice(symbols, 1, F.lit(limit) if isinstance(limit, int) else limit)
    return F.when(F.trim(text) == "", F.raise_error(F.lit("No symbols configured"))).otherwise(symbols)
