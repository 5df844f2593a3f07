"""Joins of requests, feeds and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewatch.operators.series import ROWS_PER_TASK, placed
from tapewatch.session import small_side

# Seconds a look-up stays fresh, minutes until a feed counts as closed.
FRESH_SECONDS = 300
CLOSED_MINUTES = 30
NO_DATA = "No market data available"


def latest_for_requests(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Every request with its symbol's latest bar, or ``error`` when there is none."""
    marked = latest.withColumn("_found", F.lit(True))
    return (
        requests.join(marked, "symbol", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), F.lit(NO_DATA)))
        .drop("_found"))


def error_rows(failed: DataFrame, message: Column) -> DataFrame:
    """Result rows of symbols that could not be scored."""
    zero = F.lit(0.0)
    return failed.select(
        "symbol", zero.alias("ensemble_score"), zero.alias("classifier_probability"),
        F.lit(0).alias("anomaly_score"), F.lit(False).alias("is_suspicious"),
        F.lit("ERROR").alias("risk_level"),
        F.array(F.concat(F.lit("Error: "), message)).alias("alerts"))


def as_of(
    requests: DataFrame,
    observations: DataFrame,
    columns: list[str],
    max_age: int = FRESH_SECONDS,
    rows_per_piece: int = ROWS_PER_TASK,
) -> DataFrame:
    """The last observation of the symbol less than ``max_age`` seconds old.

    ``requests`` has symbol and request_ts; ``observations`` symbol, ts and seq.
    Symbols match in upper case.  Of observations at one instant the one with the largest ``seq`` counts.

    Requests and observations are sorted together by symbol and time and cut into range pieces, whatever
    symbol they belong to.  Within a piece each request takes the last observation before it; the last one of
    each piece is carried to the pieces after it.  So no window holds more than a piece, however many
    observations a symbol, or ``max_age`` seconds of it, has.  Requests without symbol or time find nothing.
    """
    key = F.upper("symbol").alias("_key")
    seen = observations.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).select(
        key, F.col("ts").alias("_at"), F.lit(0).alias("_asked"), F.col("seq").alias("_seq"), F.struct("ts", *columns).alias("_value"))
    asked = requests.select(key, F.col("request_ts").alias("_at"), F.lit(1).alias("_asked"), "symbol")
    together = seen.unionByName(asked, allowMissingColumns=True)
    known = carried(together, ["_key"], ["_at", "_asked", "_seq"], "_value", rows_per_piece).filter(F.col("_asked") == 1)
    age = F.unix_micros("_at") - F.unix_micros("_value.ts")
    found = known.withColumn("_value", F.when(F.col("_key").isNotNull() & (age < max_age * 1_000_000), F.col("_value")))
    return found.select(
        "symbol", F.col("_at").alias("request_ts"), F.col("_value.ts").alias("observed_ts"),
        *[F.col(f"_value.{c}").alias(c) for c in columns])


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, rows_per_piece: int = ROWS_PER_TASK) -> DataFrame:
    """``value`` filled with the last one known before, per key and in order.

    A prefix scan in two levels: over the rows of each range piece, then over the pieces of each key, of which
    there is one row per key and piece that it lies in.  Only the first key of a piece can have begun before it, so
    what is carried is at most one row per piece.  A task sorts many pieces: each one of its own would cost the driver
    a share of the sample and a result.
    """
    rows = df.count()
    tasks = max(-(-rows // ROWS_PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = -(-rows // rows_per_piece)
    place = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    spread = placed(df, keys + order, min(pieces, tasks) if pieces > 1 else None).withColumn("_part", F.col("_pos") - place % rows_per_piece)
    so_far = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    within = spread.withColumn("_last", F.last(value, ignorenulls=True).over(so_far))
    ends = spread.filter(F.col(value).isNotNull()).groupBy(*keys, "_part").agg(F.max_by(value, "_pos").alias("_end"))
    firsts = spread.groupBy("_part").agg(F.min_by(F.struct(*keys), "_pos").alias("_first")).select("_part", "_first.*")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.unionByName(firsts, allowMissingColumns=True).groupBy(*keys, "_part").agg(
        F.max("_end").alias("_end"), F.count_if(F.col("_end").isNull()).alias("_opens"))
    before = begun.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).filter(
        (F.col("_opens") > 0) & F.col("_before").isNotNull()).select(*keys, "_part", "_before")
    return (
        within.join(small_side(before), [*keys, "_part"], "left")
        .withColumn(value, F.coalesce("_last", "_before"))
        .drop("_last", "_before", "_pos", "_part"))


def with_fallback(primary: DataFrame, secondary: DataFrame, enabled: bool = True) -> DataFrame:
    """Per symbol the primary row, else the secondary's; ``origin`` tells which."""
    first = primary.withColumn("origin", F.lit("primary"))
    if not enabled:
        return first
    missing = secondary.join(primary.select("symbol"), "symbol", "left_anti")
    return first.unionByName(missing.withColumn("origin", F.lit("secondary")), allowMissingColumns=True)


def valid_symbols(requests: DataFrame, bars: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """Requests flagged by whether the symbol has a bar in the trailing day."""
    recent = (
        bars.filter(F.col("ts") > now - F.expr(f"interval {days} day")).select("symbol").distinct()
        .withColumn("is_valid", F.lit(True)))
    return requests.join(recent, "symbol", "left").withColumn(
        "is_valid", F.coalesce("is_valid", F.lit(False)))


def feed_status(last_update: Column, now: Column) -> dict[str, Column]:
    """Age of the last bar in minutes and the status read from it."""
    age = (F.unix_micros(now) - F.unix_micros(last_update)) / 60e6
    return {
        "minutes_old": age,
        "status": F.when(last_update.isNull(), "UNKNOWN")
        .when(age > CLOSED_MINUTES, "CLOSED").otherwise("OPEN"),
    }


def attach(df: DataFrame, one_row: DataFrame, *columns: str) -> DataFrame:
    """Add the columns of a one-row frame to every row by a scalar subquery."""
    columns = columns or tuple(one_row.columns)
    packed = one_row.select(F.struct(*columns)).scalar()
    return df.withColumn("_one", packed).select("*", "_one.*").drop("_one")

