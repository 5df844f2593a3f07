"""Messages and ticks as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapewatch.functions.expr import flag
from tapewatch.operators.features import latest_row
from tapewatch.operators.lookups import FRESH_SECONDS
from tapewatch.operators.scaling import Scaler
from tapewatch.operators.series import is_priced
from tapewatch.plans.inference import score
from tapewatch.sources import feed
from tapewatch.streaming.run import batch_folder, each_batch, forget, kept_before, requested

WATERMARK = "1 hour"        # ticks whose bar has closed are in none; ``state.bars_and_late`` keeps them
DEDUP_INTERVAL = "5 minutes"  # fixed value: the broker's dedup interval


def ingest(bodies: DataFrame, path: str, interval: int | None = None):
    """Message bodies to bars, a quarantine and counts, one folder per micro-batch.

    No message is lost: what cannot be read lands in the quarantine.
    """
    messages = observed(feed.read_messages(bodies))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        feed.good_bars(batch).write.mode("overwrite").parquet(batch_folder(path, "bars", batch_id))
        feed.quarantine(batch, "body").write.mode("overwrite").parquet(batch_folder(path, "quarantine", batch_id))
        feed.accounting(batch).write.mode("overwrite").parquet(batch_folder(path, "counts", batch_id))
        batch.unpersist()

    return each_batch(messages, path, write, interval=interval)


def drop_repeats(stream: DataFrame, key: str = "dedup_id", time: str = "ts", within: str = DEDUP_INTERVAL) -> DataFrame:
    """One row per id within the interval.

    Rows more than the interval behind the newest of earlier batches are left out, repeats or not; ``run.left_out`` tells how many.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def tick_bars(ticks: DataFrame, width: str, order: str, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling bars; a bar appears once the watermark has passed its end."""
    key = F.col(order)
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", key).alias("close"), F.sum("qty").cast("long").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume",
                F.lit(0).cast("long").alias("seq")))


def fresh(latest: DataFrame, seconds: int = FRESH_SECONDS) -> DataFrame:
    """Rows less than ``seconds`` behind the newest one, in event time."""
    newest = latest.agg(F.max(F.unix_micros("ts"))).scalar()
    return latest.filter(newest - F.unix_micros("ts") < seconds * 1_000_000)


def advance_latest(batch: DataFrame, path: str, batch_id: int, wanted: list[str], seconds: int = FRESH_SECONDS) -> DataFrame:
    """The latest rows of the wanted symbols (in upper case) after this micro-batch, kept under ``state``.

    The newest row of all stays as well, since it tells which rows are ``seconds`` old and forgotten.  So the state is as
    large as the request, whatever the number of symbols (``state.keep_latest`` keeps them all); it is read from the batch
    before and written once.  Rows of a batch may be out of order.
    """
    spark = batch.sparkSession
    now = batch.withColumn("symbol", F.upper("symbol"))
    before = kept_before(spark, path, "state", batch_id, now.schema)
    together = latest_row(before.unionByName(now)).select(*now.columns).persist()
    newest = together.agg(F.max(F.unix_micros("ts"))).scalar()
    kept = fresh(together, seconds).filter(F.col("symbol").isin(wanted) | (F.unix_micros("ts") == newest))
    kept.write.mode("overwrite").parquet(batch_folder(path, "state", batch_id))
    together.unpersist()
    if batch_id > 1:
        forget(spark, path, "state", batch_id - 2)
    return spark.read.schema(now.schema).parquet(batch_folder(path, "state", batch_id))


def score_each_bar(bars: DataFrame, scaler: Scaler) -> DataFrame:
    """Stateless detections of single bars."""
    return score(bars, scaler, "simple")


def score_on_interval(
    bars: DataFrame, symbols, scaler: Scaler, path: str, interval: int | None = 60, seconds: int = FRESH_SECONDS,
):
    """Detections of all requested symbols' latest bars, per trigger.

    A symbol without a bar in the batch is scored from the state if its last bar is less than ``seconds``
    behind the newest; one without such a bar, or with one that has no known price, gets a row under ``errors``.
    Whatever else goes wrong fails the batch, which is then taken again.
    """
    wanted = requested(symbols)

    def write(batch: DataFrame, batch_id: int) -> None:
        state = advance_latest(batch, path, batch_id, [s.upper() for s in wanted], seconds)
        asked = state.sparkSession.createDataFrame([(s, s.upper()) for s in wanted], "asked string, symbol string")
        known = state.join(F.broadcast(asked), "symbol").withColumn("symbol", F.col("asked")).drop("asked")
        good = known.filter(is_priced(known.columns))
        score(good, scaler, "simple").write.mode("overwrite").parquet(batch_folder(path, "detections", batch_id))
        missing = asked.select(F.col("asked").alias("symbol")).join(good.select("symbol"), "symbol", "left_anti")
        failed = missing.join(known.select("symbol", F.lit(True).alias("seen")), "symbol", "left").select(
            "symbol", F.when(F.col("seen"), F.lit("no known price")).otherwise(F.lit("no fresh bar")).alias("error"))
        failed.write.mode("overwrite").parquet(batch_folder(path, "errors", batch_id))

    return each_batch(bars, path, write, interval=interval)


def observed(messages: DataFrame, name: str = "feed") -> DataFrame:
    """Counts of each micro-batch for a query listener, without another pass."""
    bad = flag(F.size("reasons") > 0)
    return messages.observe(
        name, F.count(F.lit(1)).alias("processed"), F.sum(bad).alias("failed"), F.sum(1 - bad).alias("ok"))
