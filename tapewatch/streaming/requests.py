"""Requests answered as they arrive: a stream of requests brought together with a stream of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.operators.lookups import FRESH_SECONDS
from tapewatch.operators.scaling import Scaler
from tapewatch.operators.series import is_priced
from tapewatch.plans.inference import score
from tapewatch.streaming.run import batch_folder, each_batch
from tapewatch.streaming.state import use_rocksdb

DELAY = 600  # seconds a request or a bar may be behind the newest of its stream
SPREAD = 4   # shares that the requests of one symbol and slot are dealt into
NO_BAR, NO_PRICE = "no fresh bar", "no known price"


def requests_as_of(requests: DataFrame, bars: DataFrame, max_age: int = FRESH_SECONDS, delay: int = DELAY) -> DataFrame:
    """Each request (request_id, symbol, request_ts) with ``bar``, its symbol's last one less than ``max_age`` seconds old, or null.

    ``bars`` has symbol, ts, seq and prices; symbols match in upper case.  Both streams may be out of order by
    ``delay`` seconds; a request is answered once both have come so far that no bar for its slot can follow.  What is
    kept are the requests not yet answered and the bars of ``max_age`` and ``delay`` seconds.  A repeated
    request, equal in all three columns, is answered once.

    Time is cut into slots of ``max_age`` seconds, so a request's bars lie in its own slot or the one before; each bar is
    there in its own and the next.  The state has a row for what came of a symbol in a slot, not one for each request: a micro-batch
    reads and writes it once.  The requests of one symbol and slot are dealt over ``SPREAD`` such rows, each with the slot's bars.
    """
    use_rocksdb(bars.sparkSession)
    asked = requests.select(
        F.upper("symbol").alias("_key"), F.pmod(F.xxhash64("request_id"), F.lit(SPREAD)).cast("int").alias("_share"), F.col("request_ts").alias("_at"),
        F.struct("request_id", "symbol", "request_ts").alias("_request")).withWatermark("_at", f"{delay} seconds")
    next_slot = F.timestamp_micros((_slot("ts", max_age) + 1) * (max_age * 1_000_000))
    seen = bars.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).select(
        F.upper("symbol").alias("_key"), F.explode(F.array("ts", next_slot)).alias("_at"),
        F.struct("ts", "seq", *[c for c in bars.columns if c not in ("symbol", "ts", "seq")]).alias("_bar"),
    ).withWatermark("_at", f"{delay + max_age} seconds")  # a copy lies up to a slot after its bar
    dealt = seen.select("_key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_share"), "_at", "_bar")
    kept = asked.unionByName(dealt, allowMissingColumns=True).groupBy("_key", "_share", F.window("_at", f"{max_age} seconds").alias("_slot")).agg(
        F.collect_set("_request").alias("_requests"), F.collect_list("_bar").alias("_bars"))

    def answered(request: Column) -> Column:
        asked_at = request["request_ts"]
        near = F.filter("_bars", lambda bar: (bar["ts"] <= asked_at) & (bar["ts"] > asked_at - F.expr(f"interval {max_age} seconds")))
        # the last one by time and seq
        last = F.reduce(near, F.get(near, F.lit(0)), lambda best, bar: F.when(
            F.struct(bar["ts"], bar["seq"]) > F.struct(best["ts"], best["seq"]), bar).otherwise(best))
        return F.struct(request["request_id"].alias("request_id"), request["symbol"].alias("symbol"), asked_at.alias("request_ts"), last.alias("bar"))

    return kept.select(F.inline(F.transform("_requests", answered)))


def _slot(time: str, seconds: int) -> Column:
    """Number of the span of ``seconds`` that a time lies in, in whole numbers throughout."""
    return F.expr(f"(unix_micros({time}) - pmod(unix_micros({time}), {seconds * 1_000_000}L)) div {seconds * 1_000_000}L")


def answer_requests(
    requests: DataFrame, bars: DataFrame, scaler: Scaler, path: str,
    max_age: int = FRESH_SECONDS, delay: int = DELAY, interval: int | None = None,
):
    """Detections of single bars for requests, and ``errors`` for those without a fresh bar or price, a folder per micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("request_id", "symbol", "request_ts", F.col("bar").isNull().alias("_none"), "bar.*").persist()
        good = rows.filter(~F.col("_none") & is_priced(rows.columns))
        score(good, scaler, "simple", keep=("request_id", "request_ts")).write.mode("overwrite").parquet(batch_folder(path, "detections", batch_id))
        bad = rows.filter(F.col("_none") | ~is_priced(rows.columns))
        bad.select("request_id", "symbol", "request_ts", F.when(F.col("_none"), NO_BAR).otherwise(NO_PRICE).alias("error")).write.mode(
            "overwrite").parquet(batch_folder(path, "errors", batch_id))
        rows.unpersist()

    return each_batch(requests_as_of(requests, bars, max_age, delay), path, write, interval=interval)
