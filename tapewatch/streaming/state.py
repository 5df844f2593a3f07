"""State per symbol in a state store: the latest row, and bars put in order before their features are computed.

The store is RocksDB with change logs, so a micro-batch reads and writes what its own symbols have, whatever the
number of symbols kept.  Timers in event time release and forget; event times count in milliseconds there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tapewatch.operators.lookups import FRESH_SECONDS
from tapewatch.operators.series import priced
from tapewatch.session import ship_package
from tapewatch.streaming.indicators import FORGET_AFTER, INPUT, OUTPUT, OUTPUT_COLUMNS, STATE, advance
from tapewatch.streaming.run import batch_folder, each_batch

BAR_COLUMNS = [c.split()[0] for c in INPUT.split(", ")]
WAITING = INPUT.replace("ts timestamp", "us long")
KEPT = STATE.replace("last_ts timestamp", "last_us long")
MAX_DELAY = 3600          # seconds a bar may be behind the newest one


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB; changes only are uploaded per micro-batch."""
    prefix = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{prefix}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{prefix}.rocksdb.changelogCheckpointing.enabled", "true")


# ---------------------------------------------------------------- latest row
class Latest(StatefulProcessor):
    """Keeps the row with the largest (us, seq); a timer at that time forgets it, as the watermark lags by the time a row stays fresh.

    Times are microseconds since the epoch, so that no worker's time zone matters.
    """

    def __init__(self, schema: str, columns: list[str]) -> None:
        self._schema, self._columns = schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._latest = handle.getValueState("latest", self._schema)

    def _told(self, symbol: str, row: tuple, gone: bool) -> Row:
        return Row(**dict(zip(["symbol", *self._columns, "gone"], [symbol, *row, gone], strict=True)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self._latest.get()) if self._latest.exists() else None
        best = before
        for row in rows:
            one = tuple(row[c] for c in self._columns)
            if best is None or (one[0], one[1] is not None, one[1] or 0) > (best[0], best[1] is not None, best[1] or 0):
                best = one
        if best is not before:
            if before is not None:
                self._handle.deleteTimer(before[0] // 1000)
            self._latest.update(best)
            self._handle.registerTimer(best[0] // 1000)
            yield self._told(key[0], best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._latest.exists():
            last = tuple(self._latest.get())
            self._latest.clear()
            yield self._told(key[0], last, True)

    def close(self) -> None:
        pass


def latest_changes(observations: DataFrame, seconds: int = FRESH_SECONDS) -> DataFrame:
    """The latest row (symbol, ts, seq and all else) of each symbol whenever it changes, and once more with ``gone`` when it
    is ``seconds`` old.

    Age is that against the newest row of all.  Symbols match in upper case.  Rows may come in any order; one that is no
    longer fresh when it comes changes nothing.  Rows without symbol or time are left out.
    """
    ship_package(observations.sparkSession)
    use_rocksdb(observations.sparkSession)
    rest = [c for c in observations.columns if c not in ("symbol", "ts", "seq")]
    rows = observations.filter("symbol is not null and ts is not null").select(
        F.upper("symbol").alias("symbol"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), *rest)
    columns = ["us", "seq", *rest]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    changed = rows.withWatermark("ts", f"{seconds} seconds").groupBy("symbol").transformWithState(
        Latest(schema, columns), f"symbol string, {schema}, gone boolean", "Append", "EventTime")
    return changed.select("symbol", F.timestamp_micros("us").alias("ts"), "seq", *rest, "gone")


def keep_latest(observations: DataFrame, path: str, seconds: int = FRESH_SECONDS, interval: int | None = None):
    """Changes of the latest rows under ``changes``, a folder per micro-batch; ``latest_state`` reads the rows kept."""
    return each_batch(
        latest_changes(observations, seconds), path,
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(batch_folder(path, "changes", batch_id)), interval=interval)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The rows kept by the stream whose checkpoint lies under ``path``, as of its last micro-batch."""
    use_rocksdb(spark)
    found = spark.read.format("statestore").option("stateVarName", "latest").load(f"{path}/checkpoint").select("key.symbol", "value.*")
    return found.select("symbol", F.timestamp_micros("us").alias("ts"), *[c for c in found.columns if c not in ("symbol", "us")])


# ---------------------------------------------------------------- bars in order
class Ordered(StatefulProcessor):
    """Holds bars until the watermark has passed them, then takes them in order of (ts, seq) through ``advance``."""

    def __init__(self, forget_after: int) -> None:
        self._forget = forget_after * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", WAITING)
        self._kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times: set[int] = set()
        for bars in rows:
            us = bars["ts"].astype("datetime64[us]").astype("int64")
            held = [(int(at), int(seq), *map(float, prices), int(volume)) for at, seq, *prices, volume in zip(us, *(bars[c] for c in BAR_COLUMNS[1:]), strict=True)]
            self._waiting.appendList(held)
            times |= {bar[0] // 1000 + 1 for bar in held}
        for at in times:  # a bar of the watermark's own millisecond can still have company
            self._handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(bar) for bar in self._waiting.get()]
        ready = sorted((bar for bar in waiting if bar[0] // 1000 < watermark), key=lambda bar: bar[:2])
        kept = tuple(self._kept.get()) if self._kept.exists() else None
        if not ready:  # an earlier timer of this micro-batch released them, or the symbol has been silent
            if kept is not None and not waiting and kept[0] // 1000 + self._forget <= watermark:
                self._kept.clear()
            return
        left = [bar for bar in waiting if bar[0] // 1000 >= watermark]
        if left:
            self._waiting.put(left)
        else:
            self._waiting.clear()
        if kept is not None and ready[0][0] // 1000 - kept[0] // 1000 >= self._forget:
            kept = None
        bars = pd.DataFrame(ready, columns=BAR_COLUMNS)
        bars["ts"] = pd.to_datetime(bars["ts"], unit="us")
        out, after = advance(bars, tuple(kept[2:]) if kept else None)
        self._kept.update((ready[-1][0], ready[-1][1], *after))
        self._handle.registerTimer(ready[-1][0] // 1000 + self._forget)
        out.insert(0, "symbol", key[0])
        out["late"] = False
        yield out[OUTPUT_COLUMNS]

    def close(self) -> None:
        pass


def ordered_features(bars: DataFrame, max_delay: int = MAX_DELAY, forget_after: int = FORGET_AFTER) -> DataFrame:
    """The features of every streamed bar, equal to the table form although bars come out of order.

    A bar comes out once the newest bar of any symbol is more than ``max_delay`` seconds ahead of it.  What is farther behind when it
    comes is left out and counted by Spark.  Bars without known, finite prices are left out, as in
    the table form.  After ``forget_after`` seconds without a bar a symbol starts anew.  What is held per symbol are the bars
    of ``max_delay`` and a state of fixed size.
    """
    ship_package(bars.sparkSession)
    use_rocksdb(bars.sparkSession)
    return priced(bars).select("symbol", *BAR_COLUMNS).withWatermark("ts", f"{max_delay} seconds").groupBy("symbol").transformWithStateInPandas(
        Ordered(forget_after), StructType.fromDDL(OUTPUT), "Append", "EventTime")


# ---------------------------------------------------------------- ticks to bars
class Windows(StatefulProcessor):
    """Open windows of a symbol; a tick of a window that the watermark has closed comes out as it is.

    Spark's own watermark lags by ``shift`` milliseconds more than the one that closes windows, so that late ticks get here.
    """

    def __init__(self, width: int, shift: int) -> None:
        self._width, self._shift = width, shift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "start long", "first long, last long, open double, high double, low double, close double, volume long")

    def _out(self, symbol: str, late: bool, **columns) -> pd.DataFrame:
        out = pd.DataFrame({c.split()[0]: pd.Series(columns.get(c.split()[0]), dtype=kind) for c, kind in zip(WINDOW.split(", "), _KINDS, strict=True)})
        out["symbol"], out["late"] = symbol, late
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        closed = watermark + self._shift if watermark > 0 else None
        for ticks in rows:
            start = ticks["us"] // 1000 // self._width * self._width
            late = start + self._width <= closed if closed is not None else pd.Series(False, index=ticks.index)
            if late.any():
                told = ticks[late]
                yield self._out(key[0], True, us=told["us"].to_numpy(), tick=told["tick"].to_numpy(), price=told["price"].to_numpy(), qty=told["qty"].to_numpy())
            for begin, group in ticks[~late].sort_values("tick").groupby(start[~late]):
                self._add((int(begin),), group)

    def _add(self, begin: tuple[int], group: pd.DataFrame) -> None:
        """``group`` is in order of ``tick``."""
        first, last = int(group["tick"].iloc[0]), int(group["tick"].iloc[-1])
        opens, closes = float(group["price"].iloc[0]), float(group["price"].iloc[-1])
        high, low, volume = float(group["price"].max()), float(group["price"].min()), int(group["qty"].sum())
        if self._open.containsKey(begin):
            f, l, o, h, w, c, v = self._open.getValue(begin)  # noqa: E741
            first, opens = min((first, opens), (f, o))
            last, closes = max((last, closes), (l, c))
            high, low, volume = max(high, h), min(low, w), volume + v
        else:
            self._handle.registerTimer(begin[0] + self._width - self._shift)
        self._open.updateValue(begin, (first, last, opens, high, low, closes, volume))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin = expiredTimerInfo.getExpiryTimeInMs() + self._shift - self._width
        if self._open.containsKey((begin,)):
            _, _, opens, high, low, closes, volume = self._open.getValue((begin,))
            self._open.removeKey((begin,))
            yield self._out(key[0], False, us=[begin * 1000], open=[opens], high=[high], low=[low], close=[closes], volume=[volume])

    def close(self) -> None:
        pass


WINDOW = "symbol string, us long, open double, high double, low double, close double, volume long, late boolean, tick long, price double, qty long"
_KINDS = ("object", "int64", "float64", "float64", "float64", "float64", "Int64", "object", "Int64", "float64", "Int64")


def bars_and_late(ticks: DataFrame, width: int, order: str, delay: int = MAX_DELAY, keep: int = 7 * 86400) -> DataFrame:
    """Bars of ``width`` seconds, each once the watermark has passed its end, and as ``late`` the ticks that came after that.

    ``ticks`` has symbol, ts, price, qty and the whole number ``order``.  The watermark is ``delay`` seconds behind the newest
    tick of earlier micro-batches.  A tick is late if its window ends at or before it, and then is in no bar; any other
    tick is in its bar.  So bars and late ticks add up to all ticks that are at most ``keep`` seconds behind the watermark; still older
    ones are left out and counted by Spark (rows dropped by watermark).  Ticks without symbol, time, price, quantity or order are
    left out, too.  Late rows have ts, tick, price and qty; bars all else.
    """
    ship_package(ticks.sparkSession)
    use_rocksdb(ticks.sparkSession)
    rows = ticks.select("symbol", "ts", F.unix_micros("ts").alias("us"), F.col(order).cast("long").alias("tick"), "price", F.col("qty").cast("long").alias("qty"))
    rows = rows.dropna()
    found = rows.withWatermark("ts", f"{delay + keep} seconds").groupBy("symbol").transformWithStateInPandas(
        Windows(width * 1000, keep * 1000), StructType.fromDDL(WINDOW), "Append", "EventTime")
    return found.select("symbol", F.timestamp_micros("us").alias("ts"), *[c.split()[0] for c in WINDOW.split(", ")][2:])
