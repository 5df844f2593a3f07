"""Starting streams and the sinks they write to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.schema import DEFAULT_SYMBOLS

# Bounds of the scoring interval in seconds.
MIN_INTERVAL, MAX_INTERVAL = 10, 300
# Bytes of input one micro-batch takes, so that what a task holds of a symbol stays bounded.
BYTES_PER_BATCH = 256 << 20


def clamped(interval: int) -> int:
    return min(max(interval, MIN_INTERVAL), MAX_INTERVAL)


def requested(symbols) -> list[str]:
    """The symbols asked for, or the default list for an empty request."""
    return list(symbols) if symbols else list(DEFAULT_SYMBOLS)


def trigger(interval: int | None) -> dict:
    """Every ``interval`` seconds, or all that is there and then stop."""
    if interval is None:
        return {"availableNow": True}
    return {"processingTime": f"{clamped(interval)} seconds"}


def stream_files(spark: SparkSession, folder: str, schema, form: str = "parquet", **options) -> DataFrame:
    """Files as they arrive; ``maxFilesPerTrigger`` takes the place of the bound in bytes."""
    reader = spark.readStream.format(form).schema(schema)
    if "maxFilesPerTrigger" not in options:
        reader = reader.option("maxBytesPerTrigger", BYTES_PER_BATCH)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's parquet file as a stream, zone-less times read as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = stream_files(spark, folder, schema, pathGlobFilter=f"{name}.parquet")
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def to_table(stream: DataFrame, path: str, interval: int | None = None):
    """Append to parquet; the sink's log makes each batch appear once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger(interval)).start())


def each_batch(
    stream: DataFrame, path: str, write: Callable[[DataFrame, int], None],
    mode: str = "append", interval: int | None = None,
):
    """Call ``write`` per micro-batch; it must overwrite what a lost try left."""
    return (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger(interval)).start())


def batch_folder(path: str, name: str, batch_id: int) -> str:
    return f"{path}/{name}/batch_id={batch_id}"


def kept_before(spark: SparkSession, path: str, name: str, batch_id: int, schema) -> DataFrame:
    """What the micro-batch before left under ``name``; nothing for the first one."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_folder(path, name, batch_id - 1))


def forget(spark: SparkSession, path: str, name: str, batch_id: int) -> None:
    """Remove what no later micro-batch, or try of one, reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(batch_folder(path, name, batch_id))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def finish(started) -> None:
    """Wait until an available-now stream has taken everything."""
    started.awaitTermination()


def left_out(started) -> int:
    """Rows that a stream's stateful operators have left out as too late, over the micro-batches Spark remembers.

    Spark remembers ``spark.sql.streaming.numRecentProgressUpdates`` of them; a listener hears of all.
    """
    return sum(op["numRowsDroppedByWatermark"] for progress in started.recentProgress for op in progress["stateOperators"])
