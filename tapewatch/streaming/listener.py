"""Counts and watermarks of every micro-batch, reported while the stream runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "query string, run string, batch_id long, watermark string, input_rows long, name string, processed long, failed long, ok long"


class BatchMetrics(StreamingQueryListener):
    """Writes what ``observe`` counted in a micro-batch as one small file per batch and observation.

    The file's name is made of the query and the batch, so a micro-batch that is tried again is reported once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            counts = {k: 0 if v is None else v for k, v in row.asDict().items()}
            self._write(f"{progress.id}-{progress.batchId}-{name}", {
                "query": str(progress.id), "run": str(progress.runId), "batch_id": progress.batchId,
                "watermark": progress.eventTime.get("watermark"), "input_rows": progress.numInputRows, "name": name, **counts})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _write(self, label: str, line: dict) -> None:
        context = self._spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{label}.json")
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(json.dumps(line).encode() + b"\n"))
        out.close()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All reports below ``path``, after those still under way have come in."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.read.schema(METRICS).json(path)
