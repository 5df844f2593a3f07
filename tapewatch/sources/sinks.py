"""Where detections and fitted models go."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tapewatch.operators.networks import Network
from tapewatch.operators.scaling import Scaler
from tapewatch.schema import FEATURES, STORED_PARAMETERS, require
from tapewatch.session import small_side


def write_detections(detections: DataFrame, path: str) -> None:
    """Archive detections by month of the bar.

    Rebalancing gives a small month one file and splits a large one.
    """
    _by_month(detections).write.partitionBy("month").mode("append").parquet(path)


def _by_month(detections: DataFrame) -> DataFrame:
    dated = detections.withColumn("month", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM"))
    return dated.hint("rebalance", "month")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_MANIFEST = "batch_id long, attempt string, committed_at timestamp, n_rows long"


def write_batch(detections: DataFrame, path: str, batch_id: int) -> None:
    """Archive the detections of one batch; a batch that is written again replaces what it wrote before.

    Each attempt writes a folder of its own, which counts from the moment the manifest names it: one appended
    line per attempt, of which the last one of a batch holds.  A broken attempt is never named, so readers
    see each batch whole and once, whatever is tried again or replayed.  ``sweep`` removes the rest.
    """
    spark, attempt = detections.sparkSession, uuid.uuid4().hex
    folder = f"{path}/rows/batch_id={batch_id}/attempt={attempt}"
    _by_month(detections).write.partitionBy("month").parquet(folder)
    try:
        n_rows = spark.read.parquet(folder).count()
    except AnalysisException:  # a batch without rows has no files to read a schema from
        n_rows = 0
    line = spark.createDataFrame([(batch_id, attempt, n_rows)], "batch_id long, attempt string, n_rows long")
    line.select("batch_id", "attempt", F.current_timestamp().alias("committed_at"), "n_rows").coalesce(1).write.mode("append").json(f"{path}/manifest")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, attempt, committed_at and n_rows of what each batch wrote last."""
    lines = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    last = lines.groupBy("batch_id").agg(F.max_by(F.struct("attempt", "committed_at", "n_rows"), F.struct("committed_at", "attempt")).alias("last"))
    return last.select("batch_id", "last.*")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The archived detections of all batches, each once, with ``batch_id`` and ``month``.

    Folders of attempts that don't count are pruned before they are read.
    """
    rows = spark.read.parquet(f"{path}/rows")
    named = batches(spark, path).select(F.col("batch_id").alias("_batch"), F.col("attempt").alias("_attempt"))
    on = (F.col("batch_id") == F.col("_batch")) & (F.col("attempt") == F.col("_attempt"))
    return rows.join(small_side(named), on, "left_semi").drop("attempt")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove the folders of attempts that don't count, and tell how many; not while a batch is being written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/batch_id=*/attempt=*")
    store = pattern.getFileSystem(conf)
    counted = {(r.batch_id, r.attempt) for r in batches(spark, path).select("batch_id", "attempt").toLocalIterator()}
    removed = 0
    for found in store.globStatus(pattern):
        folder = found.getPath()
        key = (int(folder.getParent().getName().split("=")[1]), folder.getName().split("=")[1])
        if key not in counted:
            store.delete(folder, True)
            removed += 1
    return removed


@dataclass(frozen=True)
class Artefacts:
    """Everything a scorer needs."""

    features: tuple[str, ...]
    parameters: dict[str, float]
    scaler: Scaler
    networks: dict[str, Network]


def save_artefacts(spark: SparkSession, artefacts: Artefacts, path: str) -> None:
    order = [(i, c) for i, c in enumerate(artefacts.features)]
    spark.createDataFrame(order, "position int, name string").coalesce(1).write.json(f"{path}/features")
    spark.createDataFrame(
        list(artefacts.parameters.items()), "name string, value double").coalesce(1).write.json(f"{path}/parameters")
    scaler = artefacts.scaler
    spark.createDataFrame(
        [(c, scaler.means[c], scaler.scales[c]) for c in scaler.means],
        "name string, mean double, scale double").coalesce(1).write.parquet(f"{path}/scaler")
    layers = [
        (name, i, list(weight.shape), weight.ravel().tolist(), bias.tolist(), network.head)
        for name, network in artefacts.networks.items()
        for i, (weight, bias) in enumerate(network.layers())]
    spark.createDataFrame(
        layers, "network string, layer int, shape array<int>, weight array<double>, bias array<double>, head string"
    ).coalesce(1).write.parquet(f"{path}/networks")


def load_artefacts(spark: SparkSession, path: str) -> Artefacts:
    """All parts or an error: nothing is scored with half a model."""
    features = tuple(
        r.name for r in spark.read.schema("position int, name string").json(f"{path}/features").orderBy("position").collect())
    require(features, FEATURES)
    parameters = {
        r.name: r.value for r in spark.read.schema("name string, value double").json(f"{path}/parameters").collect()}
    require(parameters, STORED_PARAMETERS)
    rows = spark.read.parquet(f"{path}/scaler").collect()
    scaler = Scaler({r.name: r.mean for r in rows}, {r.name: r.scale for r in rows})
    require(scaler.means, FEATURES)
    networks: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/networks").orderBy("network", "layer").collect():
        networks.setdefault(r.network, []).append(r)
    if set(networks) != {"autoencoder", "classifier"}:
        raise ValueError(f"networks found: {sorted(networks)}")
    built = {name: Network.from_layers(
        rows[0].head, [(r.shape, r.weight, r.bias) for r in rows]) for name, rows in networks.items()}
    return Artefacts(features, parameters, scaler, built)
