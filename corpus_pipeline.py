"""From raw documents to shuffled training shards, stage by stage.

Each stage takes the session, what its predecessor kept and the folder of tables, and returns a table that
is written as Parquet and read again as the next one's documents.  All but the last return the
columns of ``documents``; the last adds shard and slot.

Null texts count as empty ones and go with the quality rules, as do all texts of under ten words.  Of equal texts and
near copies the row with the smallest doc_id stays (null ids last); of rows equal in id and text, one.  Further
columns are carried along under their names.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.llm import mixing, near_copies, quality, sharding, templates
from tapewatch.session import scratch

SHARDS = 8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, shuffled."""
    return mixing.mixed(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs``, then shard and slot, with underscores behind if documents have columns called so."""
    rows = sharding.sharded(docs, SHARDS)
    columns = [F.col(f"row._{i}").alias(f"_{i}") for i in range(len(docs.columns))]
    return rows.select(*columns, "shard", "slot").toDF(*docs.columns, *(_free(name, docs.columns) for name in ("shard", "slot")))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality),
    ("simhash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("sharding", in_shards),
]

# Fingerprints, sketches and the seeded hashes of the shards are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
