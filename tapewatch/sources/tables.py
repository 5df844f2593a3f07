"""Bars out of the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.sources.bars import ticks_to_bars


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table with zone-less times read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def brand_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades of a part's brand at the unit price."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tick"))


def bars_brand(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per brand."""
    return ticks_to_bars(brand_ticks(spark, folder), "day")


def event_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trades of their type; each counts one."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.lit(1).cast("long").alias("qty"), "event_id")


def bars_event(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars per event type."""
    return ticks_to_bars(event_ticks(spark, folder), "hour", "event_id")


def bars_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per order priority."""
    ticks = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("qty"), "o_orderkey")
    return ticks_to_bars(ticks, "day", "o_orderkey")
