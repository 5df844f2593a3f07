"""Global shuffle into shards in two passes, in built-in functions only.

Pass one scatters the rows uniformly into buckets by a seeded hash, so many that a bucket
fits in memory.  Pass two puts each bucket in a canonical order, runs a Fisher-Yates shuffle
over it (Spark's ``shuffle``, seeded) and writes it.  The buckets one after
the other are the shuffled sequence; shard ``s`` of ``n`` is a stretch of it, so shard sizes
differ by one row at most.  A count per bucket, made from hashes without the texts, tells
each bucket where in the sequence it begins.

Everything is a function of the rows, the seed and the number of shards; a task that runs
again writes the same rows.  Nulls in any column are ordinary values, also in the id: the hash
takes id and text together, so neither a frequent id nor a frequent text fills a bucket.
Rows equal in id and text share a bucket; should there be more of them than a bucket holds,
the bucket is shuffled in pieces of ``bucket_rows``, so memory stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapewatch.session import scratch, small_side

# What one bucket holds, about: pass two needs some times as much per task.
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 50_000
SEED = 20_241


def _row_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write ``docs`` as Parquet below ``path``, one folder shard=0, 1, ... each.

    Columns: slot (0, 1, ... without gaps within a shard) and row, a struct of the columns of
    ``docs`` under the names they have there, so those may be called shard or slot, too.
    An empty table gives an empty folder that ``read_shards`` reads as no rows.
    """
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    at = {name: f"_{docs.columns.index(name)}" for name in (doc_id, text)}
    hashed = plain.withColumn("h", _row_hash(seed, F.col(at[doc_id]), F.xxhash64(at[text])))
    sizes = hashed.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(at[text]), F.lit(0)) + 64).alias("b")).head()
    total = sizes.n
    buckets = max(1, -(-(sizes.b or 0) // bucket_bytes), -(-total * 2 // bucket_rows))

    counted = hashed.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    # One row for each bucket; a bucket holds megabytes, so this running total is small.
    begins = counted.select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("begin"))

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 8))
    scattered = hashed.withColumn("bucket", _bucket(F.col("h"), buckets)).repartition(tasks, "bucket")
    record = F.struct("h", *plain.columns)
    in_bucket = Window.partitionBy("bucket").orderBy("h", *(F.col(c) for c in at.values()))
    pieces = (
        scattered.withColumn("k", F.row_number().over(in_bucket) - 1)
        .groupBy("bucket", F.floor(F.col("k") / bucket_rows).cast("int").alias("piece"))
        .agg(F.collect_list(record).alias("records"))
        .select("bucket", "piece", F.shuffle(F.sort_array("records"), seed).alias("records"))
        .select("bucket", "piece", F.posexplode("records").alias("k", "record"))
    )
    sequence = pieces.join(small_side(begins), "bucket").withColumn(
        "g", F.col("begin") + F.col("piece").cast("long") * bucket_rows + F.col("k"))
    least, more = divmod(total, shards)  # the first ``more`` shards have one row more
    head = more * (least + 1)
    g, rest = F.col("g"), max(1, least)
    slot = F.when(g < head, F.pmod(g, F.lit(least + 1))).otherwise(F.pmod(g - head, F.lit(rest)))
    shard = F.when(g < head, F.floor(g / (least + 1))).otherwise(more + F.floor((g - head) / rest))
    row = F.struct(*(F.col(f"record._{i}").alias(f"_{i}") for i in range(len(docs.columns))))
    (sequence.select(shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), row.alias("row"))
     .write.partitionBy("shard").parquet(path))


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote of a table with the columns of ``like``: shard, slot, row."""
    fields = ", ".join(f"_{i}: {f.dataType.simpleString()}" for i, f in enumerate(like.schema.fields))
    return spark.read.schema(f"slot long, row struct<{fields}>, shard int").parquet(path)


def sharded(docs: DataFrame, shards: int, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards written below the shared folder and read back: shard, slot, row."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    write_shards(docs, path, shards, seed, doc_id, text)
    return read_shards(spark, path, docs)
