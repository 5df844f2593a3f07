"""The archive that stands replays, and bars that lie by symbol."""

import datetime as dt

from pyspark.sql import functions as F

from tapewatch.operators.features import history_features
from tapewatch.operators.series import DAILY_ROWS, lay_out
from tapewatch.session import scratch
from tapewatch.sources import bars as br
from tapewatch.sources import sinks
from tapewatch.streaming import run as st


def detected(spark, ids):
    rows = [(f"S{i % 3}", 1704067200 + i * 86400 * 9, i) for i in ids]
    return spark.createDataFrame(rows, "symbol string, timestamp long, id long")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_batch_counts_once(spark):
    path = scratch(spark, "archive")
    sinks.write_batch(detected(spark, range(5)), path, 0)
    sinks.write_batch(detected(spark, range(5, 8)), path, 1)  # a try with half of the rows
    sinks.write_batch(detected(spark, range(5, 12)), path, 1)
    sinks.write_batch(detected(spark, []), path, 2)
    assert ids(sinks.read_batches(spark, path)) == list(range(12))
    assert {(r.batch_id, r.n_rows) for r in sinks.batches(spark, path).collect()} == {(0, 5), (1, 7), (2, 0)}
    # a try that broke off between its rows and the manifest
    detected(spark, range(50, 60)).withColumn("month", F.lit("2024-01")).write.partitionBy("month").parquet(f"{path}/rows/batch_id=3/attempt=x")
    assert ids(sinks.read_batches(spark, path)) == list(range(12))
    assert sinks.sweep(spark, path) == 2
    assert ids(sinks.read_batches(spark, path)) == list(range(12)) and sinks.sweep(spark, path) == 0
    march = sinks.read_batches(spark, path).filter("month = '2024-03'")
    assert 0 < march.count() < 12 and "PartitionFilters: [isnotnull(month" in march._jdf.queryExecution().toString()


def test_a_replayed_stream_counts_once(spark):
    folder, path = scratch(spark, "in"), scratch(spark, "archive")
    for part in (range(4), range(4, 9)):
        detected(spark, part).coalesce(1).write.mode("append").parquet(folder)
    for checkpoint in ("first", "again"):  # the second run has lost its checkpoint and replays everything
        stream = st.stream_files(spark, folder, detected(spark, []).schema, maxFilesPerTrigger=1)
        st.finish(st.each_batch(stream, f"{path}/{checkpoint}", lambda batch, batch_id: sinks.write_batch(batch, path, batch_id)))
    assert ids(sinks.read_batches(spark, path)) == list(range(9))


def test_features_of_bars_by_symbol_need_no_shuffle(spark, bars):
    made = bars({f"S{i}": [10.0 + j % 7 for j in range(70)] for i in range(9)}).withColumn("previous_close", F.lit(None).cast("double"))
    path = scratch(spark, "by-symbol")
    br.write_by_symbol(made, path, 4)
    back = br.read_by_symbol(spark, path)
    assert sorted(map(tuple, back.drop("month").collect())) == sorted(map(tuple, made.collect()))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    features = history_features(lay_out(back, DAILY_ROWS)).rows()
    assert "Exchange" not in plan(features) and "Window" in plan(features)
    assert "Exchange" in plan(history_features(lay_out(made, DAILY_ROWS)).rows())
    joined = back.join(br.read_by_symbol(spark, path).groupBy("symbol").agg(F.max("close").alias("top")).hint("merge"), "symbol")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    one = back.filter("symbol = 'S3' and month = '2024-02'")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # Spark tells of buckets in such plans only
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(back.filter("symbol = 'S3' and month = '2024-02'"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert one.count() == 29
    assert {r.ts.month for r in one.collect()} == {2} and one.filter(F.col("ts") < dt.datetime(2024, 2, 1)).count() == 0
