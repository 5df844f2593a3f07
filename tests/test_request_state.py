"""What the stream of requests keeps: a few rows for each symbol and slot, not one for each request."""

import datetime as dt

from pyspark.sql import functions as F

from tapewatch.registry import stream_queries as sq
from tapewatch.session import scratch
from tapewatch.streaming import requests as rq, run as st

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(second):
    return T0 + dt.timedelta(seconds=second)


def stream(spark, label, batches, schema):
    path = scratch(spark, label)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return st.stream_files(spark, f"{path}/*", spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)


def answers(spark, asked, seen, **options):
    requests = stream(spark, "asked", asked, "request_id long, symbol string, request_ts timestamp")
    bars = stream(spark, "seen", seen, "symbol string, ts timestamp, seq long, close double")
    path = scratch(spark, "answers")
    started = st.each_batch(
        rq.requests_as_of(requests, bars, **options), path, lambda batch, i: batch.write.mode("overwrite").parquet(st.batch_folder(path, "rows", i)))
    st.finish(started)
    return spark.read.parquet(f"{path}/rows"), [op for p in started.recentProgress for op in p["stateOperators"]]


def test_the_state_grows_with_symbols_and_slots(spark):
    # 600 requests within one slot of 300 seconds, in two micro-batches
    ids = [[(i, "a", at(100 + i % 90)) for i in range(k, 600, 2)] for k in range(2)]
    found, state = answers(spark, [*ids, [(9000, "~", at(9000))]], [[("A", at(50), 0, 1.0)], [("A", at(150), 0, 2.0)], [("~", at(9000), 0, 3.0)]])
    rows = found.filter("request_id < 600").select("request_id", "bar.close").collect()
    assert {r.request_id: r.close for r in rows} == {i: 2.0 if 100 + i % 90 >= 150 else 1.0 for i in range(600)} and len(rows) == 600
    assert max(op["numRowsTotal"] for op in state) <= 40  # shares of some slots of two symbols


def test_of_bars_at_one_instant_the_last_by_seq_counts(spark):
    end = [(99, "~", at(9000))]
    bars = [("A", at(10), 1, 1.0), ("A", at(10), 7, 2.0), ("A", at(10), None, 3.0), ("A", at(9), 9, 4.0), ("B", at(10), None, 5.0), ("B", at(9), 1, 6.0)]
    found, _ = answers(spark, [[(1, "A", at(10)), (2, "B", at(309)), (3, "B", at(310)), (None, "A", at(9)), (4, None, at(10))], end], [bars, [("~", at(9000), 0, 0.0)]])
    got = {(r.request_id, r.symbol): r.bar and r.bar.close for r in found.collect()}
    assert got == {(1, "A"): 2.0, (2, "B"): 5.0, (3, "B"): None, (None, "A"): 4.0, (4, None): None}


def test_parts_of_a_stream_are_dealt_in_one_pass(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sq, "scratch", lambda session, label: f"{tmp_path}/{label}")
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts")).mapInArrow(noted, "id long, ts timestamp")
    sq._shuffled_stream(spark, rows, "ts", "id", "parts")
    back = spark.read.parquet(*[f"{tmp_path}/parts/{i}" for i in range(6)])
    assert back.where("id != 1 or ts = timestamp_seconds(60)").count() == 1000 and back.count() == 1001
    assert read.value <= 2000  # once for the first and last time, once for the parts
