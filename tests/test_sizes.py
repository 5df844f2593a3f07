"""Steps whose tasks, files and comparisons must not grow faster than the rows."""

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import lookups as lk, series as sr, single_point as sp


def test_requests_meet_bars_of_their_slot_only(spark):
    from tapewatch.streaming import requests as rq

    times = spark.sql("select timestamp_micros(t) as t from values (-1L), (0L), (3999999L), (4000000L) as x(t)")
    assert [r[0] for r in times.orderBy("t").select(rq._slot("t", 4)).collect()] == [-1, 0, 0, 1]
    rate = spark.readStream.format("rate").load()
    asked = rate.selectExpr("value as request_id", "'A' as symbol", "timestamp as request_ts")
    bars = rate.selectExpr("'A' as symbol", "timestamp as ts", "0L as seq", "1.0 as close")
    assert "_slot" in rq.requests_as_of(asked, bars)._jdf.queryExecution().analyzed().toString()


def test_small_pieces_share_tasks(spark, monkeypatch):
    asked, placed = [], lk.placed

    def noted(df, order, pieces=None):
        asked.append(pieces)
        return placed(df, order, pieces)

    monkeypatch.setattr(lk, "placed", noted)
    rows = spark.range(200).select(
        (F.col("id") % 3).cast("string").alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    found = {(r.k, r.id): r.v for r in lk.carried(rows, ["k"], ["id"], "v", 5).collect()}
    last = {}
    for i in range(200):
        last[i % 3] = i if i % 7 == 0 else last.get(i % 3)
        assert found[str(i % 3), i] == last[i % 3]
    assert asked == [4] and len(found) == 200


def test_a_part_is_one_micro_batch(spark, tmp_path, monkeypatch):
    from tapewatch.registry import stream_queries as sq

    spark.range(400, numPartitions=8).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(sq, "scratch", lambda session, label: f"{tmp_path}/{label}")
    sq._mixed_up(spark, str(tmp_path), "parts")
    files = sorted(p.parent.name for p in tmp_path.glob("parts/*/*.parquet"))
    assert files == ["0", "1", "2", "3"] and spark.read.parquet(f"{tmp_path}/parts/*").count() == 400


@pytest.mark.parametrize("chunked", [False, True])
def test_windows_take_a_bounded_number_of_rows(spark, monkeypatch, chunked):
    ticks = spark.range(6000).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("close"))
    want = {(r.seq, r.rn) for r in sr.lay_out(ticks).rows().collect()}
    monkeypatch.setattr(sr, "WINDOW_ROWS", 1000)
    laid = sr.lay_out(ticks, rows_per_task=2048 if chunked else sr.ROWS_PER_TASK, halo=1024)
    assert {(r.seq, r.rn) for r in laid.rows().collect()} == want
    # 6000 rows, and in chunks about 9000 with their copies
    tasks = 9 if chunked else 6
    assert "RepartitionByExpression" in laid.frame._jdf.queryExecution().analyzed().toString()
    assert f", {tasks}" in "".join(x for x in laid.frame._jdf.queryExecution().analyzed().toString().splitlines() if "RepartitionByExpression" in x)


def test_many_symbols_are_dealt_by_their_rows(spark, bars, monkeypatch):
    rows = bars({f"S{i}": [10.0, 11.0, 12.0][: i % 3 + 1] for i in range(40)}).withColumn("previous_close", F.lit(9.0))
    want = sorted(map(tuple, sp.features_by_mode(rows, False, 366).collect()))
    monkeypatch.setattr(sr, "WINDOW_ROWS", 5)
    found = sp.features_by_mode(rows, False, 366)
    assert "RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, found.collect())) == want and len(want) == 40
