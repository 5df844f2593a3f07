"""Messages, payloads, quotes and CSV folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapewatch.sources import bars as br
from tapewatch.sources import feed
from tapewatch.sources import quotes as qt

BAR = {"symbol": "JNJ", "timestamp": "2025-09-22T02:28:58.708056619Z", "open": 174.69, "high": 177.16, "low": 173.33, "close": 176.19, "volume": 25617300}
NEW = {"message_type": "MARKET_DATA", "symbol": "JNJ", "data": {**BAR, "previous_close": 174.16}, "ingestion_timestamp": "2025-09-22T03:00:00Z"}
OLD = {"messageType": "MARKET_DATA", "symbol": "JNJ", "timestamp": "2025-09-22T02:00:00Z",
       "data": {k: BAR[k] for k in ("open", "high", "low", "close", "volume")} | {"adjClose": 170.0}}


def read(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return feed.read_messages(spark.createDataFrame(rows, "id int, body string"))


def reasons(spark, body):
    return read(spark, body).first().reasons


def without(message, *keys):
    return {k: v for k, v in message.items() if k not in keys}


def test_both_dialects(spark):
    new, old = feed.good_bars(read(spark, NEW, OLD), "id").orderBy("id").collect()
    assert new.ts == dt.datetime(2025, 9, 22, 2, 28, 58, 708056) and new.previous_close == 174.16
    assert old.ts == dt.datetime(2025, 9, 22, 2) and (old.adj_close, old.previous_close, old.volume) == (170.0, None, 25617300)


@pytest.mark.parametrize("body, reason", [
    ("{bad", ["not_json"]), ("[1]", ["not_json"]), (without(NEW, "message_type"), ["no_type"]),
    (without(NEW, "symbol"), ["no_symbol"]), ({**NEW, "data": without(NEW["data"], "volume")}, ["no_volume"]),
    ({**without(NEW, "ingestion_timestamp"), "data": without(NEW["data"], "timestamp")}, ["no_timestamp"]),
    ({**NEW, "data": {**NEW["data"], "close": None}}, ["not_convertible"]),
    ({**NEW, "data": {**NEW["data"], "close": "n/a"}}, ["not_convertible"]),
    ("{}", ["no_type", "no_timestamp", "no_symbol", "no_data", "no_open", "no_high", "no_low", "no_close", "no_volume"]),
])
def test_reasons(spark, body, reason):
    assert reasons(spark, body) == reason


def test_empty_time_falls_through(spark):
    got = feed.good_bars(read(spark, {**NEW, "data": {**NEW["data"], "timestamp": ""}})).first()
    assert got.ts == dt.datetime(2025, 9, 22, 3)


def test_null_previous_close_is_kept(spark):
    got = feed.good_bars(read(spark, {**NEW, "data": {**NEW["data"], "previous_close": None}})).first()
    assert got.previous_close is None and got.close == 176.19


def test_accounting_of_nothing_and_of_bad_only(spark):
    assert tuple(feed.accounting(read(spark, "{x", "{y")).first()) == (2, 0, 2)
    assert tuple(feed.accounting(read(spark, "{x").limit(0)).first()) == (0, 0, 0)


def test_content_dedup_is_per_minute(spark):
    times = ["2024-01-01 00:00:05", "2024-01-01 00:00:59", "2024-01-01 00:01:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    ids = [r[0] for r in df.select(feed.content_dedup_id(F.lit("b"), F.lit("g"), F.to_timestamp("t"))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_payload_defaults(spark):
    payload = json.dumps([{"data": {"symbol": "A", "close": 2.0}}, {"close": 3.0, "timestamp": "2024-01-01T00:00:00Z"}])
    rows = feed.explode_payload(spark.createDataFrame([(payload,)], "p string"), "p").collect()
    assert [(r.symbol, r.close, r.volume, r.previous_close) for r in rows] == [("A", 2.0, 0, 0.0), ("UNKNOWN", 3.0, 0, 0.0)]


def test_chunks_of_ten(spark):
    df = spark.range(25).selectExpr("'A' symbol", "cast(id as timestamp) ts", "id seq")
    chunked = feed.chunk_totals(feed.chunk_messages(df), F.col("seq") < 20).orderBy("batch_no").collect()
    assert [(r.batch_no, r.successful, r.failed) for r in chunked] == [(0, 10, 0), (1, 10, 0), (2, 0, 5)]


def test_quote_list_edges(spark):
    schema = "symbol string, quotes array<struct<open:double,high:double,low:double,close:double,volume:long>>"
    q = (1.0, 1.0, 1.0, 100.0, 5)
    rows = qt.latest_of_list(spark.createDataFrame([("A", []), ("B", [q])], schema)).orderBy("symbol").collect()
    assert rows[0].error == "No quotes returned for symbol: A" and rows[1].previous_close == 99.0


def test_symbol_list(spark):
    got = spark.range(1).select(qt.symbol_list(F.lit(" aapl, msft ,tsla"), 2)).first()[0]
    assert got == ["AAPL", "MSFT"]
    with pytest.raises(Exception, match="No symbols"):
        spark.range(1).select(qt.symbol_list(F.lit(" "))).collect()


def test_bar_folder(spark, tmp_path):
    (tmp_path / "AAPL.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,2,0.5,1.5,1.4,100\nnonsense,1,2,0.5,1.5,1.4,100\n")
    (tmp_path / "BRK.B.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-03,3,4,2,3.5,7.0\n")
    (tmp_path / "X+ #1.csv").write_text("Volume,Close,Low,High,Open,Date\n9,3.5,2,4,3,2024-01-03\n")
    (tmp_path / "note.txt").write_text("Date,no\n")
    rows = br.read_bar_folder(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r.symbol, r.close, r.volume) for r in rows] == [("AAPL", 1.5, 100), ("BRK.B", 3.5, 7), ("X+ #1", 3.5, 9)]
    assert br.read_bar_folder(spark, str(tmp_path), limit=1).count() == 1
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        br.read_bar_folder(spark, str(tmp_path / "empty"))


def test_cleaning_without_a_column_gives_nothing(spark):
    df = spark.createDataFrame([("A", "2024-01-01", 1.0)], "symbol string, Date string, Open double")
    assert br.clean_bars(df).count() == 0
