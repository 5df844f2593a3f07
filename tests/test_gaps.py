"""Bars, messages and files that are not what they should be."""

import math

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import features as ft
from tapewatch.operators.labels import rule_labels
from tapewatch.operators.series import lay_out, price_gaps
from tapewatch.sources import bars as br, feed
from tapewatch.sources.quotes import latest_of_table

CLOSES = [10 + math.sin(i / 3) + i * 0.02 for i in range(120)]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_spoiled_bars_leave_no_trace(spark, bars, bad):
    whole = bars({"A": CLOSES})
    at = F.dayofyear("ts").isin(41, 80)
    spoiled = whole.withColumn("close", F.when(at, F.lit(bad)).otherwise(F.col("close")))
    columns = ["ts", "RSI", "MACD", "MACD_Signal", "BB_Position", "Price_Change", "Volatility_20d"]

    def indicators(df):
        return [tuple(r) for r in ft.history_features(lay_out(df)).rows().select(columns).orderBy("ts").collect()]

    want = indicators(whole.filter(~at))
    assert indicators(spoiled) == want and len(want) == 118
    assert price_gaps(spoiled).head() == ("A", 120, 2)
    assert not any(isinstance(x, float) and math.isnan(x) for row in want for x in row)


def test_unknown_features_match_no_rule(spark):
    row = spark.range(1).select(
        *[F.lit(float("nan")).alias(c) for c in ("Volume_Ratio", "Price_Change", "BB_Position", "Gap")], F.lit(12).alias("Hour"))
    got = rule_labels(row).head()
    assert (got.Unusual_Volume, got.Extreme_Price_Move, got.Gap_Trading, got.Potential_Manipulation, got.Target) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("volume", ['"NaN"', "1e30", '"abc"', "null"])
def test_bad_volumes_go_to_quarantine(spark, volume):
    bar = f'{{"symbol":"A","timestamp":"2024-01-02T00:00:00Z","open":1,"high":1,"low":1,"close":1,"volume":{volume}}}'
    body = f'{{"message_type":"MARKET_DATA","symbol":"A","timestamp":"2024-01-02T00:00:00Z","data":{bar}}}'
    messages = feed.read_messages(spark.createDataFrame([(body,), (None,)], "body string"))
    assert sorted(tuple(r.reasons) for r in feed.quarantine(messages, "body").collect()) == [("not_convertible",), ("not_json",)]
    records = feed.payload_records(spark.createDataFrame([(f"[{bar}, 3, {{}}]",), (f"[{bar}",), (None,)], "p string"), "p")
    assert sorted(r.reasons for r in records.collect()) == [[], ["not_an_object"], ["not_convertible"], ["not_json"], ["not_json"]]


def test_queue_events_that_cannot_be_read(spark):
    events = spark.createDataFrame([('{"Records":[{"messageId":"1","body":"{}"}]}',), ('{"Records":[{"messageId"',), ('{"Records":[]}',), (None,)], "e string")
    flat = feed.flatten_queue_events(events, "e")
    assert sorted((r.message_id or "", r.body or "") for r in flat.collect()) == [("", ""), ("", '{"Records":[{"messageId"'), ("1", "{}")]
    assert feed.accounting(feed.read_messages(flat)).head() == (3, 0, 3)


def test_bar_folder_with_odd_files(spark, tmp_path):
    (tmp_path / "A.csv").write_text("\n\nDate,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,NaN\n2024-01-01,1,2,0.5,2.5,7\n2024-01-01,1,2,0.5,3.5,8\n")
    wide = ",".join(f"x{i:06d}" for i in range(12_000))
    (tmp_path / "B c.csv").write_text(f'"Date","Open",High,Low,"Close",Volume,"a, b",{wide}\n2024-01-01,1,2,0.5,1e400,9,z\n')
    (tmp_path / "C.csv").write_text("")
    rows = br.read_bar_folder(spark, str(tmp_path)).orderBy("symbol", "ts", "seq").collect()
    assert [(r.symbol, r.close, r.volume) for r in rows] == [("A", 2.5, 7), ("A", 3.5, 8), ("A", 1.5, None), ("B c", None, 9)]


def test_symbols_that_paths_escape_survive(spark, bars, tmp_path):
    made = bars({"Brand#23": [1.0, 2.0], "a/b c%": [3.0]})
    with pytest.raises(Exception):
        br.write_symbol_csvs(made, str(tmp_path / "x"))  # a slash is no part of a file name
    br.write_symbol_csvs(made.filter("symbol = 'Brand#23'"), str(tmp_path / "y"))
    assert {r.symbol for r in br.read_bar_folder(spark, str(tmp_path / "y" / "named")).collect()} == {"Brand#23"}


def test_latest_quote_of_tied_rows(spark):
    rows = [("A", 1, 0, 2.0), ("A", 2, 0, 3.0), ("A", 2, 0, 4.0), ("B", 1, 0, 5.0)]
    df = spark.createDataFrame([(s, t, q, c, c, c, c, 1) for s, t, q, c in rows], "symbol string, ts int, seq int, open double, high double, low double, close double, volume long")
    assert sorted((r.symbol, r.close, r.previous_close) for r in latest_of_table(df).collect()) == [("A", 4.0, 3.0), ("B", 5.0, 4.95)]
