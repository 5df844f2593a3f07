"""Streams with state in a store: several micro-batches, out of order, against plain rules."""

import datetime as dt
import random

import numpy as np

from tapewatch.operators import features as ft
from tapewatch.operators.series import lay_out
from tapewatch.schema import FEATURES
from tapewatch.session import scratch
from tapewatch.operators.scaling import fit_scaler
from tapewatch.operators.single_point import simple_features
from tapewatch.streaming import feeds, indicators, listener, requests as rq, run as st, state

T0 = dt.datetime(2024, 1, 1)
SEEN = "symbol string, ts timestamp, seq long, price double, note string"
BAR = "symbol string, ts timestamp, seq long, open double, high double, low double, close double, volume long"


def files(spark, label, batches, schema):
    path = scratch(spark, label)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return st.stream_files(spark, path, spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)


def run(spark, stream, label):
    path = scratch(spark, label)
    st.finish(st.each_batch(stream, path, lambda batch, i: batch.write.mode("overwrite").parquet(st.batch_folder(path, "rows", i))))
    return path, spark.read.parquet(f"{path}/rows")


def test_latest_state(spark):
    draw = random.Random(4)
    batches = [[(draw.choice(["a", "A", "b", "c"]), T0 + dt.timedelta(seconds=draw.randrange(200 * n, 200 * n + 900)), draw.choice([i, None]), draw.choice([None, 1.5]), None)
                for i in range(25)] for n in range(5)]
    batches[1] += [("old", T0, 1, 1.0, "x"), (None, T0, 1, 1.0, "x"), ("none", None, 1, 1.0, "x")]
    batches[4] += [("edge", T0 + dt.timedelta(seconds=1800), 1, 1.0, "x"), ("new", T0 + dt.timedelta(seconds=2100), 1, 2.0, "ü")]
    batches[4] += [("just", T0 + dt.timedelta(seconds=1801), 2, 3.0, None), ("just", T0 + dt.timedelta(seconds=1801), 1, 4.0, None)]
    path, changes = run(spark, state.latest_changes(files(spark, "latest-in", batches, SEEN)), "latest")
    best = {}
    for s, ts, seq, price, note in (r for b in batches for r in b if r[0] and r[1]):
        key = (ts, seq is not None, seq or 0)
        if s.upper() not in best or key > best[s.upper()][0]:
            best[s.upper()] = (key, (ts, seq, price, note))
    want = {s: v for s, (k, v) in best.items() if k[0] > T0 + dt.timedelta(seconds=1800)}
    assert {"NEW", "JUST"} <= set(want) and "EDGE" not in want
    got = {r.symbol: (r.ts, r.seq, r.price, r.note) for r in state.latest_state(spark, path).collect()}
    assert {s: v[:2] for s, v in got.items()} == {s: v[:2] for s, v in want.items()}
    assert got["NEW"] == want["NEW"] and got["JUST"] == want["JUST"]
    # the changes, taken one after another, give the same state
    folded = {}
    for r in changes.orderBy("batch_id", "gone").collect():
        folded[r.symbol] = None if r.gone else (r.ts, r.seq)
    assert {s: v for s, v in folded.items() if v} == {s: v[:2] for s, v in got.items()}


def test_a_batch_writes_its_own_symbols_only(spark):
    many = [(f"s{i}", T0, 1, 1.0, None) for i in range(500)]
    few = [[("s1", T0 + dt.timedelta(seconds=k), 1, 1.0, None)] for k in range(1, 4)]
    _, changes = run(spark, state.latest_changes(files(spark, "many-in", [many, *few], SEEN)), "many")
    assert [r["count"] for r in changes.groupBy("batch_id").count().orderBy("batch_id").collect()] == [500, 1, 1, 1]


def walk(n, symbols="AB", seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in symbols:
        closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(symbol, T0 + dt.timedelta(minutes=10 * i), 0, float(c) * 1.01, float(c) * 1.02, float(c) * 0.98, float(c), int(rng.integers(1, 99)))
                 for i, c in enumerate(closes)]
    return rows


def test_ordered_features_equal_the_table_form(spark):
    rows = walk(80)
    rows += [("A", T0 + dt.timedelta(minutes=100), 1, 90.0, 91.0, 89.0, 90.5, 7), ("B", T0 + dt.timedelta(minutes=5), 0, 90.0, 91.0, 89.0, float("nan"), 7)]
    draw = random.Random(1)
    dealt = {}
    for r in rows:  # each bar comes with those up to 50 minutes before or after it
        dealt.setdefault(int((r[1] - T0).total_seconds() / 60 + draw.randrange(-25, 26)) // 100, []).append(r)
    batches = [draw.sample(dealt[k], len(dealt[k])) for k in sorted(dealt)]
    assert any(min(r[1] for r in b) < max(r[1] for r in a) for a, b in zip(batches, batches[1:]))
    _, got = run(spark, state.ordered_features(files(spark, "ordered-in", batches, BAR)), "ordered")
    newest = max(r[1] for r in rows)
    got = got.orderBy("symbol", "ts", "seq").toPandas()
    want = ft.history_features(lay_out(spark.createDataFrame(rows, BAR))).rows().filter(
        f"ts < timestamp'{newest - dt.timedelta(hours=1)}'").orderBy("symbol", "ts", "seq").toPandas()
    assert list(got["rn"]) == list(want["rn"]) and len(got) > 140 and list(got["ts"]) == list(want["ts"])
    for c in FEATURES:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


def test_bars_come_out_in_order_and_symbols_are_forgotten(spark):
    def bar(symbol, minutes, close):
        return (symbol, T0 + dt.timedelta(minutes=minutes), 0, close, close, close, close, 5)

    batches = [[bar("A", 50, 2.0), bar("A", 0, 1.0), bar("B", 10, 1.0)], [bar("A", 40, 3.0), bar("A", 130, 4.0)],
               [bar("A", 20, 9.0), bar("A", 200, 5.0)], [bar("B", 600, 7.0), bar("A", 599, 6.0)], [bar("C", 2000, 1.0)], [bar("C", 2001, 1.0)]]
    _, got = run(spark, state.ordered_features(files(spark, "forget-in", batches, BAR), 3600, 18_000), "forget")
    rows = {s: [(r.close, r.rn) for r in got.filter(f"symbol = '{s}'").orderBy("ts").collect()] for s in "AB"}
    assert rows["A"] == [(1.0, 1), (3.0, 2), (2.0, 3), (4.0, 4), (5.0, 5), (6.0, 1)] or rows["A"][:5] == [(1.0, 1), (9.0, 2), (3.0, 3), (2.0, 4), (4.0, 5)]
    assert rows["B"] == [(1.0, 1), (7.0, 1)]


def test_bars_and_late_ticks_add_up(spark):
    """The watermark is at 10:50 when a tick of 10:35 comes: its bar is still open, that of 9:59 is not."""
    def tick(i, hour, minute, price=1.0):
        return ("A", T0 + dt.timedelta(hours=hour, minutes=minute), price, 1, i)

    batches = [[tick(1, 9, 59), tick(2, 10, 5, 2.0), tick(3, 11, 50)], [tick(4, 10, 35, 5.0), tick(5, 9, 30, 9.0), tick(0, 10, 1, 7.0)],
               [tick(6, 12, 5)], [tick(7, 10, 59, 3.0), tick(8, 11, 30, 4.0)], [tick(9, 30, 0)], [tick(10, 31, 0)]]
    ticks = files(spark, "both-in", batches, "symbol string, ts timestamp, price double, qty long, i long")
    _, got = run(spark, state.bars_and_late(ticks, 3600, "i"), "both")
    rows = got.collect()
    assert sorted((r.tick, r.ts.hour, r.price) for r in rows if r.late) == [(5, 9, 9.0), (7, 10, 3.0)]
    assert sorted((r.ts.hour, r.open, r.high, r.low, r.close, r.volume) for r in rows if not r.late) == [
        (9, 1.0, 1.0, 1.0, 1.0, 1), (10, 7.0, 7.0, 2.0, 5.0, 3), (11, 1.0, 4.0, 1.0, 4.0, 2), (12, 1.0, 1.0, 1.0, 1.0, 1)]


def test_rolling_features_forget_silent_symbols(spark):
    def bar(symbol, hour, close):
        return (symbol, T0 + dt.timedelta(hours=hour), 0, close, close, close, close, 5)

    batches = [[bar("A", 0, 1.0), bar("B", 0, 1.0)], [bar("B", 1, 2.0)], [bar("B", 50, 3.0)], [bar("B", 51, 3.5)], [bar("A", 52, 4.0), bar("B", 52, 4.0)]]
    _, got = run(spark, indicators.rolling_features(files(spark, "silent-in", batches, BAR), 36_000), "silent")
    last = {r.symbol: (r.rn, r.Price_Change) for r in got.filter("close = 4.0").collect()}
    assert last["A"] == (1, None) or np.isnan(last["A"][1]) and last["A"][0] == 1


ASKED = "request_id long, symbol string, request_ts timestamp"
PRICED = BAR + ", previous_close double"


def test_requests_are_answered_as_of_their_time(spark):
    def bar(symbol, second, close, seq=0):
        return (symbol, T0 + dt.timedelta(seconds=second), seq, 1.0, 1.2, 0.9, close, 10, 1.0)

    def ask(i, symbol, second):
        return (i, symbol, T0 + dt.timedelta(seconds=second))

    asked = [[ask(1, "a", 100), ask(2, "A", 40)], [ask(3, "ghost", 90), ask(4, "A", 400), ask(5, "N", 70)], [ask(6, "A", 399), ask(7, None, 100), ask(1, "a", 100)],
             [ask(8, "B", 1300)], [ask(98, "~", 9000)], [ask(99, "~", 20_000)]]
    seen = [[bar("A", 100, 1.1), bar("B", 0, 1.0)], [bar("A", 50, 1.3), bar("A", 100, 1.4, seq=1), bar("N", 60, None)], [bar("A", 99, 1.5)],
            [bar("B", 1301, 1.7), bar("B", 1250, 1.8)], [bar("~", 9000, 1.0)], [bar("~", 20_000, 1.0)]]
    scaler = fit_scaler(simple_features(spark.createDataFrame(seen[0], PRICED)))
    path = scratch(spark, "answers")
    st.finish(rq.answer_requests(files(spark, "asked", asked, ASKED), files(spark, "seen", seen, PRICED), scaler, path))
    good = spark.read.parquet(f"{path}/detections").collect()
    assert sorted((r.request_id, r.symbol, r.market_data.close) for r in good) == [(1, "a", 1.4), (6, "A", 1.4), (8, "B", 1.8), (98, "~", 1.0)]
    assert all(r.risk_level in ("LOW", "MEDIUM", "HIGH") for r in good)
    errors = spark.read.parquet(f"{path}/errors").collect()
    assert sorted((r.request_id, r.error) for r in errors) == [
        (2, rq.NO_BAR), (3, rq.NO_BAR), (4, rq.NO_BAR), (5, rq.NO_PRICE), (7, rq.NO_BAR)]


def test_a_listener_hears_of_each_batch_once(spark):
    import json

    bodies = [[("{}",), ("nonsense",)], [("{}",)]]
    path, heard = scratch(spark, "heard"), scratch(spark, "metrics")
    metrics = listener.BatchMetrics(spark, heard)
    spark.streams.addListener(metrics)
    try:
        st.finish(feeds.ingest(files(spark, "bodies", bodies, "body string"), path))
        told = listener.read_metrics(spark, heard).orderBy("batch_id").collect()
    finally:
        spark.streams.removeListener(metrics)
    assert [(r.batch_id, r.processed, r.failed, r.ok, r.input_rows, r.name) for r in told] == [(0, 2, 2, 0, 2, "feed"), (1, 1, 1, 0, 1, "feed")]
    metrics._write("again", json.loads('{"batch_id": 5}'))
    metrics._write("again", json.loads('{"batch_id": 5}'))
    assert listener.read_metrics(spark, heard).count() == 3
