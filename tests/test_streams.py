"""Streams against the table form, and the networks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import features as ft
from tapewatch.operators import networks as nn
from tapewatch.operators.scaling import fit_scaler
from tapewatch.operators.series import lay_out
from tapewatch.schema import FEATURES, STORED_PARAMETERS
from tapewatch.session import scratch
from tapewatch.sources import sinks
from tapewatch.streaming import feeds, indicators, run as st

TICK = "symbol string, ts timestamp, price double, qty long, event_id long, dedup_id string"


def files(spark, label, batches, schema):
    """One file per batch, in order."""
    path = scratch(spark, label)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return st.stream_files(spark, path, spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)


def written(spark, stream):
    path = scratch(spark, "out")
    st.finish(st.to_table(stream, path))
    return spark.read.parquet(f"{path}/rows")


def test_clamp_and_defaults():
    assert [st.clamped(i) for i in (1, 10, 60, 999)] == [10, 10, 60, 300]
    assert len(st.requested([])) == 29 and st.requested(["A"]) == ["A"]


def test_rolling_features_equal_the_table_form(spark):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for symbol in "AB":
        closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))
        rows += [(symbol, start + dt.timedelta(hours=i), 0, float(c) * 1.01, float(c) * 1.02, float(c) * 0.98, float(c), int(rng.integers(1, 99)))
                 for i, c in enumerate(closes)]
    schema = "symbol string, ts timestamp, seq long, open double, high double, low double, close double, volume long"
    cuts = [start + dt.timedelta(hours=h) for h in (0, 7, 30, 31, 90)]
    batches = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:])]
    got = written(spark, indicators.rolling_features(files(spark, "roll", batches, schema))).orderBy("symbol", "ts").toPandas()
    want = ft.history_features(lay_out(spark.createDataFrame(rows, schema))).rows().orderBy("symbol", "ts").toPandas()
    assert list(got["rn"]) == list(want["rn"])
    for c in FEATURES:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


def test_repeats_and_late_ticks(spark):
    t0 = dt.datetime(2024, 1, 1)

    def tick(i, minutes, key):
        return ("A", t0 + dt.timedelta(minutes=minutes), float(i), 1, i, key)

    batches = [[tick(1, 0, "x"), tick(2, 1, "x"), tick(3, 2, "y")], [tick(4, 3, "x"), tick(5, 90, "z")], [tick(6, 91, "z")], [tick(7, 92, "x")]]
    got = written(spark, feeds.drop_repeats(files(spark, "dup", batches, TICK)))
    assert sorted(r.dedup_id for r in got.collect()) == ["x", "x", "y", "z"]  # the last x is outside the interval

    batches = [[tick(1, 5, "a"), tick(2, 50, "b")], [tick(3, 300, "c")], [tick(9, 310, "e")], [tick(4, 10, "late")], [tick(5, 600, "d")]]
    bars = written(spark, feeds.tick_bars(files(spark, "late", batches, TICK), "1 hour", "event_id")).orderBy("ts").collect()
    assert [(r.ts.hour, r.open, r.close, r.volume) for r in bars] == [(0, 1.0, 2.0, 2), (5, 3.0, 9.0, 2)]


BAR_ROW = "symbol string, ts timestamp, seq long, open double, high double, low double, close double, volume long, previous_close double"


def test_interval_scoring_of_all_requested_symbols(spark):
    t0 = dt.datetime(2024, 1, 1)

    def bar(symbol, second, close=1.1):
        return (symbol, t0 + dt.timedelta(seconds=second), 0, 1.0, 1.2, 0.9, close, 10, 1.0)

    batches = [[bar("A", 0), bar("B", 0), bar("N", 0, None)], [bar("B", 200, 1.5), bar("B", 100)], [bar("B", 301)]]
    from tapewatch.operators.single_point import simple_features
    scaler = fit_scaler(simple_features(spark.createDataFrame(batches[0][:2], BAR_ROW)))
    path = scratch(spark, "interval-out")
    st.finish(feeds.score_on_interval(files(spark, "interval", batches, BAR_ROW), ["a", "B", "N", "ghost"], scaler, path, None))
    found = spark.read.parquet(f"{path}/detections").select("batch_id", "symbol", "market_data.close").collect()
    # a has no bar in the second batch, but its last one is young enough; in the third it isn't
    assert sorted((r.batch_id, r.symbol, r.close) for r in found) == [
        (0, "B", 1.1), (0, "a", 1.1), (1, "B", 1.5), (1, "a", 1.1), (2, "B", 1.1)]
    errors = spark.read.parquet(f"{path}/errors").collect()
    assert sorted((r.batch_id, r.symbol, r.error) for r in errors if r.batch_id != 1) == [
        (0, "N", "no known price"), (0, "ghost", "no fresh bar"),
        (2, "N", "no fresh bar"), (2, "a", "no fresh bar"), (2, "ghost", "no fresh bar")]
    states = spark.read.parquet(f"{path}/state").groupBy("batch_id").count().collect()
    assert {r.batch_id for r in states} == {1, 2}  # older ones are gone


def test_a_batch_that_cannot_be_scored_fails(spark):
    class Broken:
        def transform(self, df):
            raise RuntimeError("no model")

    rows = [("A", dt.datetime(2024, 1, 1), 0, 1.0, 1.2, 0.9, 1.1, 10, 1.0)]
    path = scratch(spark, "interval-bad")
    with pytest.raises(Exception, match="no model"):
        st.finish(feeds.score_on_interval(files(spark, "interval", [rows], BAR_ROW), ["A"], Broken(), path, None))


def test_older_bars_do_not_enter_the_state(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "symbol string, ts timestamp, seq long, open double, high double, low double, close double, volume long"

    def bar(hour, close):
        return ("A", t0 + dt.timedelta(hours=hour), 0, close, close, close, close, 5)

    batches = [[bar(0, 10.0), bar(2, 11.0)], [bar(1, 99.0), bar(3, 12.0), bar(2, 50.0)], [bar(4, float("nan")), bar(5, 13.0)]]
    got = written(spark, indicators.rolling_features(files(spark, "older", batches, schema))).orderBy("ts", "close").collect()
    assert [(r.ts.hour, r.rn, r.late) for r in got] == [(0, 1, False), (1, 0, True), (2, 2, False), (2, 0, True), (3, 3, False), (5, 4, False)]
    assert [round(r.Price_Change, 6) for r in got if not r.late and r.rn > 1] == [0.1, round(12 / 11 - 1, 6), round(13 / 12 - 1, 6)]


def test_fresh_is_strict(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t0), ("B", t0 + dt.timedelta(seconds=1)), ("C", t0 + dt.timedelta(seconds=300))], "symbol string, ts timestamp")
    assert sorted(r.symbol for r in feeds.fresh(df).collect()) == ["B", "C"]


def network_rows(spark, n=3000):
    """Positives differ in three of the twenty numbers."""
    rng = np.random.default_rng(0)
    y = (rng.random(n) < 0.15).astype(int)
    x = rng.normal(size=(n, 20)) * 0.5
    x[:, 10:] = x[:, :10] * 0.8 + x[:, 10:] * 0.2
    x[y == 1, :3] += 2.0
    part = np.where(rng.random(n) < 0.7, "train", "validation")
    rows = [(a.tolist(), float(b), 5.0 if b else 1.0, str(p)) for a, b, p in zip(x, y, part)]
    return spark.createDataFrame(rows, "x array<double>, y double, w double, part string").repartition(3).cache()


def test_networks_learn(spark):
    rows = network_rows(spark)
    autoencoder, history = nn.fit_autoencoder(rows, epochs=6)
    assert history[-1] < history[0]
    held = rows.filter("part = 'validation'")
    error = held.groupBy("y").agg(F.avg(nn.reconstruction_error(autoencoder, F.col("x"))).alias("e"))
    by_class = {r.y: r.e for r in error.collect()}
    assert by_class[1.0] > 1.5 * by_class[0.0]
    classifier, history = nn.fit_classifier(rows, epochs=5)
    from tapewatch.operators.metrics import roc_auc
    scored = held.withColumn("p", nn.probability(classifier, F.col("x")))
    assert roc_auc(scored, "p", "y").first().auc > 0.95


@pytest.mark.parametrize("head, widths", [("mse", (4, 3, 4)), ("bce", (4, 5, 1))])
def test_gradient(head, widths):
    rng = np.random.default_rng(1)
    network = nn.Network.fresh(widths, head)
    x = rng.normal(size=(6, 4))
    y = x if head == "mse" else (rng.random((6, 1)) < 0.5).astype(float)
    w = rng.random(6) + 0.5
    gradient = network.gradient(x, y, w, (), rng)
    for i in range(0, len(network.flat), 3):
        step = np.zeros_like(network.flat)
        step[i] = 1e-6
        up, down = (nn.Network(widths, head, network.flat + s).loss(x, y) @ w / 6 for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_artefacts_round_trip(spark):
    scaler = fit_scaler(spark.range(9).select(*[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(FEATURES)]))
    networks = {"autoencoder": nn.Network.fresh(nn.AUTOENCODER, "mse"), "classifier": nn.Network.fresh(nn.CLASSIFIER, "bce")}
    path = scratch(spark, "model")
    sinks.save_artefacts(spark, sinks.Artefacts(FEATURES, STORED_PARAMETERS, scaler, networks), path)
    back = sinks.load_artefacts(spark, path)
    assert back.features == FEATURES and back.parameters == STORED_PARAMETERS and back.scaler == scaler
    for name, network in networks.items():
        assert np.array_equal(back.networks[name].flat, network.flat) and back.networks[name].widths == network.widths
    half = scratch(spark, "half")
    sinks.save_artefacts(spark, sinks.Artefacts(FEATURES, STORED_PARAMETERS, scaler, {"autoencoder": networks["autoencoder"]}), half)
    with pytest.raises(ValueError, match="networks"):
        sinks.load_artefacts(spark, half)


def test_training_saves_what_scoring_loads(spark):
    from tapewatch.operators.series import DAILY_ROWS
    from tapewatch.plans import inference, training
    from tapewatch.sources.tables import bars_brand

    bars = bars_brand(spark, "/root/testdata/sf0.001")
    path = scratch(spark, "trained")
    artefacts, report = training.train(bars, path, DAILY_ROWS, 2, 2)
    models = {r.model: r for r in report.collect()}
    assert set(models) == {"ensemble", "classifier", "autoencoder"}
    assert models["classifier"].auc_score > 0.7
    loaded = sinks.load_artefacts(spark, path)
    assert loaded.parameters == artefacts.parameters
    assert loaded.parameters["best_ensemble_ae_weight"] + loaded.parameters["best_ensemble_clf_weight"] == pytest.approx(1)
    model = nn.network_scores(loaded.networks["autoencoder"], loaded.networks["classifier"], loaded.features)
    found = inference.score(bars, loaded.scaler, "latest", DAILY_ROWS, model=model, parameters=loaded.parameters)
    rows = found.collect()
    assert len(rows) == 25 and all(0 <= r.ensemble_score <= 1 for r in rows)
