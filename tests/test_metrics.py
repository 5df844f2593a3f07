"""Metrics against brute force, on both ways through the running totals."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import lookups as lk
from tapewatch.operators import metrics as mt
from tapewatch.operators.scaling import fit_scaler, split
from tapewatch.operators.scoring import anomaly_flag, scoring_ensemble
from tapewatch.schema import STORED_PARAMETERS


def scored(spark, rows):
    return spark.createDataFrame([(float(s), int(y)) for s, y in rows], "score double, y int")


def tied_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(n)]


def brute_curve(rows):
    total = sum(y for _, y in rows)
    points = []
    for t in sorted({s for s, _ in rows}):
        called = [y for s, y in rows if s >= t]
        points.append((t, sum(called) / len(called), sum(called) / total if total else 1.0))
    return points + [(None, 1.0, 0.0)]


@pytest.mark.parametrize("per_task", [1_000_000, 10])
def test_curve_and_auc(spark, per_task):
    rows = tied_rows()
    df = scored(spark, rows)
    got = mt.precision_recall(df, "score", "y", values_per_task=per_task).collect()
    got = sorted(((r.threshold, r.precision, r.recall) for r in got), key=lambda p: (p[0] is None, p[0] or 0))
    want = brute_curve(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want])
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert mt.roc_auc(df, "score", "y", values_per_task=per_task).first().auc == pytest.approx(pairs)


def test_one_class_only(spark):
    positives, negatives = scored(spark, [(0.1, 1), (0.9, 1)]), scored(spark, [(0.1, 0), (0.9, 0)])
    assert mt.roc_auc(positives, "score", "y").first().auc is None
    curve = mt.precision_recall(negatives, "score", "y").orderBy(F.col("threshold").asc_nulls_last()).collect()
    assert [(r.precision, r.recall) for r in curve] == [(0.0, 1.0), (0.0, 1.0), (1.0, 0.0)]


def test_best_threshold(spark):
    rows = tied_rows()
    curve = mt.precision_recall(scored(spark, rows), "score", "y")
    points = brute_curve(rows)
    for metric, value in (("f1", lambda p: 2 * p[1] * p[2] / (p[1] + p[2] + 1e-10)), ("precision", lambda p: p[1]), ("recall", lambda p: p[2])):
        values = [value(p) for p in points]
        first = points[int(np.argmax(values))]
        got = mt.best_threshold(curve, metric).first()
        assert got.threshold == (first[0] if first[0] is not None else points[-2][0]), metric
        assert got.score == pytest.approx(max(values))
    with pytest.raises(ValueError):
        mt.best_threshold(curve, "accuracy")


def test_precision_threshold_default_and_strictness(spark):
    df = scored(spark, [(0.2, 1), (0.4, 0), (0.6, 0), (0.8, 1)])
    curve = mt.precision_recall(df, "score", "y")
    assert mt.precision_threshold(curve, 0.95).first().threshold == 0.8
    above = mt.strictly_above(df, "score", "y", mt.precision_threshold(curve, 0.95)).first()
    assert (above.precision, above.recall) == (0.0, 0.0)  # nothing lies above 0.8
    none = mt.precision_recall(scored(spark, [(0.2, 1), (0.8, 0)]), "score", "y")
    assert mt.precision_threshold(none, 0.95).first().threshold == 0.5


@pytest.mark.parametrize("per_task", [1_000_000, 10])
@pytest.mark.parametrize("percent", [0, 50, 85, 90, 100])
def test_percentile(spark, percent, per_task):
    values = [v for v, _ in tied_rows(333)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = mt.exact_percentile(df, "v", percent, values_per_task=per_task).first()[0]
    assert got == pytest.approx(np.percentile(values, percent))


def test_weight_grid(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.2).astype(int)
    error, prob = rng.random(300) + y * 0.5, rng.random(300) * 0.5 + y * 0.3
    df = spark.createDataFrame(list(zip(error.tolist(), prob.tolist(), y.tolist())), "e double, p double, y int")
    best = (0, None)
    scaled = (error - error.min()) / (error.max() - error.min())
    for a, c in mt.WEIGHT_PAIRS:
        for _, p, r in brute_curve(list(zip((a * scaled + c * prob).tolist(), y.tolist()))):
            f1 = 2 * p * r / (p + r + 1e-10)
            if f1 > best[0] + 1e-12:
                best = (f1, a)
    got = mt.best_weights(df, "e", "p", "y").first()
    assert got.f1 == pytest.approx(best[0]) and got.ae_weight == best[1]


def test_scaler_constant_column(spark):
    s = fit_scaler(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"])
    assert s.means == {"a": 2.0, "b": 5.0} and s.scales == {"a": 1.0, "b": 1.0}


def test_split_shares(spark):
    counts = {r.part: r["count"] for r in split(spark.range(20000), F.col("id")).groupBy("part").count().collect()}
    assert counts["test"] == pytest.approx(3000, rel=0.06)
    assert counts["validation"] == pytest.approx(20000 * 0.85 * 0.176, rel=0.06)


def test_anomaly_modes(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (4000.0,)], "e double")
    flags = [[r[0] for r in df.select(anomaly_flag(F.col("e"), STORED_PARAMETERS, m)).collect()] for m in ("threshold", "normalized")]
    assert flags == [[0, 1, 1], [0, 0, 1]]
    top = df.select(scoring_ensemble(F.col("e"), F.lit(1.0))).collect()[2][0]
    assert top == pytest.approx(1.0)


def test_as_of_bound_is_strict(spark):
    at = dt.datetime(2024, 1, 1)
    seen = spark.createDataFrame([("aapl", at, 1, 10.0), ("aapl", at, 0, 9.0)], "symbol string, ts timestamp, seq long, price double")
    asked = [("AAPL", at + dt.timedelta(seconds=s)) for s in (-1, 0, 299, 300, 301, 700)] + [("MSFT", at)]
    got = lk.as_of(spark.createDataFrame(asked, "symbol string, request_ts timestamp"), seen, ["price"])
    assert [r.price for r in got.orderBy("symbol", "request_ts").collect()] == [None, 10.0, 10.0, None, None, None, None]


def test_as_of_against_brute_force(spark):
    rng = random.Random(9)
    at = dt.datetime(2024, 1, 1)
    seen = [(rng.choice("AB"), at + dt.timedelta(seconds=rng.randrange(5000)), i, float(i)) for i in range(150)]
    asked = [(rng.choice("ABC"), at + dt.timedelta(seconds=rng.randrange(6000))) for _ in range(200)]
    got = lk.as_of(
        spark.createDataFrame(asked, "symbol string, request_ts timestamp"),
        spark.createDataFrame(seen, "symbol string, ts timestamp, seq long, price double"), ["price"]).collect()
    want = []
    for symbol, time in asked:
        before = [o for o in seen if o[0] == symbol and o[1] <= time]
        last = max(before, key=lambda o: (o[1], o[2]), default=None)
        want.append((symbol, time, last[3] if last and (time - last[1]).total_seconds() < 300 else None))
    key = lambda row: (row[0], row[1], row[2] is None, row[2] or 0)
    assert sorted(((r.symbol, r.request_ts, r.price) for r in got), key=key) == sorted(want, key=key)


def test_fallback(spark):
    a = spark.createDataFrame([("A", 1)], "symbol string, close int")
    b = spark.createDataFrame([("A", 2), ("B", 3)], "symbol string, close int")
    rows = {r.symbol: (r.close, r.origin) for r in lk.with_fallback(a, b).collect()}
    assert rows == {"A": (1, "primary"), "B": (3, "secondary")}
    assert lk.with_fallback(a, b, enabled=False).count() == 1
