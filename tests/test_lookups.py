"""As-of look-ups over range pieces against a plain scan."""

import datetime as dt
import random

import pytest

from tapewatch.operators import lookups as lk

T0 = dt.datetime(2024, 1, 1)


def plain(asked, seen, max_age):
    out = []
    for symbol, at in asked:
        before = [(t, seq, v) for s, t, seq, v in seen if s and symbol and t and at and s.upper() == symbol.upper() and t <= at]
        t, _, v = max(before, default=(None, 0, None), key=lambda x: x[:2])
        fresh = t is not None and (at - t).total_seconds() < max_age
        out.append((symbol, at, t if fresh else None, v if fresh else None))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize("rows_per_piece", [5, 64, 10_000])
def test_as_of_over_pieces(spark, rows_per_piece):
    draw = random.Random(rows_per_piece)

    def at(step):
        return T0 + dt.timedelta(seconds=draw.randrange(4000) * step)

    seen = [(draw.choice(["hot", "Hot", "b", "c"]), at(1), i, draw.choice([None, float(i)])) for i in range(300)]
    seen += [("hot", T0 + dt.timedelta(seconds=77), i, float(i)) for i in range(300, 340)]  # one instant
    seen += [(None, T0, 1, 1.0), ("b", None, 1, 1.0)]
    asked = [(draw.choice(["HOT", "b", "none", None]), at(1)) for _ in range(200)] + [("hot", None)]
    asked += [("hot", T0 + dt.timedelta(seconds=77))] * 30 + [("hot", T0 - dt.timedelta(seconds=1))]
    requests = spark.createDataFrame(asked, "symbol string, request_ts timestamp")
    observations = spark.createDataFrame(seen, "symbol string, ts timestamp, seq long, price double")
    got = lk.as_of(requests, observations, ["price"], 300, rows_per_piece)
    assert got.columns == ["symbol", "request_ts", "observed_ts", "price"]
    assert order(got.collect()) == order(plain(asked, seen, 300))


def test_as_of_of_nothing(spark):
    requests = spark.createDataFrame([("a", T0)], "symbol string, request_ts timestamp")
    observations = spark.createDataFrame([], "symbol string, ts timestamp, seq long, price double")
    assert [tuple(r) for r in lk.as_of(requests, observations, ["price"]).collect()] == [("a", T0, None, None)]
    assert lk.as_of(requests.limit(0), observations, ["price"]).count() == 0


def test_windows_hold_a_piece_at_most(spark):
    """One symbol with all ticks: no partition of the scan holds much more than a piece."""
    from pyspark.sql import functions as F

    ticks = spark.range(20_000).select(
        F.lit("A").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 997 == 0, F.col("id")).alias("v"))
    filled = lk.carried(ticks, ["k"], ["t"], "v", 1000)
    assert filled.filter(F.col("v") != F.col("t") - F.col("t") % 997).count() == 0
    sizes = lk.placed(ticks, ["k", "t"], 20).groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 3000 and sizes[1] >= 10
