"""Mergeable summaries against exact answers, and their stated errors."""

import random

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import metrics as mt
from tapewatch.operators import summaries as sm


def judged(spark, n=3000, seed=5):
    draw = random.Random(seed)
    rows = [(d, round(draw.betavariate(2, 3), 4), int(draw.random() < 0.3)) for d in range(4) for _ in range(n)]
    return spark.createDataFrame(rows + [(0, None, 1), (1, float("nan"), 0), (2, 0.5, None)], "day int, score double, y int")


@pytest.mark.parametrize("percent", [1, 50, 85, 99.5])
def test_quantiles_of_merged_days(spark, percent):
    df = judged(spark)
    kept = sm.quantile_summaries(df, "score", ["day"])
    assert {r.n for r in kept.collect()} == {3000, 3001}  # the row without a label has a score
    at = sm.merged_quantile(kept.withColumn("half", F.col("day") % 2), percent, ["half"])
    clean = df.filter(~F.isnan("score")).withColumn("half", F.col("day") % 2)
    assert [r.is_near for r in sm.rank_is_near(clean, "score", at, percent, ["half"]).collect()] == [True, True]
    wrong = at.withColumn("percentile", F.col("percentile") + 0.2)
    if percent == 50:
        assert not any(r.is_near for r in sm.rank_is_near(clean, "score", wrong, percent, ["half"]).collect())


def test_distinct_counts_are_united_not_added(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.pmod(F.xxhash64("id"), F.lit(7000)).alias("user"))
    rows = rows.withColumn("user", F.when(F.col("user") > 0, F.col("user")))
    kept = sm.distinct_summaries(rows, "user", ["day"])
    exact = rows.agg(F.countDistinct("user")).first()[0]
    estimate = sm.merged_distinct(kept).first().estimate
    assert abs(estimate - exact) <= sm.DISTINCT_ERROR * exact
    per_day = {r.day: r.n for r in rows.groupBy("day").agg(F.countDistinct("user").alias("n")).collect()}
    for r in sm.merged_distinct(kept, ["day"]).collect():
        assert abs(r.estimate - per_day[r.day]) <= sm.DISTINCT_ERROR * per_day[r.day]


def test_curve_by_bins_is_exact_at_its_thresholds(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCKS", 7)
    monkeypatch.setattr(sm, "BINS_PER_BLOCK", 5)
    df = judged(spark)
    daily = sm.binned_counts(df, "score", "y", group=["day"])
    counts = sm.added_counts(daily)
    exact = {r.threshold: (r.precision, r.recall) for r in mt.precision_recall(df.filter(~F.isnan("score")), "score", "y").collect()}
    points = sm.binned_curve(counts).collect()
    assert len(points) <= 36 and points[-1].threshold is None
    for p in points:
        assert (p.precision, p.recall) == pytest.approx(exact[p.threshold])
    auc = mt.roc_auc(df.filter(~F.isnan("score")), "score", "y").first().auc
    found = sm.binned_auc(counts).first()
    assert 0 < found.error_bound < 0.05 and abs(found.auc - auc) <= found.error_bound
    by_day = {r.day: r for r in sm.binned_auc(daily, ["day"]).collect()}
    for r in mt.roc_auc(df.filter(~F.isnan("score")), "score", "y", ["day"]).collect():
        assert abs(by_day[r.day].auc - r.auc) <= by_day[r.day].error_bound


def test_scores_outside_the_range_and_one_class(spark):
    df = spark.createDataFrame([(-5.0, 1), (0.2, 1), (9.0, 1)], "score double, y int")
    counts = sm.binned_counts(df, "score", "y")
    assert sorted((r.bin, r.pos, r.neg) for r in counts.collect())[0] == (0, 1, 0)
    assert sm.binned_auc(counts).first().auc is None
    assert [(p.precision, p.recall) for p in sm.binned_curve(counts).orderBy("threshold").collect()][1] == (1.0, 1.0)
    assert sm.binned_curve(sm.binned_counts(df.limit(0), "score", "y")).filter("threshold is not null").count() == 0
