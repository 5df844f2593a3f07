"""Fits take all rows, in one task or in pieces side by side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import networks as nn
from tapewatch.operators.metrics import roc_auc


def rows_of(spark, n, seed=0):
    """Positives differ in three of the twenty numbers."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    x = rng.normal(size=(n, 20)) * 0.5
    x[:, 10:] = x[:, :10] * 0.8 + x[:, 10:] * 0.2
    x[y == 1, :3] += 2.0
    part = np.where(rng.random(n) < 0.7, "train", "validation")
    rows = [(a.tolist(), float(b), 5.0 if b else 1.0, str(p)) for a, b, p in zip(x, y, part, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, y double, w double, part string")


def held(rows):
    return rows.filter("part = 'validation'")


def test_pieces_have_all_rows_and_a_bounded_number_each(spark):
    rows = rows_of(spark, 900).withColumn("key", F.xxhash64("x", "y"))
    equal = rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n").union(rows)
    pieces = nn._pieces(equal, 1200, 250)
    sizes = [r["count"] for r in pieces.groupBy("piece").count().orderBy("piece").collect()]
    assert sizes == [240] * 5
    assert pieces.select("x", "y", "w").exceptAll(equal.select("x", "y", "w")).isEmpty()
    assert pieces.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("piece").alias("n")).where("n > 1").isEmpty()


def test_the_loss_is_that_of_all_held_rows(spark):
    rows = rows_of(spark, 2500)
    network, history = nn.fit_classifier(rows, 1, 500)
    x, y = (np.array(v) for v in zip(*[(r.x, [r.y]) for r in held(rows).collect()], strict=True))
    assert len(x) > 500 and history == [pytest.approx(network.loss(x, y).mean())]


def test_a_fit_in_pieces_depends_on_no_partition(spark):
    rows = rows_of(spark, 900)
    one, two = (nn.fit_classifier(r, 2, 200) for r in (rows.coalesce(1), rows.orderBy("y", "x").repartition(5)))
    assert np.array_equal(one[0].flat, two[0].flat) and one[1] == two[1]


@pytest.mark.parametrize("part", ["train", "validation"])
def test_no_rows_of_a_kind_is_an_error(spark, part):
    with pytest.raises(ValueError, match="no .* rows to fit"):
        nn.fit_classifier(rows_of(spark, 50).filter(F.col("part") != part), 1)


def test_autoencoder_learns_in_pieces(spark):
    rows = rows_of(spark, 4000)
    network, history = nn.fit_autoencoder(rows, 12, 800)
    errors = held(rows).groupBy("y").agg(F.avg(nn.reconstruction_error(network, F.col("x"))).alias("e"))
    by_class = {r.y: r.e for r in errors.collect()}
    assert history[-1] < history[0] and by_class[1.0] > 1.5 * by_class[0.0]


def test_classifier_learns_in_pieces(spark):
    rows = rows_of(spark, 4000)
    network, history = nn.fit_classifier(rows, 8, 800)
    scored = held(rows).withColumn("p", nn.probability(network, F.col("x")))
    assert history[-1] < history[0] and roc_auc(scored, "p", "y").first().auc > 0.95
