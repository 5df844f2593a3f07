"""Spark's own models: what they compute, and that saving changes nothing."""

import numpy as np
import pytest

from tapewatch.operators import metrics as mt
from tapewatch.plans import baselines as bl
from tapewatch.registry.stream_queries import _learned
from tapewatch.schema import FEATURES
from tapewatch.session import scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(1500) < 0.1).astype(int)
    x = rng.normal(size=(1500, 20)) * 0.5
    x[:, 10:] = x[:, :10] * 0.8 + x[:, 10:] * 0.2
    x[y == 1, :3] += 2.0
    data = [(*a.tolist(), int(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(data, [*FEATURES, "Target"]).repartition(3).cache()


def test_error_is_the_distance_from_the_components(rows):
    model = bl.fit_components(rows)
    found = bl.with_error(rows, model).select(*FEATURES, "error").toPandas()
    x = rows.toPandas()
    normal = x[x["Target"] == 0][list(FEATURES)].to_numpy()
    z = (found[list(FEATURES)].to_numpy() - normal.mean(0)) / normal.std(0, ddof=1)
    _, _, axes = np.linalg.svd((normal - normal.mean(0)) / normal.std(0, ddof=1), full_matrices=False)
    top = axes[:bl.COMPONENTS]
    want = ((z - z @ top.T @ top) ** 2).mean(1)
    np.testing.assert_allclose(found["error"], want, rtol=1e-6, atol=1e-9)


def test_weight_moves_the_probabilities(rows):
    plain, weighted = (bl.with_probability(rows, bl.fit_classifier(rows, w)).toPandas() for w in (1.0, 9.0))
    assert weighted["classifier_probability"].mean() > plain["classifier_probability"].mean()
    hit = weighted[weighted["Target"] == 1]["classifier_probability"] > 0.5
    assert hit.mean() > 0.9


def test_saved_pipelines_score_alike(spark, rows):
    fitted = bl.Baselines(bl.fit_components(rows), bl.fit_classifier(rows, 9.0))
    path = scratch(spark, "pipelines")
    bl.save(fitted, path)
    before, after = (bl.scores(m)(rows).select(*FEATURES, "error", "classifier_probability").toPandas().sort_values(list(FEATURES)) for m in (fitted, bl.load(path)))
    assert (before.to_numpy() == after.to_numpy()).all()
    other = bl.Baselines(bl.fit_components(rows, features=FEATURES[::-1]), fitted.classifier)
    bl.save(other, path)
    with pytest.raises(ValueError, match="other features"):
        bl.load(path)


@pytest.mark.parametrize("label", [0, 1])
def test_rows_of_one_class(spark, rows, label):
    one = rows.filter(rows["Target"] == label)
    weight = mt.class_weight(one, "Target").first()[0]
    assert not weight
    path = scratch(spark, "one-class")
    bl.save(bl.Baselines(bl.fit_components(rows), bl.fit_classifier(one, weight)), path)
    found = bl.with_probability(one, bl.load(path).classifier).selectExpr("'train' as part", "Target as y", "classifier_probability")
    assert [tuple(r) for r in found.select("classifier_probability").distinct().collect()] == [(float(label),)]
    n = one.count()
    assert [tuple(r) for r in _learned(found, "classifier_probability", 0.85).collect()] == [("train", n, n * label, True)]
