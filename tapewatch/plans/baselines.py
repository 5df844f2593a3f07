"""Models that Spark fits itself: reconstruction by principal components, and weighted logistic regression.

Both are saved and loaded as ``PipelineModel``, with scaling in the pipeline, and fit on all training rows by
distributed aggregation; no row is sampled and no group is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.schema import FEATURES, STORED_PARAMETERS

# Fixed value: the width of the autoencoder's middle layer.
COMPONENTS = 10


@dataclass(frozen=True)
class Baselines:
    """Fitted pipelines: vectors to projections, and vectors to probabilities."""

    components: PipelineModel
    classifier: PipelineModel


def _scaled(features: tuple[str, ...]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_given", handleInvalid="error"),
        StandardScaler(inputCol="_given", outputCol="_x", withMean=True, withStd=True)]


def fit_components(rows: DataFrame, label: str = "Target", features: tuple[str, ...] = FEATURES, k: int = COMPONENTS) -> PipelineModel:
    """Principal components of the rows that are not suspicious."""
    normal = rows.filter(F.col(label) == 0).select(*features)
    return Pipeline(stages=[*_scaled(features), PCA(k=k, inputCol="_x", outputCol="_projected")]).fit(normal)


def fit_classifier(rows: DataFrame, weight: float | None, label: str = "Target", features: tuple[str, ...] = FEATURES) -> PipelineModel:
    """Logistic regression in which suspicious rows weigh ``weight`` times as much as others.

    Of rows that are all of one class the weight is unknown or zero; they weigh alike, and every row gets that class.
    """
    weighted = rows.select(
        *features, F.col(label).cast("double").alias("_label"), F.when(F.col(label) == 1, float(weight or 1.0)).otherwise(1.0).alias("_weight"))
    learner = LogisticRegression(
        featuresCol="_x", labelCol="_label", weightCol="_weight", predictionCol="_called", probabilityCol="_probability",
        rawPredictionCol="_raw", maxIter=100, regParam=1e-3, standardization=False)
    return Pipeline(stages=[*_scaled(features), learner]).fit(weighted)


def _squares(vector: str) -> Column:
    return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda total, x: total + x * x)


def with_error(df: DataFrame, components: PipelineModel) -> DataFrame:
    """Adds ``error``, the mean squared difference between a scaled row and its projection.

    The components are orthonormal, so what the projection lacks is the row's square less the projection's.
    """
    n = len(components.stages[0].getInputCols())
    projected = components.transform(df)
    lost = F.greatest(_squares("_x") - _squares("_projected"), F.lit(0.0)) / n
    return projected.withColumn("error", lost).drop("_given", "_x", "_projected")


def with_probability(df: DataFrame, classifier: PipelineModel) -> DataFrame:
    """Adds ``classifier_probability``."""
    scored = classifier.transform(df).withColumn("classifier_probability", vector_to_array("_probability")[1])
    return scored.drop("_given", "_x", "_raw", "_probability", "_called")


def scores(baselines: Baselines):
    """A model for ``plans.inference``: adds error and probability."""
    return lambda df: with_probability(with_error(df, baselines.components), baselines.classifier)


def save(baselines: Baselines, path: str) -> None:
    baselines.components.write().overwrite().save(f"{path}/components")
    baselines.classifier.write().overwrite().save(f"{path}/classifier")


def load(path: str) -> Baselines:
    """Both pipelines or an error."""
    found = Baselines(PipelineModel.load(f"{path}/components"), PipelineModel.load(f"{path}/classifier"))
    for one in (found.components, found.classifier):
        if tuple(one.stages[0].getInputCols()) != FEATURES:
            raise ValueError("saved for other features")
    return found


def parameters(error_range: tuple[float, float], threshold: float) -> dict[str, float]:
    """The stored parameters with the error's range and threshold of fitted components."""
    low, high = error_range
    return STORED_PARAMETERS | {
        "reconstruction_error_min": low, "reconstruction_error_max": high, "autoencoder_f1_threshold": threshold}
