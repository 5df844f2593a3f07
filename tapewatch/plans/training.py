"""Bars in, training parts and evaluation out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapewatch.operators import metrics as mt
from tapewatch.operators import networks as nn
from tapewatch.operators.features import complete_rows, history_features
from tapewatch.operators.labels import rule_labels
from tapewatch.operators.lookups import attach
from tapewatch.operators.scaling import Scaler, bar_key, fit_scaler, split
from tapewatch.operators.scoring import closed_form_scores, training_ensemble
from tapewatch.operators.series import lay_out
from tapewatch.schema import FEATURES, require
from tapewatch.session import cut, scratch
from tapewatch.sources.sinks import Artefacts, save_artefacts

ANOMALY_PERCENT = 85  # fixed value: share of normal errors below the threshold


def dataset(bars: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Complete feature rows with label and part.

    Written once as Parquet below the shared folder, a folder per part: later passes read the parts and
    columns they need.  ``discard`` removes it.
    """
    spark = bars.sparkSession
    rows = rule_labels(history_features(lay_out(bars, max_rows)).rows())
    rows = complete_rows(rows).dropna(subset=list(FEATURES))
    path = scratch(spark, "dataset")
    split(
        rows.select("symbol", "ts", "seq", "open", "high", "low", "close", "volume", *FEATURES, "Target"), *bar_key()
    ).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path)


def discard(data: DataFrame) -> None:
    """Remove the files of a dataset that is no longer needed."""
    spark = data.sparkSession
    for folder in {file.rsplit("/part=", 1)[0] for file in data.inputFiles() if "/part=" in file}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def project(df: DataFrame) -> DataFrame:
    """Features and label in stored order."""
    require(df.columns, (*FEATURES, "Target"))
    return df.select(*FEATURES, "Target")


def train_rows(data: DataFrame) -> DataFrame:
    return data.filter(F.col("part") == "train")


def train_scaler(data: DataFrame) -> Scaler:
    return fit_scaler(train_rows(data))


def scaled(data: DataFrame) -> DataFrame:
    """All parts, standardised with what the train part shows."""
    return train_scaler(data).transform(data)


def modelled(data: DataFrame, model=closed_form_scores) -> DataFrame:
    """Standardised rows with ``error`` and ``classifier_probability``."""
    return model(scaled(data))


def anomaly_threshold(scores: DataFrame, percent: float = ANOMALY_PERCENT) -> DataFrame:
    """Percentile of the errors of normal validation rows."""
    normal = scores.filter((F.col("part") == "validation") & (F.col("Target") == 0))
    return mt.exact_percentile(normal, "error", percent)


def predictions(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """Scores and calls of ensemble, classifier and autoencoder for the test rows."""
    test = attach(scores.filter(F.col("part") == "test"), threshold, "percentile")
    error, probability = F.col("error"), F.col("classifier_probability")
    ensemble = training_ensemble(error, probability, F.col("percentile"))
    calls = F.array(
        F.struct(F.lit("ensemble").alias("model"), ensemble.alias("score"), (ensemble > 0.5).cast("int").alias("called")),
        F.struct(F.lit("classifier").alias("model"), probability.alias("score"), (probability > 0.5).cast("int").alias("called")),
        F.struct(F.lit("autoencoder").alias("model"), error.alias("score"), (error > F.col("percentile")).cast("int").alias("called")))
    return test.select("Target", F.explode(calls).alias("c")).select("Target", "c.*")


def evaluate(called: DataFrame) -> DataFrame:
    """Per model: the quality of the positive class, accuracy and AUC."""
    yes, truth = F.col("called") == 1, F.col("Target") == 1
    counts = called.groupBy("model").agg(
        F.count("*").alias("n_rows"), F.count_if(truth).alias("positives"),
        F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"),
        F.count_if(yes == truth).alias("right"))
    auc = mt.roc_auc(called, "score", "Target", ["model"])

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, positives = F.col("tp"), F.col("fp"), F.col("positives")
    return counts.join(auc, "model").select(
        "model", "n_rows", "positives",
        share(F.col("right"), F.col("n_rows")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"), share(tp, positives).alias("recall"),
        share(2 * tp, tp + fp + positives).alias("f1_score"),
        F.col("auc").alias("auc_score"))


def threshold_search(scores: DataFrame) -> DataFrame:
    """One row of tuned thresholds, weights and error range from the validation part."""
    held = scores.filter(F.col("part") == "validation")
    best = {}
    for name, column in (("classifier", "classifier_probability"), ("autoencoder", "error")):
        curve = mt.precision_recall(held, column, "Target")
        best[f"{name}_f1_threshold"] = mt.best_threshold(curve).select("threshold")
        if name == "classifier":
            best["classifier_precision_threshold"] = mt.precision_threshold(curve).select("threshold")
    weights = mt.best_weights(held, "error", "classifier_probability", "Target")
    span = mt.error_range(held, "error")
    row = weights.select(
        F.col("ae_weight").alias("best_ensemble_ae_weight"), F.col("clf_weight").alias("best_ensemble_clf_weight"),
        F.col("threshold").alias("best_ensemble_threshold"), F.col("f1").alias("best_ensemble_f1"))
    return row.withColumns({
        **{name: one.scalar() for name, one in best.items()},
        "reconstruction_error_min": span.select("error_min").scalar(),
        "reconstruction_error_max": span.select("error_max").scalar()})


def train(
    bars: DataFrame, path: str, max_rows: int | None = None,
    autoencoder_epochs: int = 50, classifier_epochs: int = 100,
) -> tuple[Artefacts, DataFrame]:
    """Bars to saved artefacts, and the evaluation of the fitted models.

    The dataset and the scores are written once each; every other step is a pass
    over one of them.
    """
    data = dataset(bars, max_rows)
    fitted = train_scaler(data)
    ready = fitted.transform(data)
    weight = mt.class_weight(train_rows(data), "Target").first().weight or 1.0
    rows = nn.vectors(ready, FEATURES, weight)
    autoencoder, _ = nn.fit_autoencoder(rows, autoencoder_epochs)
    classifier, _ = nn.fit_classifier(rows, classifier_epochs)

    scores = cut(nn.network_scores(autoencoder, classifier, FEATURES)(ready))
    tuned = threshold_search(scores).first().asDict()
    threshold = anomaly_threshold(scores)
    parameters = {
        **{name: float(value) for name, value in tuned.items()},
        "anomaly_threshold": float(threshold.first().percentile)}
    artefacts = Artefacts(
        FEATURES, parameters, fitted, {"autoencoder": autoencoder, "classifier": classifier})
    save_artefacts(bars.sparkSession, artefacts, path)
    report = evaluate(predictions(scores, threshold))
    discard(data)  # the scores are written by now
    return artefacts, report
