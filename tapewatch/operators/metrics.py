"""Threshold search and quality metrics over (score, label) rows.

Rows are first counted per distinct score, which also collapses hot scores; the
curves are running totals over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewatch.functions.expr import ratio
from tapewatch.operators.lookups import attach
from tapewatch.operators.series import placed
from tapewatch.session import cut, small_side

# Fixed values of the threshold search.
TINY = 1e-10
DEFAULT_THRESHOLD = 0.5
TARGET_PRECISION = 0.95
WEIGHT_PAIRS = ((0.3, 0.7), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4))

# Distinct values that one task may take through a running total.
VALUES_PER_TASK = 2_000_000


def running_totals(
    counts: DataFrame,
    group: list[str],
    value: str,
    sums: list[str],
    values_per_task: int = VALUES_PER_TASK,
) -> DataFrame:
    """Add ``below_x`` (sum over smaller values) and ``all_x`` for each x in ``sums``.

    ``counts`` has one row per group and value.  Beyond ``values_per_task`` rows
    the values are range-partitioned and each range starts from the totals of the
    ranges before it.
    """
    counts = cut(counts)
    if counts.count() <= values_per_task:
        whole = Window.partitionBy(*group)
        earlier = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({
            **{f"below_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums},
            **{f"all_{c}": F.sum(c).over(whole) for c in sums}})

    spread = placed(counts, [*group, value])
    pieces = spread.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_p_{c}") for c in sums])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({
        **{f"_b_{c}": F.coalesce(F.sum(f"_p_{c}").over(before), F.lit(0)) for c in sums},
        **{f"all_{c}": F.sum(f"_p_{c}").over(whole) for c in sums},
    }).drop(*[f"_p_{c}" for c in sums])
    inside = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        spread.join(small_side(pieces), [*group, "_part"])
        .withColumns({
            f"below_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
        .drop("_pos", "_part", *[f"_b_{c}" for c in sums]))


def score_counts(df: DataFrame, score: str, label: str, group: list[str] = []) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*group, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def _score_totals(df, score, label, group, **limits) -> DataFrame:
    return running_totals(score_counts(df, score, label, group), group, "threshold", ["pos", "neg"], **limits)


def roc_auc(df: DataFrame, score: str, label: str, group: list[str] = [], **limits) -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count half."""
    totals = _score_totals(df, score, label, group, **limits)
    ordered = F.sum(F.col("pos").cast("double") * (F.col("below_neg") + 0.5 * F.col("neg")))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return totals.groupBy(*group).agg(ratio(ordered, pairs).alias("auc"))


def precision_recall(df: DataFrame, score: str, label: str, group: list[str] = [], **limits) -> DataFrame:
    """A point per distinct score (positive at or above it), then (1, 0).

    The last point has no threshold.
    """
    totals = _score_totals(df, score, label, group, **limits)
    hit = F.col("all_pos") - F.col("below_pos")
    called = hit + F.col("all_neg") - F.col("below_neg")
    points = totals.select(
        *group, "threshold",
        (hit / called).alias("precision"),
        F.when(F.col("all_pos") == 0, 1.0).otherwise(ratio(hit, F.col("all_pos"))).alias("recall"))
    end = totals.groupBy(*group).agg(F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end.withColumns({"precision": F.lit(1.0), "recall": F.lit(0.0)}))


def best_threshold(curve: DataFrame, metric: str = "f1", group: list[str] = []) -> DataFrame:
    """The first best point of a precision-recall curve.

    If that is the closing point, the highest threshold is reported.
    """
    if metric == "f1":
        value = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + TINY)
    elif metric in ("precision", "recall"):
        value = F.col(metric)
    else:
        raise ValueError("metric must be 'f1', 'precision' or 'recall'")
    place = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    best = curve.withColumn("score", value).groupBy(*group).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "score"),
                 F.struct(F.col("score"), -place)).alias("best"),
        F.max("threshold").alias("highest"))
    return best.select(
        *group, F.coalesce("best.threshold", "highest").alias("threshold"),
        "best.precision", "best.recall", "best.score")


def precision_threshold(curve: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """The lowest threshold whose precision reaches the target, else the default."""
    reached = F.min(F.when(F.col("precision") >= target, F.col("threshold")))
    return curve.agg(F.coalesce(reached, F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def strictly_above(df: DataFrame, score: str, label: str, threshold: DataFrame) -> DataFrame:
    """Precision and recall of calling positive what lies strictly above a threshold."""
    called = attach(df, threshold, "threshold").withColumn(
        "_called", (F.col(score) > F.col("threshold")).cast("int"))
    return called.groupBy("threshold").agg(
        F.coalesce(ratio(F.sum(F.col("_called") * F.col(label)), F.sum("_called")), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(F.sum(F.col("_called") * F.col(label)), F.sum(label)), F.lit(0.0)).alias("recall"))


def hybrid_scores(df: DataFrame, error: str, probability: str) -> DataFrame:
    """Each row under the four weight pairs, with the min-max normalised error."""
    span = df.agg(F.min(error).alias("_low"), F.max(error).alias("_high"))
    pairs = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(a).alias("ae_weight"), F.lit(c).alias("clf_weight"))
        for i, (a, c) in enumerate(WEIGHT_PAIRS)])
    scaled = ratio(F.col(error) - F.col("_low"), F.col("_high") - F.col("_low"))
    return (
        attach(df, span).withColumn("_w", F.explode(pairs)).select("*", "_w.*")
        .withColumn("hybrid", F.col("ae_weight") * scaled + F.col("clf_weight") * F.col(probability))
        .drop("_w", "_low", "_high"))


def best_weights(df: DataFrame, error: str, probability: str, label: str) -> DataFrame:
    """The weight pair with the best F1; the earlier pair wins a tie."""
    group = ["pair", "ae_weight", "clf_weight"]
    curve = precision_recall(hybrid_scores(df, error, probability), "hybrid", label, group)
    best = best_threshold(curve, "f1", group)
    return best.agg(F.max_by(
        F.struct("ae_weight", "clf_weight", "threshold", F.col("score").alias("f1")),
        F.struct(F.col("score"), -F.col("pair"))).alias("b")).select("b.*")


def exact_percentile(df: DataFrame, value: str, percent: float, **limits) -> DataFrame:
    """Linear-interpolation percentile without gathering the values in one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(
        F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    totals = running_totals(counts, [], "v", ["n"], **limits)
    place = (F.col("all_n") - 1) * (percent / 100.0)
    upto = F.col("below_n") + F.col("n")
    ends = totals.agg(
        F.min(F.when(upto > F.floor(place), F.col("v"))).alias("low"),
        F.min(F.when(upto > F.ceil(place), F.col("v"))).alias("high"),
        F.max(place - F.floor(place)).alias("part"))
    return ends.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("percentile"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(label).cast("long").alias("positives"),
        (F.avg(label) * 100).alias("percent"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight of the positive class: negatives per positive."""
    return df.agg(ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("weight"))


def classification_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class with both averages and accuracy."""
    yes, truth = F.col(predicted) == 1, F.col(label) == 1
    counts = df.agg(
        F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"),
        F.count_if(~yes & truth).alias("fn"), F.count_if(~yes & ~truth).alias("tn"))

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("long").alias("support"))

    def quality(hit: Column, wrong: Column, missed: Column):
        p, r = (F.coalesce(ratio(hit, hit + x), F.lit(0.0)) for x in (wrong, missed))
        return p, r, F.coalesce(ratio(2 * hit, 2 * hit + wrong + missed), F.lit(0.0)), hit + missed

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    no, si = quality(tn, fn, fp), quality(tp, fp, fn)
    total = no[3] + si[3]
    accuracy = F.coalesce(ratio(tp + tn, total), F.lit(0.0))
    lines = [
        line("0", *no), line("1", *si),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *[(a + b) / 2 for a, b in zip(no[:3], si[:3])], total),
        line("weighted avg", *[
            F.coalesce(ratio(a * no[3] + b * si[3], total), F.lit(0.0)) for a, b in zip(no[:3], si[:3])], total),
    ]
    return counts.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def confusion(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n_rows"))


def error_range(df: DataFrame, error: str) -> DataFrame:
    return df.agg(F.min(error).alias("error_min"), F.max(error).alias("error_max"))
