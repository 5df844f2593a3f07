"""Mergeable summaries: kept per day or key, united for any period without the raw rows.

Each has a stated error.  Curves by bins count scores in one pass; their totals run over bins within a block
and over blocks, so no window holds more than ``BLOCKS`` or ``BINS_PER_BLOCK`` rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewatch.functions.expr import ratio
from tapewatch.session import small_side

BLOCKS, BINS_PER_BLOCK = 1024, 256

# Size of a quantile summary, and how far the rank of its answer may lie from the share asked for.  The sketch's
# own error at this size is 0.0035 in 99 of 100 cases; the bound is nearly three times that.
QUANTILE_SIZE, RANK_ERROR = 800, 0.01

# 2 ** DISTINCT_BITS registers of a distinct-count sketch, and four of its standard errors.
DISTINCT_BITS = 12
DISTINCT_ERROR = 4 * 1.04 / 2 ** (DISTINCT_BITS / 2)


# -------------------------------------------------------------------- quantiles
def quantile_summaries(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One summary per key: ``n`` values and ``summary``; null and NaN values are left out."""
    number = F.col(value).cast("double")
    return df.filter(number.isNotNull() & ~F.isnan(number)).groupBy(*by).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias("summary"))


def merged_quantile(summaries: DataFrame, percent: float, by: list[str] = []) -> DataFrame:
    """``percentile`` of all values behind the summaries of each key, within RANK_ERROR of the asked rank."""
    together = summaries.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("summary").alias("summary"))
    return together.withColumn("percentile", F.kll_sketch_get_quantile_double("summary", F.lit(percent / 100))).drop("summary")


def rank_is_near(df: DataFrame, value: str, at: DataFrame, percent: float, by: list[str]) -> DataFrame:
    """Per key ``n`` and whether ``percentile`` of ``at`` lies within RANK_ERROR of its rank among the rows.

    Equal values span a range of ranks; any of it counts.
    """
    placed = df.join(small_side(at.select(*by, "percentile")), by)
    share = percent / 100
    return placed.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.avg((F.col(value) < F.col("percentile")).cast("int")) <= share + RANK_ERROR).alias("_low"),
        (F.avg((F.col(value) <= F.col("percentile")).cast("int")) >= share - RANK_ERROR).alias("_high"),
    ).withColumn("is_near", F.col("_low") & F.col("_high")).drop("_low", "_high")


# --------------------------------------------------------------- distinct counts
def distinct_summaries(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One sketch per key, of the distinct values that are not null."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(value), F.lit(DISTINCT_BITS)).alias("summary"))


def merged_distinct(summaries: DataFrame, by: list[str] = []) -> DataFrame:
    """``estimate`` of the distinct values behind the summaries of each key, within DISTINCT_ERROR of their number."""
    return summaries.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("summary")).alias("estimate"))


# ------------------------------------------------------------------------ curves
def binned_counts(
    df: DataFrame, score: str, label: str, low: float = 0.0, high: float = 1.0, group: list[str] = [],
) -> DataFrame:
    """Positives, negatives and the lowest score of each bin between ``low`` and ``high``, in one pass.

    Scores outside fall into the first and the last bin.  Counts of several periods can be added up.
    """
    bins = BLOCKS * BINS_PER_BLOCK
    number = F.col(score).cast("double")
    place = F.floor((number - low) * (bins / (high - low)))
    return (
        df.filter(number.isNotNull() & ~F.isnan(number) & F.col(label).isNotNull())
        .groupBy(*group, F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).alias("bin"))
        .agg(F.min(number).alias("threshold"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def added_counts(counts: DataFrame, group: list[str] = []) -> DataFrame:
    """Bin counts of several periods as one."""
    return counts.groupBy(*group, "bin").agg(F.min("threshold").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _totals(counts: DataFrame, group: list[str]) -> DataFrame:
    """Adds below_pos, below_neg, all_pos, all_neg: over the bins of a block, and over the blocks before."""
    sums = ("pos", "neg")
    block = F.floor(F.col("bin") / BINS_PER_BLOCK).alias("_block")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*group, block).agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumns({
        **{f"_b_{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in sums},
        **{f"all_{c}": F.sum(f"_{c}").over(whole) for c in sums}}).drop(*[f"_{c}" for c in sums])
    inside = Window.partitionBy(*group, "_block").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_block", block).join(blocks, [*group, "_block"])
        .withColumns({f"below_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
        .drop("_block", *[f"_b_{c}" for c in sums]))


def binned_curve(counts: DataFrame, group: list[str] = []) -> DataFrame:
    """Precision and recall of calling positive all from a bin on, then (1, 0).

    A point is exact for its threshold; only thresholds within a bin are not told apart.
    """
    totals = _totals(counts, group)
    hit = F.col("all_pos") - F.col("below_pos")
    called = hit + F.col("all_neg") - F.col("below_neg")
    points = totals.select(
        *group, "threshold", (hit / called).alias("precision"),
        F.when(F.col("all_pos") == 0, 1.0).otherwise(ratio(hit, F.col("all_pos"))).alias("recall"))
    end = counts.groupBy(*group).agg(F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end.withColumns({"precision": F.lit(1.0), "recall": F.lit(0.0)}))


def binned_auc(counts: DataFrame, group: list[str] = []) -> DataFrame:
    """``auc`` with the pairs of one bin counted half, and ``error_bound``: half the share of such pairs."""
    totals = _totals(counts, group)

    def pairs(value: Column) -> Column:
        return F.sum(F.col("pos").cast("double") * value)

    all_pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return totals.groupBy(*group).agg(
        ratio(pairs(F.col("below_neg") + 0.5 * F.col("neg")), all_pairs).alias("auc"),
        ratio(pairs(0.5 * F.col("neg")), all_pairs).alias("error_bound"))
