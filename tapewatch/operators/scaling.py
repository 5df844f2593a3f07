"""Dataset split and standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.functions.expr import hash_fraction
from tapewatch.schema import FEATURES

# Test share, validation share of the rest, seed.
TEST_SHARE, VALIDATION_SHARE, SEED = 0.15, 0.176, 42


def split(df: DataFrame, *key: Column, seed: int = SEED) -> DataFrame:
    """Add ``part``: test, validation or train by a hash of the row's key.

    Every class keeps the shares in expectation, and a row never changes sides.
    """
    u = hash_fraction(*key, F.lit(seed))
    upto = TEST_SHARE + (1 - TEST_SHARE) * VALIDATION_SHARE
    return df.withColumn("part", F.when(u < TEST_SHARE, "test").when(u < upto, "validation").otherwise("train"))


def bar_key() -> tuple[Column, Column]:
    return F.col("symbol"), F.unix_micros("ts")


@dataclass(frozen=True)
class Scaler:
    """Fitted means and scales, one pair per feature."""

    means: dict[str, float]
    scales: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``z_`` columns: (value - mean) / scale."""
        return df.withColumns({
            f"z_{c}": (F.col(c).cast("double") - self.means[c]) / self.scales[c] for c in self.means})


def scaler_statistics(df: DataFrame, columns=FEATURES) -> DataFrame:
    """One row of means and population deviations; a constant column gets scale 1."""
    stats = []
    for c in columns:
        spread = F.stddev_pop(c)
        stats += [
            F.avg(c).alias(f"{c}_mean"),
            F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}_scale")]
    return df.agg(*stats)


def fit_scaler(df: DataFrame, columns=FEATURES) -> Scaler:
    """Run the statistics and keep the two numbers per column."""
    row = scaler_statistics(df, columns).first()
    return Scaler(
        {c: row[f"{c}_mean"] for c in columns}, {c: row[f"{c}_scale"] for c in columns})
