"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contracts: what separates words, and a character of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, as new_name="name".

    Columns are found by their exact name and position, so other columns may differ
    from them in upper and lower case only, or bear a name twice (the first counts).
    """
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{df.columns.index(name)}").alias(new) for new, name in columns.items()))


class Carried:
    """All columns of a table under numbers, so that working columns cannot clash with them."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.numbers = [f"_{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.numbers)

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_{self.names.index(name)}")

    def back(self, df: DataFrame) -> DataFrame:
        """The original columns of what came of ``self.df``."""
        return df.select(*self.numbers).toDF(*self.names)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal each other; the keys come once, from the left."""
    other = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = functools.reduce(Column.__and__, (left[k].eqNullSafe(other[f"{k}__r"]) for k in keys))
    return left.join(other, on, how).drop(*(f"{k}__r" for k in keys))


# Bits for each key of a filter, the most bits it has, and those in a row of its table, which Spark fixes.
BITS_PER_KEY, MOST_BITS, ROW_BITS = 16, 1 << 28, 1 << 15


class Filter:
    """Bits for the hashes ``key`` (long) of a table's rows, in a broadcast of bounded size: no row of an equal key is passed over."""

    def __init__(self, df: DataFrame, key: Column) -> None:
        bits = ROW_BITS
        while bits < min(MOST_BITS, BITS_PER_KEY * df.count()):
            bits *= 2
        self._bits = bits
        # dealt by row before they are combined, so that no task holds all rows
        places = df.select(self._place(key).alias("place")).select(self._row().alias("filter_row"), F.pmod("place", F.lit(ROW_BITS)).alias("at"))
        self._table = places.repartition("filter_row").groupBy("filter_row").agg(F.bitmap_construct_agg("at").alias("filter_bits"))

    def _place(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self._bits))

    @staticmethod
    def _row() -> Column:
        return F.shiftright("place", ROW_BITS.bit_length() - 1)

    def mark(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` with ``marked``: True for rows whose key the table has, and a few others."""
        placed = df.withColumn("place", self._place(key)).withColumn("filter_row", self._row())
        at = F.pmod("place", F.lit(ROW_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("filter_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found = F.getbit(F.coalesce(byte, F.lit(0)), at.bitwiseAND(F.lit(7))) == 1
        return placed.join(F.broadcast(self._table), "filter_row", "left").withColumn("marked", found).drop("place", "filter_row", "filter_bits")
