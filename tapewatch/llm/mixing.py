"""Mixing sources to target weights by Poisson replication, with built-in functions.

A source's repetition rate is its target share of the whole, over its actual size.  Each document draws how
often it appears from a Poisson distribution with that rate: a uniform number, hashed from the seed, the id
and the text, is looked up in the distribution's cumulated probabilities.  Copies are made by
exploding and then sorted by another hash, which shuffles them over the whole output.

The draws are a function of the rows and the seed: no random state, so a task that runs
again draws the same.  A Poisson variable with a large rate is the sum of some with
smaller ones, so rates above ``LARGEST_RATE`` are drawn in several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import Carried, bind, pick, same
from tapewatch.session import small_side

SEED = 7
TEMPERATURE = 0.5
LARGEST_RATE = 32.0
BROADCAST_SOURCES = 20_000  # sources, with a table each, that are broadcast at most
STEPS = 160  # entries of a table of cumulated probabilities: beyond rate 32 by over 20 deviations


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE,
                 epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """source, bytes, rate: mean number of copies of a document of this source.

    Without ``targets`` a source's weight is its size in UTF-8 bytes to the power of
    ``temperature``; with them, sources that they don't name get none.  The expected size of the output is
    ``epochs`` times the input's.  A null source is a source of its own.  A source whose texts are
    all empty has size zero and rate zero.
    """
    sizes = pick(docs, source=source, text=text).groupBy("source").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if targets is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(temperature))
    else:
        named = F.create_map(*(F.lit(x) for item in targets.items() for x in item))
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    weighted = sizes.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(0.0))
    total = weighted.agg(F.sum("bytes"), F.sum("weight")).head()
    if not total[0] or not total[1]:
        return weighted.select("source", "bytes", F.lit(0.0).alias("rate"))
    return weighted.select("source", "bytes", F.when(F.col("bytes") > 0, (
        F.col("weight") / total[1]) * (total[0] * epochs) / F.col("bytes")).otherwise(0.0).alias("rate"))


def cumulated(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ..., STEPS - 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda state: state["sums"])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5, which SQL engines share."""
    key = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def replicated(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0,
               seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[Carried, DataFrame]:
    """The table under numbered columns with n_copies, copy (from 1) and order_key, in shuffled order.

    Documents that draw zero are not in it.  Rows equal in id and text draw alike, so repeated
    rows are repeated as often each; a null text is empty, a null id an id of its own.
    """
    table = Carried(docs)
    rates = source_rates(docs, targets, temperature, epochs, source, text)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE).cast("int"))
    rated = rates.select("source", parts.alias("parts"), cumulated(F.col("rate") / parts).alias("sums"))
    drawn = same(
        table.df.withColumns({"source": table[source], "t": F.md5(F.coalesce(table[text], F.lit("")))}),
        small_side(rated, BROADCAST_SOURCES), ["source"])
    draws = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: bind(
        uniform(F.lit(seed), j, table[doc_id], F.col("t")),
        lambda u: F.size(F.filter("sums", lambda s: s <= u))))
    counted = drawn.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(table[doc_id].cast("string"), F.lit("")), "t", "copy"))
    return table, copies.withColumn("order_key", key).orderBy("order_key").select(*table.numbers, "n_copies", "copy", "order_key")


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0,
          seed: int = SEED) -> DataFrame:
    """``docs`` with rows repeated or left out by their draws, shuffled, in their own columns."""
    table, rows = replicated(docs, targets, temperature, epochs, seed)
    return table.back(rows)
