"""How the rows of one symbol are laid out over tasks.

Every per-symbol window needs the symbol's rows in time order.  A symbol whose
row count is known to be modest is one window partition.  A longer one is cut
into chunks of equal row count, each with a copy of the rows just before it (its
halo), so that no task ever holds a whole hot symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapewatch.functions.expr import finite
from tapewatch.schema import PRICE_COLUMNS
from tapewatch.session import cut, small_side

# Rows that sums over blocks take together.  The indicators' own averages forget more than a
# double can tell within one such block, so it is the halo, too, where none is asked for.
BLOCK = 1024
ROWS_PER_TASK = 4096 * BLOCK
# Rows that one task takes through windows over many keys: sorts and windows in a row hold all of them at once.
WINDOW_ROWS = 256 * BLOCK
# One bar per symbol and calendar day, over every year a timestamp can express.
DAILY_ROWS = 366 * 9999


@dataclass(frozen=True)
class Series:
    """Bars with their row number ``rn`` in the symbol (1-based)."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool
    halo: int = BLOCK

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last_rows(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(-(n - 1), 0)

    def on(self, frame: DataFrame) -> "Series":
        return Series(frame, self.keys, self.order, self.chunked, self.halo)

    def rows(self) -> DataFrame:
        """The bars without halo copies and layout columns."""
        frame = self.frame
        if self.chunked:
            frame = frame.filter(~F.col("halo")).drop("halo", "chunk")
        return frame


def is_priced(columns) -> Column:
    """Whether all prices and the volume, as far as ``columns`` has them, are known and finite."""
    known = F.lit(True)
    for c in PRICE_COLUMNS:
        if c in columns:
            known = known & finite(F.col(c)).isNotNull()
    return known


def priced(bars: DataFrame) -> DataFrame:
    """The bars that a history can be made of."""
    return bars.filter(is_priced(bars.columns))


def price_gaps(bars: DataFrame) -> DataFrame:
    """How many bars each symbol has, and how many of them a history leaves out."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.count_if(~is_priced(bars.columns)).alias("n_left_out"))


def lay_out(
    bars: DataFrame,
    max_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    only_priced: bool = True,
    halo: int = BLOCK,
) -> Series:
    """Number the rows of each symbol by (ts, seq).

    Bars without a known, finite price or volume are left out: averages and changes over
    them would be wrong for all later rows.  ``price_gaps`` counts them.  ``max_rows`` is a bound on the rows of
    any symbol that the caller can prove; without one the longest symbol is counted first.
    ``halo`` rows before a chunk are copied into it; averages with a long memory need more than BLOCK.
    """
    if only_priced:
        bars = priced(bars)
    rows = 0
    if max_rows is None:
        counted = bars.groupBy("symbol").agg(F.count("*").alias("n"))
        max_rows, rows = (n or 0 for n in counted.agg(F.max("n"), F.sum("n")).first())
    if max_rows <= rows_per_task:
        order = Window.partitionBy("symbol").orderBy("ts", "seq")
        frame = dealt(bars, ["symbol"], rows).withColumn("rn", F.row_number().over(order).cast("long"))
        return Series(frame, ("symbol",), ("ts", "seq"), False)
    return _chunked(bars, rows or bars.count(), rows_per_task, halo)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df``, known to have ``rows`` rows, by keys over so many tasks that each has some ``WINDOW_ROWS`` of them.

    Left to itself Spark merges tasks by the bytes they read, which are few beside what windows hold of them.
    """
    tasks = -(-rows // WINDOW_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else df


def _chunked(bars: DataFrame, rows: int, rows_per_chunk: int, halo: int) -> Series:
    if rows_per_chunk % BLOCK or halo % BLOCK or not 0 < halo < rows_per_chunk:
        raise ValueError(f"rows_per_task and halo must be multiples of {BLOCK}, the halo the smaller one")
    copied = rows + rows * halo // rows_per_chunk
    numbered = number_by_sort(bars, ["symbol"], ["ts", "seq"])
    place = F.col("rn") - 1
    home = F.floor(place / rows_per_chunk)
    in_halo = place % rows_per_chunk >= rows_per_chunk - halo
    frame = (
        numbered.withColumn("home", home)
        .withColumn("chunk", F.explode(
            F.when(in_halo, F.array("home", F.col("home") + 1)).otherwise(F.array("home"))))
        .withColumn("halo", F.col("chunk") != F.col("home"))
        .drop("home")
    )
    frame = dealt(frame, ["symbol", "chunk"], copied)
    return Series(frame, ("symbol", "chunk"), ("rn",), True, halo)


def placed(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """Globally sorted rows with ``_pos``, increasing along the sort, and the range piece ``_part``.

    Range partitioning spreads a hot key over tasks; the extra ``_tie`` also
    spreads exact copies.  The result is written out because range bounds are
    sampled and would differ if the plan ran twice.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return cut(
        tied.repartitionByRange(*([pieces] if pieces else []), *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
        .drop("_tie")
    )


def number_by_sort(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row number ``rn`` per key without one task per key."""
    spread = placed(df, keys + order)
    pieces = spread.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys, "_part", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        spread.join(small_side(pieces), [*keys, "_part"])
        .withColumn("rn", F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .drop("_pos", "_part", "_first", "_before")
    )


def series_length(series: Series) -> Series:
    """Add ``n_rows``, the row count of the whole symbol."""
    if not series.chunked:
        return series.on(series.frame.withColumn(
            "n_rows", F.count("*").over(Window.partitionBy(*series.keys))))
    counts = (
        series.frame.filter(~F.col("halo")).groupBy("symbol")
        .agg(F.count("*").alias("n_rows")))
    return series.on(series.frame.join(small_side(counts), "symbol"))
