"""Exponential moving averages from built-in window sums.

With d = 1 - alpha the average is a sum of w_i * d^(n-i).  Rows are taken in blocks;
inside a block the sum is a running sum of w * d^-j scaled back by d^j, and the state at
the end of the block before enters with d^(j+1).  Blocks are short enough for d^-j to stay a
double.  If a block forgets less than a double can tell (long spans), the states themselves are
summed up by the same formula over groups of blocks, each of which forgets all but what the last group left.
So the look-back is exact to doubles for every alpha, on series of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.operators.series import BLOCK, Series

# Powers of ten: what a double cannot tell from nothing beside 1, and how large a weight may get.
NOTHING, LARGEST = 17, 150


@dataclass(frozen=True)
class Average:
    """``alpha`` is a number in (0, 1], or the text of a SQL expression over the row.

    Of an expression the smallest value must be given as ``least_alpha``; larger ones may occur in
    series so short that (1 - alpha)^-rows stays a double.
    """

    name: str
    source: str
    alpha: float | str
    first: int = 1          # row number at which the average starts
    adjusted: bool = False  # divide by the sum of weights instead of seeding
    least_alpha: float | None = None

    def __post_init__(self) -> None:
        if not 0 < self.decay_of() <= 1:
            raise ValueError(f"the smoothing factor of {self.name} must be in (0, 1]")

    def decay_of(self) -> float:
        """The smallest smoothing factor."""
        alpha = self.alpha if self.least_alpha is None else self.least_alpha
        if isinstance(alpha, str):
            raise ValueError(f"{self.name}: least_alpha is needed for an expression")
        return alpha

    def digits(self) -> float:
        """Powers of ten that one row forgets, at least."""
        keep = 1 - self.decay_of()
        return -math.log10(keep) if keep > 0 else math.inf

    def block(self) -> int:
        """Rows of a block: a divisor of BLOCK whose weights stay doubles."""
        rows = BLOCK
        while rows > 1 and isinstance(self.alpha, float) and rows * self.digits() > LARGEST:
            rows //= 2
        return rows

    def group(self) -> int | None:
        """Blocks of a group, None where the block before is all that counts."""
        forgotten = self.block() * self.digits()
        return None if forgotten >= NOTHING else max(2, math.floor(LARGEST / forgotten))

    @staticmethod
    def span(name: str, source: str, span: int, **kw) -> "Average":
        return Average(name, source, 2.0 / (span + 1), **kw)


def block_columns() -> dict[str, Column]:
    """Offset in the block and number of the block; needed by ``averages``."""
    return {"_j": F.expr(f"(rn - 1) % {BLOCK}"), "_block": F.expr(f"(rn - 1) div {BLOCK}")}


def averages(series: Series, wanted: list[Average]) -> tuple[Series, dict[str, Column], list[str]]:
    """Window passes over one sort for all averages together: two, or three with long spans.

    Gives the series with helper columns, the averages as expressions over them,
    and the helpers' names to drop when done.
    """
    keys = ", ".join(series.keys)
    before = f"(partition by {keys} order by rn rows between unbounded preceding and 1 preceding)"
    local, carried, grouped, value = {}, {}, {}, {}
    for a in wanted:
        if series.chunked and series.halo * a.digits() < NOTHING:
            raise ValueError(f"{a.name} looks back over {math.ceil(NOTHING / a.digits())} rows: lay the series out with such a halo")
        here, past, state, x = f"_l_{a.name}", f"_c_{a.name}", f"_g_{a.name}", a.source
        rows, blocks = a.block(), a.group()
        j, block = ("_j", "_block") if rows == BLOCK else (f"((rn - 1) % {rows})", f"((rn - 1) div {rows})")
        alpha = a.alpha if isinstance(a.alpha, str) else f"{a.alpha!r}D"
        keep = f"(1D - {alpha})"
        weight = x if a.adjusted else f"if(rn = {a.first}, {x}, {alpha} * {x})"
        weight = f"if(rn >= {a.first}, {weight}, 0D)"
        inside = f"(partition by {keys}, {block} order by rn rows between unbounded preceding and current row)"
        local[here] = F.expr(f"sum({weight} * pow({keep}, -{j})) over {inside} * pow({keep}, {j})")
        at_end = f"{j} = {rows - 1}"
        if blocks is None:
            carried[past] = F.expr(f"last(if({at_end}, {here}, null), true) over {before}")
            older = f"coalesce({past}, 0D)"
        else:
            # the state at the end of the block before, summed over the group so far
            whole, place = f"pow({keep}, {rows})", f"({block} % {blocks})"
            group = f"(partition by {keys}, {block} div {blocks} order by rn rows between unbounded preceding and "
            ended = f"sum(if({at_end}, {here} * pow({whole}, -{place}), 0D)) over {group}"
            carried[past] = F.expr(f"coalesce({ended}1 preceding), 0D) * pow({whole}, {place} - 1)")
            carried[state] = F.expr(f"{ended}current row) * pow({whole}, {place})")
            grouped[f"{state}_"] = F.expr(f"last(if({at_end} and {place} = {blocks - 1}, {state}, null), true) over {before}")
            older = f"({past} + coalesce({state}_, 0D) * pow({whole}, {place}))"
        total = f"({here} + {older} * pow({keep}, {j} + 1))"
        if a.adjusted:
            total = f"{total} * {alpha} / (1D - pow({keep}, rn))"
        value[a.name] = F.expr(f"if(rn >= {a.first}, {total}, null)")
    frame = series.frame.withColumns(local).withColumns(carried)
    if grouped:
        frame = frame.withColumns(grouped)
    return series.on(frame), value, [*local, *carried, *grouped]


def with_averages(series: Series, wanted: list[Average]) -> DataFrame:
    """Add one column per average."""
    blocked = series.on(series.frame.withColumns(block_columns()))
    done, values, helpers = averages(blocked, wanted)
    return done.frame.withColumns(values).drop("_j", "_block", *helpers)
