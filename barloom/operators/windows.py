"""Rolling aggregates and exponential smoothing over ordered series.

Every series here holds at most one row per key and calendar day (``sources.bars.daily_unique``
guarantees it), so a window group is bounded by the calendar: 36,525 rows per century, whatever the
total size of the table. Raw rows, where one key can hold a third of the table, never reach a
window; they are reduced first by aggregations that combine before they shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """Row-positional access to the series given by ``keys``, in ``order``.

    ``row_column`` names an existing 1-based row number; with it, full-window checks cost one
    running maximum instead of a count over every window."""

    def __init__(self, keys: list[str], order: str = "date", row_column: str | None = None):
        self.keys, self.order, self.row_column = list(keys), order, row_column
        self.window = Window.partitionBy(*keys).orderBy(order)
        self.so_far = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = Window.partitionBy(*keys)

    def frame(self, rows: int):
        return self.window.rowsBetween(-(rows - 1), Window.currentRow)

    def ahead(self, rows: int):
        return self.window.rowsBetween(1, rows)

    def lag(self, value: Column | str, rows: int = 1) -> Column:
        return F.lag(value, rows).over(self.window)

    def row_number(self) -> Column:
        return F.row_number().over(self.window)

    def roll(self, value: Column | str, rows: int, agg, min_periods: int | None = None) -> Column:
        """``agg`` over the last ``rows`` rows; null until enough of them are non-null."""
        frame = self.frame(rows)
        if min_periods is None and self.row_column is not None:
            enough = self.rows_since_null(value) >= rows
        else:
            enough = F.count(value).over(frame) >= (min_periods or rows)
        return F.when(enough, agg(value).over(frame))

    def rows_since_null(self, value: Column | str) -> Column:
        """Length of the run of non-null values that ends here."""
        position = F.col(self.row_column)
        column = F.col(value) if isinstance(value, str) else value
        last_null = F.max(F.when(column.isNull(), position)).over(self.so_far)
        return position - F.coalesce(last_null, F.lit(0))


@dataclass(frozen=True)
class Ewm:
    """y[t] = (1 - alpha) * y[t-1] + alpha * x[t], seeded by x at row ``seed_row`` (1-based)."""

    name: str
    source: str
    alpha: float
    seed_row: int = 1

    @classmethod
    def span(cls, name: str, source: str, span: int, seed_row: int = 1) -> Ewm:
        return cls(name, source, 2.0 / (span + 1), seed_row)

    @property
    def decay(self) -> float:
        return -math.log1p(-self.alpha)


def ewm_block_rows(specs: list[Ewm]) -> int:
    """Rows per block: long enough that a block forgets what came before its predecessor
    (weight below 1e-17, less than a double can show), short enough that e^(decay * rows) is finite."""
    rows = 1 << math.ceil(math.log2(39.2 / min(s.decay for s in specs)))
    if rows * max(s.decay for s in specs) > 640:
        raise ValueError("smoothing factors too far apart for one pass; split them over two calls")
    return rows


def add_ewm(df: DataFrame, series: Series, specs: list[Ewm], row_column: str) -> DataFrame:
    """All smoothings in one blocked scan; ``row_column`` is the 1-based position in the series.

    The recursion is affine, so inside a block y = g^k * sum(w_j * x_j * g^-j), a plain running sum.
    The block before supplies the carry, decayed by g^(k+1). Two window passes in the partitioning
    the frame already has: no shuffle, no Python, no per-series array.
    """
    block = ewm_block_rows(specs)
    position = F.col(row_column) - 1
    df = df.withColumns(
        {"__block": (position / block).cast("int"), "__k": (position % block).cast("double")}
    )
    inner = (
        Window.partitionBy(*series.keys, "__block").orderBy(series.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def local(s: Ewm) -> Column:
        weight = F.when(F.col(row_column) == s.seed_row, 1.0).otherwise(s.alpha)
        return F.exp(-s.decay * F.col("__k")) * F.sum(
            weight * F.col(s.source) * F.exp(s.decay * F.col("__k"))
        ).over(inner)

    df = df.withColumns({f"__loc_{s.name}": local(s) for s in specs})
    at_block_end = F.col("__k") == block - 1
    carry = {
        f"__carry_{s.name}": F.last(F.when(at_block_end, F.col(f"__loc_{s.name}")), ignorenulls=True)
        .over(series.before)
        for s in specs
    }
    df = df.withColumns(carry)
    smoothed = {
        s.name: F.col(f"__loc_{s.name}")
        + F.coalesce(F.col(f"__carry_{s.name}"), F.lit(0.0)) * F.exp(-s.decay * (F.col("__k") + 1))
        for s in specs
    }
    helpers = ["__block", "__k", *(f"__{part}_{s.name}" for s in specs for part in ("loc", "carry"))]
    return df.withColumns(smoothed).drop(*helpers)


def ewm_of_ewm(outer_span: int, inner_span: int, outer: Column, inner: Column) -> Column:
    """EWM(outer_span) of EWM(inner_span) of x, from the two smoothings of x itself.

    Both are first-order linear filters seeded as if x had always held its first value, so their
    product splits into partial fractions and needs no second scan.
    """
    a_in, a_out = 2.0 / (inner_span + 1), 2.0 / (outer_span + 1)
    g_in, g_out = 1 - a_in, 1 - a_out
    return (inner * (a_out * g_in) - outer * (a_in * g_out)) / (g_in - g_out)
