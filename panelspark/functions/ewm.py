"""Exponentially weighted recursions as window expressions.

y_0 = x_0, y_t = (1-a) y_{t-1} + a x_t is a weighted prefix sum. Scaling by (1-a)^-t lets one
running ``sum`` compute it, but the scale overflows on long series. So rows are cut into
blocks whose decay over one block is e^-600: everything older than the previous block has a
weight below 1e-260, less than the smallest relative step of a double, and the recursion equals
"this block's running sum + the decayed end of the previous block". No Python, no join, and the
partitioning on the key is reused (one extra local sort per distinct decay).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import PANEL, Series


def _block_rows(alpha: float) -> int:
    return max(1, int(600 / -math.log1p(-alpha)))


Spec = tuple[str, float] | tuple[str, float, str]


def ewm_scan(df: DataFrame, specs: dict[str, Spec], s: Series = PANEL) -> DataFrame:
    """Add ``{out: (input column, alpha)}``. Leading nulls are skipped; a null after the start repeats the last value.

    A third element names a column that is null exactly where the input is: recursions of one decay over such inputs
    share their blocks, and with them a sort.
    """
    return df if not specs else _combine(_partials(df, specs, s), specs, s, df.columns)


def _names(out: str, spec: Spec) -> tuple[str, str, str, str]:
    known, rows = spec[-1] if len(spec) > 2 else spec[0], _block_rows(spec[1])
    return f"__n_{known}", f"__b{rows}_{known}", f"__j{rows}_{known}", f"__{out}_p"


def _partials(df: DataFrame, specs: dict[str, Spec], s: Series) -> DataFrame:
    counts, places, sums = {}, {}, {}
    for out, spec in specs.items():
        n, b, j, p = _names(out, spec)
        rows, keep = _block_rows(spec[1]), 1.0 - spec[1]
        counts[n] = F.count(F.col(n.removeprefix("__n_"))).over(s.so_far()) - 1
        places[b] = F.floor(F.col(n) / rows)
        places[j] = (F.col(n) - F.floor(F.col(n) / rows) * rows).cast("double")
        block = Window.partitionBy(*s.keys, b).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
        weight = F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.lit(spec[1]))
        scaled = F.when(F.col(spec[0]).isNotNull(), weight * F.col(spec[0]) * F.pow(F.lit(keep), -F.col(j)))
        sums[p] = F.pow(F.lit(keep), F.col(j)) * F.sum(scaled).over(block)
    return df.withColumns(counts).withColumns(places).withColumns(sums)


def _combine(df: DataFrame, specs: dict[str, Spec], s: Series, keep_columns: list[str]) -> DataFrame:
    carries, result = {}, {}
    for out, spec in specs.items():
        n, b, j, p = _names(out, spec)
        ends = F.when((F.col(j) == _block_rows(spec[1]) - 1) & F.col(spec[0]).isNotNull(), F.col(p))
        carries[f"__{out}_c"] = F.last(ends, ignorenulls=True).over(s.so_far(before=True))
        decayed = F.pow(F.lit(1.0 - spec[1]), F.col(j) + 1) * F.coalesce(F.col(f"__{out}_c"), F.lit(0.0))
        result[out] = F.when(F.col(n) >= 0, F.col(p) + decayed)
    return df.withColumns(carries).withColumns(result).select(*keep_columns, *specs)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def blank_head(x: Column, source: Column, rows: int, s: Series = PANEL) -> Column:
    """Null until ``rows`` known inputs have been seen."""
    return F.when(F.count(source).over(s.so_far()) >= rows, x)


def ewm_mean_adjusted(df: DataFrame, x: str, out: str, span: int, s: Series = PANEL) -> DataFrame:
    """The bias-corrected form: weighted values over summed weights, as a ratio of two recursions.

    With every weight alpha*(1-a)^k the recursion on x differs from the plain weighted sum only by the
    starting weight, so both numerator and denominator subtract (1-a)^(n+1) of the first value.
    """
    alpha = span_alpha(span)
    first = F.first(F.col(x), ignorenulls=True).over(s.so_far())
    seen = F.count(F.col(x)).over(s.so_far())
    df = ewm_scan(df, {f"__{out}_y": (x, alpha)}, s)
    head = F.pow(F.lit(1.0 - alpha), seen.cast("double"))
    value = (F.col(f"__{out}_y") - head * first) / (F.lit(1.0) - head)
    return df.withColumn(out, value).drop(f"__{out}_y")
