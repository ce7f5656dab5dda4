"""Scalar column functions. Division never raises: x/0 and x/null are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pct(a: Column, b: Column) -> Column:
    """Percent distance of ``a`` from ``b``."""
    return (F.try_divide(a, b) - 1) * 100


def clip(x: Column, low: float, high: float) -> Column:
    """Bound ``x``; null stays null (greatest/least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def holds(condition: Column) -> Column:
    """Three-valued logic folded to two: unknown is false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("int")


def clean(x: Column) -> Column:
    """NaN to null; Spark orders NaN above every number, so it must not reach a comparison."""
    return F.when(~F.isnan(x), x)


def bands(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: ``labels[i]`` for ``edges[i] <= x < edges[i+1]``; the last is open-ended."""
    out = F.lit(None).cast("string")
    for i, label in enumerate(labels):
        inside = x >= float(edges[i])
        if i + 1 < len(edges):
            inside = inside & (x < float(edges[i + 1]))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


# Size bands in crore, left-closed.
CAP_EDGES = [0.0, 20_000.0, 100_000.0]
CAP_LABELS = ["Mid", "Large", "Mega"]


def cap_band(size: Column) -> Column:
    return bands(size, CAP_EDGES, CAP_LABELS)


def quadrant(x: Column, y: Column) -> Column:
    return (
        F.when((x >= 100) & (y >= 100), "leading")
        .when(x >= 100, "weakening")
        .when(y >= 100, "improving")
        .otherwise("lagging")
    )


def position_size(equity: Column, risk_per_trade: Column, stop_pct: Column) -> Column:
    """Money to commit so that a stop ``stop_pct`` % away loses ``risk_per_trade`` % of equity."""
    usable = (equity > 0) & (risk_per_trade > 0) & (stop_pct > 0)
    return F.when(usable, equity * F.try_divide(risk_per_trade, stop_pct)).otherwise(0.0)


def lot_count(price: Column, budget: float = 100_000.0) -> Column:
    return F.floor(F.try_divide(F.lit(budget), price))


def pivot_levels(high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Floor-trader pivots and the central range of one finished period."""
    p = (high + low + close) / 3
    mid = (high + low) / 2
    other = p * 2 - mid
    top, bottom = F.greatest(other, mid), F.least(other, mid)
    return {
        "p": p,
        "r1": p * 2 - low,
        "s1": p * 2 - high,
        "r2": p + (high - low),
        "s2": p - (high - low),
        "r3": high + (p - low) * 2,
        "s3": low - (high - p) * 2,
        "cpr_p": p,
        "cpr_tc": top,
        "cpr_bc": bottom,
        "cpr_width": F.try_divide(top - bottom, p) * 100,
    }


def week_monday(date: Column) -> Column:
    """Key of the Monday-to-Sunday week."""
    return F.trunc(date, "week")


def week_friday(date: Column) -> Column:
    """Key of the Saturday-to-Friday week, named by its Friday."""
    return F.date_add(F.trunc(F.date_add(date, 2), "week"), 4)


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")
