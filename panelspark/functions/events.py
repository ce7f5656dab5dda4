"""Event and sequence functions over an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import holds
from .windows import CALENDAR, PANEL, Series


def crossed_above(x: Column, level: Column, s: Series = PANEL) -> Column:
    """Above the level now and not above it on the previous row; an unknown comparison is "not above"."""
    above = holds(x > level)
    return above & ~F.coalesce(s.lag(above), F.lit(False))


def rows_since(event: Column, s: Series = PANEL, row: Column | None = None) -> Column:
    """Rows since the event last held; null before it ever did.

    Pass ``row`` (a materialised position column) when the series already carries one.
    """
    position = F.col("r") if row is None else row
    return position - F.max(F.when(holds(event), position)).over(s.so_far())


def last_value_at(x: Column, event: Column, s: Series = PANEL, before: bool = False) -> Column:
    """Value of ``x`` on the latest event row, carried forward."""
    return F.last(F.when(holds(event), x), ignorenulls=True).over(s.so_far(before))


def segment(event: Column, s: Series = PANEL) -> Column:
    """Running count of events: the id of the stretch that starts at each event."""
    return F.sum(holds(event).cast("int")).over(s.so_far())


def fresh_after_quiet(event: Column, quiet: int = 10, s: Series = PANEL) -> Column:
    """True with none in the previous ``quiet`` rows, all of which must exist."""
    e = holds(event).cast("int")
    frame = s.frame(quiet, prior=True)
    return holds(event) & (F.count(e).over(frame) == quiet) & (F.sum(e).over(frame) == 0)


def fresh_or_first(event: Column, quiet: int = 20, s: Series = PANEL) -> Column:
    """As above, but the start of a key counts as quiet."""
    e = holds(event).cast("int")
    return holds(event) & (F.coalesce(F.sum(e).over(s.frame(quiet, prior=True)), F.lit(0)) == 0)


def run_length(event: Column, s: Series = PANEL, row: Column | None = None) -> Column:
    """Consecutive true rows ending here: distance to the latest false row."""
    position = F.col("r") if row is None else row
    last_false = F.max(F.when(~holds(event), position)).over(s.so_far())
    return F.when(holds(event), position - F.coalesce(last_false, F.lit(0))).otherwise(0)


def schmitt(x: Column, on_above: float = 50.0, off_below: float = 40.0, s: Series = CALENDAR) -> Column:
    """Two-threshold gate: the latest decisive crossing, 0 before any; null where ``x`` is null."""
    decisive = F.when(x > on_above, 1).when(x < off_below, 0)
    state = F.last(decisive, ignorenulls=True).over(s.so_far())
    return F.when(x.isNotNull(), F.coalesce(state, F.lit(0)))
