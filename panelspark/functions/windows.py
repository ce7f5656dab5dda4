"""Ordered per-key windows.

A daily panel is unique on (key, date), so one key holds at most one row per session: about
2,500 rows per decade. That bound, enforced by the keyed merge, is what makes a
``partitionBy(key)`` window safe on any number of keys. Raw observations are never windowed;
they are pre-aggregated to bars first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

LINEAR = 40  # frames from here on are sums of running values, not recomputed row by row
BLOCK = 25


@dataclass(frozen=True)
class Series:
    """Window vocabulary over one ordering: ``keys`` (may be empty for a date-level table) and ``order``."""

    keys: tuple[str, ...] = ("isin",)
    order: tuple[str, ...] = ("date",)

    @property
    def spec(self) -> WindowSpec:
        keys = [F.col(k) for k in self.keys] or [F.lit(0)]
        return Window.partitionBy(*keys).orderBy(*self.order)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.spec)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.spec)

    def row(self) -> Column:
        """1-based position within the key."""
        return F.row_number().over(self.spec)

    def frame(self, n: int, prior: bool = False) -> WindowSpec:
        """The last ``n`` rows, ending here or (``prior``) on the row before."""
        return self.spec.rowsBetween(-n, -1) if prior else self.spec.rowsBetween(-(n - 1), 0)

    def so_far(self, before: bool = False) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def known(self, x: Column, n: int, prior: bool = False) -> Column:
        """How many of the last ``n`` values are known, as a difference of running counts."""
        return self._since(F.count(x), n, prior)

    def _since(self, aggregate: Column, n: int, prior: bool) -> Column:
        """A running count or sum here less the one ``n`` rows ago: Spark keeps running frames, but goes over a moving one on every row."""
        head = self.so_far(before=prior)
        tail = self.spec.rowsBetween(Window.unboundedPreceding, -n - int(prior))
        return aggregate.over(head) - F.coalesce(aggregate.over(tail), F.lit(0))

    def _roll(self, aggregate: Column, x: Column, n: int, least: int | None, prior: bool) -> Column:
        return F.when(self.known(x, n, prior) >= (n if least is None else least), aggregate.over(self.frame(n, prior)))

    def mean(self, x: Column, n: int, least: int | None = None, prior: bool = False) -> Column:
        if n < LINEAR:
            return self._roll(F.avg(x), x, n, least, prior)
        return F.try_divide(self.total(x, n, least, prior), self.known(x, n, prior))

    def total(self, x: Column, n: int, least: int | None = None, prior: bool = False) -> Column:
        """Sum of the last ``n``. Wide frames difference running sums; over a key's rows that costs about rows x 1e-16 of the largest value."""
        if n < LINEAR:
            return self._roll(F.sum(x), x, n, least, prior)
        return F.when(self.known(x, n, prior) >= (n if least is None else least), self._since(F.sum(x), n, prior))

    def highest(self, x: Column, n: int, least: int | None = None, prior: bool = False) -> Column:
        return self._roll(F.max(x), x, n, least, prior)

    def lowest(self, x: Column, n: int, least: int | None = None, prior: bool = False) -> Column:
        return self._roll(F.min(x), x, n, least, prior)

    def wide(self, pick, x: Column, block: Column, n: int, least: int | None = None, prior: bool = False) -> Column:
        """Extreme of the last ``n`` values of ``x`` from ``block``, a column with that of its last ``BLOCK``: ``n / BLOCK`` lags.

        ``pick`` is ``F.greatest`` or ``F.least``; both skip nulls, and overlapping blocks do no harm.
        """
        places = sorted({*range(0, n - BLOCK + 1, BLOCK), n - BLOCK})
        values = [self.lag(block, o + int(prior)) if o + int(prior) else block for o in places]
        return F.when(self.known(x, n, prior) >= (n if least is None else least), pick(*values) if len(values) > 1 else values[0])

    def std(self, x: Column, n: int, population: bool = False, least: int | None = None) -> Column:
        return self._roll(F.stddev_pop(x) if population else F.stddev_samp(x), x, n, least, False)

    def median(self, x: Column, n: int, least: int | None = None) -> Column:
        return self._roll(F.percentile(x, F.lit(0.5)), x, n, least, False)

    def beta(self, y: Column, x: Column, n: int, least: int, population: bool = False) -> Column:
        """Covariance over variance of ``x`` for the last ``n`` rows where both are known, from differences of running sums.

        Both are changes around zero, so sums of products do not cancel.
        """
        both = y.isNotNull() & x.isNotNull()
        y2, x2 = F.when(both, y), F.when(both, x)
        sx, sy, sxy, sxx = (self._since(F.sum(v), n, False) for v in (x2, y2, x2 * y2, x2 * x2))
        known = self.known(x2, n)
        var = sxx - F.try_divide(sx * sx, known)
        return F.when(known >= max(least, 1 if population else 2), F.try_divide(sxy - F.try_divide(sx * sy, known), F.when(var > sxx * 1e-12, var)))

    def rank_in_window(self, x: Column, n: int) -> Column:
        """Percent rank (average ties) of the last value among its own last ``n``; needs all ``n``."""
        values = F.collect_list(x).over(self.frame(n))
        below = F.size(F.filter(values, lambda v: v < x))
        same = F.size(F.filter(values, lambda v: v == x))
        return F.when(F.size(values) == n, (below + (same + 1) / 2) / n * 100)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by key into the session's shuffle width before heavy window work.

    It is the exchange the windows need anyway. Naming the width keeps adaptive execution from merging the
    partitions by size: window columns cost CPU per row, so a small-looking shuffle still wants every core.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *[F.col(k) for k in keys or ("isin",)])


PANEL = Series()
CALENDAR = Series(keys=())
