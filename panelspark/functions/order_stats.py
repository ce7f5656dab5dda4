"""Exact ranks and quantiles of groups that may hold most of the data.

A plain ``rank() over (partition by date)`` or ``percentile`` puts one group in one task. Here a group
is cut into value buckets by a deterministic, order-preserving function of the number itself
(binary exponent and leading mantissa bits), so the cut never depends on sampling or on retries:

1. (group, value) -> count, with map-side partial aggregation, so a hot value is one row;
2. (group, bucket) -> count, and a running total over the buckets of a group (a bounded table);
3. position inside the bucket by a window on (group, bucket).

Nothing is dropped or approximated: the sum of (2) and (3) is the exact position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SUB_BUCKETS = 256


def _bucket(value: Column) -> Column:
    """Monotone integer key: equal values share it, larger values never get a smaller one."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * SUB_BUCKETS)
    key = (exponent + 1100) * SUB_BUCKETS + inside
    return F.when(value == 0, F.lit(0)).when(value > 0, key).otherwise(-key).cast("bigint")


def positions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (group, value): ``cnt``, ``below`` (rows strictly smaller) and ``total``. Null and NaN take no part."""
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("__bucket", _bucket(F.col(value)))
    )
    per_bucket = counts.groupBy(*by, "__bucket").agg(F.sum("cnt").alias("__in"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "__bucket",
        F.coalesce(F.sum("__in").over(ordered), F.lit(0)).alias("__off"),
        F.sum("__in").over(group).alias("total"),
    )
    inner = (Window.partitionBy(*by, "__bucket").orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    local = counts.withColumn("__loc", F.coalesce(F.sum("cnt").over(inner), F.lit(0)))
    return local.join(offsets, [*by, "__bucket"]).select(
        *by, value, "cnt", (F.col("__off") + F.col("__loc")).alias("below"), "total")


def _long(df: DataFrame, keep: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(keep..., m, v): one row per known value of each column, numbered in the order given."""
    cells = [F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns.values())]
    long = df.select(*keep, F.explode(F.array(*cells)).alias("__s")).select(*keep, "__s.__m", "__s.__v")
    return long.filter(F.col("__v").isNotNull())


def _joined_positions(df: DataFrame, ident: Sequence[str], by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Every known cell with its position. A value shared by very many rows is one row on the right side,
    so adaptive skew handling can split the left."""
    keep = list(dict.fromkeys([*ident, *by]))
    long = _long(df, keep, columns)
    at = positions(long, [*by, "__m"], "__v")
    return long.join(at, [*by, "__m", "__v"])


def ranks(df: DataFrame, ident: Sequence[str], by: Sequence[str], columns: dict[str, str], pct: bool = True) -> DataFrame:
    """A narrow frame (ident..., {out: rank of column}) of average-tie ranks within ``by``.

    ``pct`` divides by the count of known values. All columns are ranked in one pass; rows without any
    known value are absent, so callers join from the left. ``df`` is read twice: pass a materialised or a
    cheap narrow frame.
    """
    place = F.col("below") + (F.col("cnt") + 1) / 2
    joined = _joined_positions(df, ident, by, columns).withColumn("__p", place / F.col("total") if pct else place)
    return joined.groupBy(*ident).agg(*[F.max(F.when(F.col("__m") == i, F.col("__p"))).alias(n) for i, n in enumerate(columns)])


def with_ranks(df: DataFrame, ident: Sequence[str], by: Sequence[str], columns: dict[str, str], pct: bool = True) -> DataFrame:
    """``df`` with the ranks of ``ranks`` joined on its identity columns."""
    narrow = df.select(*dict.fromkeys([*ident, *by, *columns.values()]))
    return df.join(ranks(narrow, ident, by, columns, pct), list(ident), "left")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{out: p}``."""
    by = list(by)
    at = positions(df, by, value)
    picks = []
    for out, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        picks.append(F.max(F.when(F.col("below") <= F.floor(place), F.col(value))).alias(f"__lo_{out}"))
        picks.append(F.max(F.when(F.col("below") <= F.ceil(place), F.col(value))).alias(f"__hi_{out}"))
    grouped = at.groupBy(*by).agg(F.max("total").alias("__n"), *picks)
    result = []
    for out, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{out}"), F.col(f"__hi_{out}")
        result.append((low + (high - low) * (place - F.floor(place))).alias(out))
    return grouped.select(*by, *result)


def quantile_columns(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of several columns in one pass, one row per group: ``{out: (value column, p)}``."""
    by = list(by)
    columns = {v: v for v, _ in wanted.values()}
    at = positions(_long(df, by, columns), [*by, "__m"], "__v")
    picks = []
    for i, value in enumerate(columns):
        mine = F.col("__m") == i
        picks.append(F.max(F.when(mine, F.col("total"))).alias(f"__n_{value}"))
        for out, (v, p) in wanted.items():
            if v != value:
                continue
            place = F.lit(float(p)) * (F.col("total") - 1)
            picks.append(F.max(F.when(mine & (F.col("below") <= F.floor(place)), F.col("__v"))).alias(f"__lo_{out}"))
            picks.append(F.max(F.when(mine & (F.col("below") <= F.ceil(place)), F.col("__v"))).alias(f"__hi_{out}"))
    grouped = at.groupBy(*by).agg(*picks)
    result = []
    for out, (v, p) in wanted.items():
        place = F.lit(float(p)) * (F.col(f"__n_{v}") - 1)
        low, high = F.col(f"__lo_{out}"), F.col(f"__hi_{out}")
        result.append((low + (high - low) * (place - F.floor(place))).alias(out))
    return grouped.select(*by, *result)


def row_numbers(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """(by..., out): the place of every row by ``value`` downwards, nulls last, ties in the order of ``by``, without a window over all.

    The rows above a value come from ``positions``; a window only numbers rows of one and the same value. Nulls are one tie
    below all values.
    """
    known = positions(df, [], value).select(F.col(value).alias("__v"), (F.col("total") - F.col("below") - F.col("cnt")).alias("__above"), "total")
    total = df.agg(F.count(value).alias("__known"))  # one row
    tied = df.select(*by, F.col(value).cast("double").alias("__v")).withColumn("__t", F.row_number().over(Window.partitionBy("__v").orderBy(*by)))
    placed = tied.join(known.select("__v", "__above"), "__v", "left").crossJoin(total)
    return placed.select(*by, (F.coalesce("__above", "__known") + F.col("__t")).cast("int").alias(out))
