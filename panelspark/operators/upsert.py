"""Keyed maintenance: merges, deduplication, repair and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.core import holds
from ..schema import ADJ_BLOCK, coerce

# Fixed value: what a signed 32-bit counter loses when it wraps.
WRAP = 2 ** 32


# Types whose values an aggregate can overwrite in place, so that it hashes and does not sort
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def keep_last(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the last by ``order`` (which must be unique inside a key).

    ``max_by`` has a map-side partial, so a key repeated very often is reduced before the shuffle. Columns of fixed width
    are taken one by one, in a hash aggregate that sorts nothing; with other columns the row is taken as a struct.
    """
    rest = [c for c in df.columns if c not in key]
    if all(isinstance(df.schema[c].dataType, _FIXED) for c in rest):
        return df.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(df.columns)
    latest = F.max_by(F.struct(*rest), order).alias("__row")
    return df.groupBy(*key).agg(latest).select(*key, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def upsert_columns(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Column-wise merge: a known new value wins, a missing one leaves the stored value; ``change`` tells what happened."""
    values = [c for c in stored.columns if c not in key]
    fresh = [c for c in values if c in new.columns]
    right = new.select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(c).alias(f"__n_{c}") for c in fresh], F.lit(True).alias("__new"))
    on = None
    for k in key:
        part = F.col(k) == F.col(f"__k_{k}")
        on = part if on is None else on & part
    joined = stored.withColumn("__old", F.lit(True)).join(right, on, "full")
    merged = [F.coalesce(F.col(k), F.col(f"__k_{k}")).alias(k) for k in key]
    merged += [(F.coalesce(F.col(f"__n_{c}"), F.col(c)) if c in fresh else F.col(c)).alias(c) for c in values]
    differs = F.lit(False)
    for c in fresh:
        differs = differs | (F.col(f"__n_{c}").isNotNull() & ~F.col(f"__n_{c}").eqNullSafe(F.col(c)))
    change = (F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept")
              .when(differs, "updated").otherwise("same"))
    return joined.select(*merged, change.alias("change")).select(*stored.columns, "change")


def upsert_rows(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Whole-row merge: a new row replaces the stored one of the same key."""
    kept = stored.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new.select(stored.columns), allowMissingColumns=True)


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def replace_or_upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], replace: bool) -> DataFrame:
    return new.select(stored.columns) if replace else upsert_rows(stored, new, key)


def latest_status(log: DataFrame, source: str | None = None) -> DataFrame:
    """Newest status per date (and source) of an ingest log."""
    df = log if source is None else log.filter(F.col("source") == source)
    return df.groupBy("date", "source").agg(F.max_by("status", "run_at").alias("status"), F.max("run_at").alias("run_at"))


def repair_wrapped(df: DataFrame, column: str = "volume") -> DataFrame:
    """Undo a 32-bit overflow; ``repaired`` marks rows that became positive."""
    x = F.col(column).cast("bigint")
    fixed = F.when(x < 0, x + F.lit(WRAP)).otherwise(x)
    return df.withColumns({column: fixed, "repaired": (holds(x < 0) & holds(fixed > 0)).cast("int")})


def usable(block: Sequence[str] = tuple(ADJ_BLOCK)) -> Column:
    """Known, positive, consistent prices and a volume that is not negative."""
    o, h, l, c = (F.col(n) for n in block)
    sound = (o > 0) & (h > 0) & (l > 0) & (c > 0) & (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (h >= l)
    known = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    return holds(known & sound & (F.coalesce(F.col("volume"), F.lit(0)) >= 0))


def split_usable(df: DataFrame, block: Sequence[str] = tuple(ADJ_BLOCK)) -> tuple[DataFrame, DataFrame]:
    return df.filter(usable(block)), df.filter(~usable(block))


def quarantine(bad: DataFrame, reason: str, source: str) -> DataFrame:
    """Rejected rows with the reason they were rejected, ready to append."""
    return bad.withColumns({"reason": F.lit(reason), "source": F.lit(source), "quarantined_at": F.current_timestamp()})


def drop_unproven(df: DataFrame) -> DataFrame:
    """Clear an adjusted block that has no recorded source."""
    bad = F.col("adj_close").isNotNull() & F.col("adj_source").isNull()
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in ADJ_BLOCK})


def lookup_chain(df: DataFrame, key: str, target: str, tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """First known value of ``target`` along a chain of dimensions (frame, value column)."""
    names = [F.col(target)] if target in df.columns else []
    for i, (dim, value) in enumerate(tables):
        side = dim.groupBy(F.col(key).alias(f"__k{i}")).agg(F.max(value).alias(f"__v{i}"))
        df = df.join(side, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        names.append(F.col(f"__v{i}"))
    return df.withColumn(target, F.coalesce(*names)).drop(*[f"__v{i}" for i in range(len(tables))])


def merge_bars(stored: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """The write path of bars: coerce, keep the last of repeated keys, merge column-wise."""
    fresh = keep_last(new, ["isin", "date"], order)
    return upsert_columns(coerce(stored, "bars"), coerce(fresh, "bars"), ["isin", "date"])
