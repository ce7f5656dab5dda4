"""Corporate actions: suffix-product factors, derived raw prices and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.core import holds, ratio
from ..schema import ADJ_BLOCK, RAW_BLOCK


def factors_by_action(actions: DataFrame) -> DataFrame:
    """Per action, the product of its ratio and every later one of the key (ratios must be positive).

    Actions of the same key and day are multiplied first; a key has few actions.
    """
    usable = actions.filter(holds(F.col("ratio") > 0) & F.col("ex_date").isNotNull())
    day = usable.groupBy("isin", "ex_date").agg(F.product("ratio").alias("ratio"))
    later = Window.partitionBy("isin").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return day.select("isin", "ex_date", F.product("ratio").over(later).alias("suffix"))


def with_factor(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """``adj_factor`` = product of the ratios strictly after the bar's date, 1 when there is none.

    Bars and actions are stacked and ordered by key and date, newest first; the next action's suffix
    product is the last one seen. One shuffle on the key, no range join.
    """
    marks = factors_by_action(actions).select("isin", F.col("ex_date").alias("date"), F.col("suffix").alias("__suffix"), F.lit(0).alias("__bar"))
    stacked = bars.withColumn("__bar", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    # On the same date the bar comes first (newest first), so an action on its own date does not apply.
    w = Window.partitionBy("isin").orderBy(F.col("date").desc(), F.col("__bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = stacked.withColumn("adj_factor", F.coalesce(F.last("__suffix", ignorenulls=True).over(w), F.lit(1.0)))
    return out.filter(F.col("__bar") == 1).drop("__bar", "__suffix")


def derive_raw(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Fill missing raw prices from adjusted ones; an observed raw price always wins."""
    df = with_factor(bars, actions)
    out = {}
    for raw, adj in zip(RAW_BLOCK, ADJ_BLOCK):
        derived = F.col(adj) * F.col("adj_factor")
        out[raw] = F.coalesce(F.col(raw), derived) if raw in bars.columns else derived
    return df.withColumns(out)


def verify_raw(bars: DataFrame, actions: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Derived against observed close where both exist."""
    both = bars.filter(F.col("close").isNotNull() & F.col("adj_close").isNotNull())
    df = with_factor(both, actions).withColumn("derived_close", F.col("adj_close") * F.col("adj_factor"))
    df = df.withColumn("rel_err", ratio(F.abs(F.col("derived_close") - F.col("close")), F.col("close")))
    return df.withColumn("ok", holds(F.col("rel_err") <= tolerance))
