"""Index analytics over point-in-time members: returns, money flow and rotation, all indices at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import pct, quadrant, ratio, week_friday
from ..functions.windows import Series

# Session counts of the return windows.
RETURN_WINDOWS = {"1D": 1, "1W": 5, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}
INDEX = Series(keys=("index_name",))


def returns_from_level(levels: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Per index, the return of the last level over each window (index_name, date, log_level)."""
    windows = windows or RETURN_WINDOWS
    log = F.col("log_level")
    last = Window.partitionBy("index_name").orderBy(F.col("date").desc())
    changes = {f"ret_{k}": (F.exp(log - INDEX.lag(log, n)) - 1) * 100 for k, n in windows.items()}
    df = levels.withColumns(changes).withColumn("__k", F.row_number().over(last))
    return df.filter(F.col("__k") == 1).select("index_name", "date", *changes)


def money_flow(turnover: DataFrame, fast: int = 5, slow: int = 60) -> DataFrame:
    """Share of the market's turnover per index and how it changes (index_name, date, mine, total)."""
    share = ratio(F.col("mine"), F.col("total")) * 100
    df = turnover.withColumn("share_pct", share)

    def mean(x: str, n: int, back: int = 0) -> Column:
        return F.avg(x).over(INDEX.spec.rowsBetween(-(n + back - 1), -back))

    columns = {"turnover_cr": F.col("mine") / 1e7, "share_5d": mean("share_pct", fast), "share_60d": mean("share_pct", slow)}
    for label, n in (("dod", 1), ("wow", 5), ("mom", 21)):
        columns[f"{label}_pp"] = mean("share_pct", n) - mean("share_pct", n, n)
    for label, n in (("wow", 5), ("mom", 21)):
        columns[f"turnover_{label}"] = pct(mean("mine", n), mean("mine", n, n))
    df = df.withColumns(columns).withColumn("flow_delta", F.col("share_5d") - F.col("share_60d"))
    last = Window.partitionBy("index_name").orderBy(F.col("date").desc())
    return df.withColumn("__k", F.row_number().over(last)).filter(F.col("__k") == 1).drop("__k", "mine", "total")


def rotation(levels: DataFrame, benchmark: str, n: int = 14, m: int = 5, trail: int = 5) -> DataFrame:
    """Weekly relative strength against a benchmark: normalised ratio and momentum, quadrant and trail."""
    bench = levels.filter(F.col("index_name") == benchmark).select("date", F.col("log_level").alias("__b"))
    df = levels.filter(F.col("index_name") != benchmark).join(bench, "date")
    week = df.groupBy("index_name", week_friday(F.col("date")).alias("date")).agg(
        F.max_by(F.col("log_level") - F.col("__b"), "date").alias("__rs"))
    rs = F.exp("__rs") * 100
    week = week.withColumn("rs", rs)

    def normalise(x: Column, k: int) -> Column:
        spread = INDEX.std(x, k, population=True)
        return ratio(x - INDEX.mean(x, k), F.when(spread > 0, spread)) + 100

    week = week.withColumn("rs_ratio", normalise(F.col("rs"), n)).withColumn("rs_mom", normalise(F.col("rs_ratio"), m))
    size = F.count(F.lit(1)).over(Window.partitionBy("index_name"))
    week = week.withColumn("__n", size).filter(F.col("rs_mom").isNotNull() & (F.col("__n") >= n + m + 3))
    recent = Window.partitionBy("index_name").orderBy(F.col("date").desc())
    week = week.withColumn("__k", F.row_number().over(recent)).filter(F.col("__k") <= trail)
    out = week.groupBy("index_name").agg(
        F.max_by("rs_ratio", "date").alias("rs_ratio"), F.max_by("rs_mom", "date").alias("rs_mom"),
        F.sort_array(F.collect_list(F.struct("date", F.round("rs_ratio", 2).alias("x"), F.round("rs_mom", 2).alias("y")))).alias("trail"))
    return out.withColumn("quadrant", quadrant(F.col("rs_ratio"), F.col("rs_mom")))
