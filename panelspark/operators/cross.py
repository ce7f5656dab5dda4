"""Per-date cross-sections.

The number of keys on one date is unbounded, so nothing here opens a window over a date: ranks and
medians use the value-bucketed order statistics, means are aggregates joined back by date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import flag, holds, pct, ratio
from ..functions.order_stats import quantile_columns, ranks
from ..session import cut_lineage
from ..functions.windows import CALENDAR, PANEL as S

# Relative-strength weights and study horizons.
RS_WEIGHTS = {"ret_60d": 0.4, "ret_120d": 0.2, "ret_250d": 0.4}
HORIZONS = (1, 5, 20)


def relative_strength(panel: DataFrame) -> DataFrame:
    """(isin, date, rs_score, rs_rank): weighted within-date percent ranks, then their own rank 0..99, half-even.

    Works on a narrow three-column copy that is materialised once, because an exact distributed rank reads
    its input more than once; the wide panel is never shuffled by value.
    """
    key = ["isin", "date"]
    narrow = cut_lineage(panel.select(*key, *RS_WEIGHTS))
    pct = ranks(narrow, key, ["date"], {f"p_{n}": n for n in RS_WEIGHTS})
    score = sum((F.col(f"p_{n}") * w for n, w in RS_WEIGHTS.items()), F.lit(0.0))
    # Scores that differ only in the last bits of the weighted sum are ties.
    scored = cut_lineage(pct.select(*key, F.round(score, 12).alias("rs_score")).filter("rs_score is not null"))
    place = ranks(scored, key, ["date"], {"__p": "rs_score"})
    return scored.join(place, key).select(*key, "rs_score", F.bround(F.col("__p") * 99, 0).alias("rs_rank"))


def add_relative_strength(panel: DataFrame) -> DataFrame:
    return panel.join(relative_strength(panel), ["isin", "date"], "left")


def add_forward_returns(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward returns, the equal-weight benchmark of their date, and the excess."""
    close = F.col("adj_close")
    df = df.withColumns({f"fwd_{k}d": pct(S.lead(close, k), close) for k in horizons})
    bench = df.groupBy("date").agg(*[F.avg(f"fwd_{k}d").alias(f"bench_{k}d") for k in horizons])
    df = df.join(bench, "date", "left")
    return df.withColumns({f"exc_{k}d": F.col(f"fwd_{k}d") - F.col(f"bench_{k}d") for k in horizons})


def add_open_forward_returns(df: DataFrame, horizons: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Return from the next open to the close ``k`` sessions after the signal."""
    entry = S.lead(F.col("adj_open"), 1)
    return df.withColumns({f"ofwd_{k}d": pct(S.lead(F.col("adj_close"), k), entry) for k in horizons})


def top_n(df: DataFrame, by: Sequence[str], score: Column, n: int, ties: Sequence[str] = ("isin",)) -> DataFrame:
    """The ``n`` best rows per group. Spark limits each map task to ``n`` rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), *ties)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).withColumnRenamed("__k", "place")


def composite_score(df: DataFrame, features: dict[str, int], ident: Sequence[str] = ("isin", "date"),
                    by: Sequence[str] = ("date",), out: str = "score") -> DataFrame:
    """Mean of sign-adjusted within-day percent ranks; a missing feature counts as 0.5."""
    keep = list(dict.fromkeys([*ident, *by]))
    narrow = df.select(*keep, *[(F.col(n).cast("double") * sign).alias(n) for n, sign in features.items()])
    pct = ranks(narrow, ident, by, {f"__p_{n}": n for n in features})
    total = sum((F.coalesce(F.col(f"__p_{n}"), F.lit(0.5)) for n in features), F.lit(0.0))
    joined = df.join(pct, list(ident), "left")
    return joined.withColumn(out, total / len(features)).drop(*[f"__p_{n}" for n in features])


def breadth(features: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Participation per group: members above their averages, advances, new extremes, medians."""
    close = F.col("adj_close")
    above = {n: F.count_if(holds(close > F.col(f"sma_{n}"))) for n in (20, 50, 200)}
    members = F.count(F.lit(1))
    counts = features.groupBy(*by).agg(
        members.alias("members"), *[x.alias(f"above_{n}") for n, x in above.items()],
        F.count_if(holds(F.col("ret_1d") > 0)).alias("advancing"),
        F.count_if(holds(F.col("ret_1d") < 0)).alias("declining"),
        F.count_if(holds(F.col("pct_from_52w_high") > -1)).alias("new_highs"),
        F.count_if(holds(F.col("pct_from_52w_low") < 1)).alias("new_lows"))
    counts = counts.withColumns({f"pct_above_{n}": ratio(F.col(f"above_{n}"), F.col("members")) * 100 for n in (50, 200)})
    medians = quantile_columns(features, by, {"median_rsi": ("rsi_14", 0.5), "median_ret_1d": ("ret_1d", 0.5)})
    return counts.join(medians, list(by), "left")


def breadth_series(panel: DataFrame) -> DataFrame:
    """One row per date: shares above averages, advance ratio, dispersion, equal-weight return and index.

    ``ret_1d`` is in per cent. Everything is one partial aggregate per date; the chained index runs
    over the date table only.
    """
    close = F.col("adj_close")

    def share(condition: Column, known: Column | None = None) -> Column:
        x = holds(condition).cast("double")
        return F.avg(x if known is None else F.when(known, x)) * 100

    ret, s200 = F.col("ret_1d"), F.col("sma_200")
    day = panel.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(holds(ret > 0)).alias("adv"), F.count_if(holds(ret < 0)).alias("dec"),
        share(close > F.col("sma_20")).alias("breadth_above_20"),
        share(close > F.col("sma_50")).alias("breadth_above_50"),
        share(close > s200).alias("breadth_above_200"),
        share(close > F.col("sma_50"), F.col("sma_50").isNotNull()).alias("b50"),
        share(close > s200, s200.isNotNull()).alias("b200"),
        share(ret > 0).alias("adv_ratio"),
        share(F.col("ret_20d") > 0).alias("pct_pos_20d"),
        F.count_if(holds(F.col("pct_from_52w_high") >= -0.5)).alias("nh"),
        F.count_if(holds(F.col("pct_from_52w_low") <= 0.5)).alias("nl"),
        F.stddev_samp("ret_1d").alias("dispersion"), F.avg("ret_1d").alias("ew_ret_1d"))
    day = day.withColumn("new_hi_minus_lo", ratio(F.col("nh") - F.col("nl"), F.col("n")) * 100)
    growth = F.lit(1.0) + F.coalesce(F.col("ew_ret_1d"), F.lit(0.0)) / 100
    day = day.withColumn("ew_log", F.sum(F.ln(growth)).over(CALENDAR.so_far()))
    return day.withColumns({
        "ew_ret_20d": (F.exp(F.col("ew_log") - CALENDAR.lag(F.col("ew_log"), 20)) - 1) * 100,
        "breadth_50_chg_10d": F.col("breadth_above_50") - CALENDAR.lag(F.col("breadth_above_50"), 10)})


def equal_weight_level(panel: DataFrame, by: Sequence[str] = (), base: float = 100.0) -> DataFrame:
    """Chain the mean cross-sectional return into a level per group; returns also its logarithm."""
    ret = ratio(F.col("adj_close"), S.lag(F.col("adj_close"))) - 1
    day = panel.withColumn("__ret", ret).groupBy(*by, "date").agg(F.avg("__ret").alias("mean_ret"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.ln(F.lit(1.0) + F.coalesce(F.col("mean_ret"), F.lit(0.0)))).over(run)
    return day.withColumn("log_level", log).withColumn("level", F.exp("log_level") * base)


def market_return_flags(day: DataFrame) -> DataFrame:
    """Equal-weight regime flags: index above its 50 and 200 session averages, breadth above half."""
    level = F.exp("ew_log")
    day = day.withColumn("__l", level)
    return day.withColumns({
        "ew_above_50": flag(F.col("__l") > CALENDAR.mean(F.col("__l"), 50)),
        "ew_above_200": flag(F.col("__l") > CALENDAR.mean(F.col("__l"), 200)),
        "breadth_half": flag(F.col("b50") > 50)}).drop("__l")
