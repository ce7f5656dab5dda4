"""Grouped statistics of hits and trades.

Counts, sums and means are partial aggregates. Medians and percentiles use the value-bucketed order
statistics, because one rule may own most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import holds, ratio
from ..functions.order_stats import quantile_columns, quantiles
from .cross import top_n

# Histogram edges and clip of excess returns.
EXCESS_EDGES = [-15.0, -10.0, -6.0, -3.0, -1.0, 0.0, 1.0, 3.0, 6.0, 10.0, 15.0]
EXCESS_CLIP = 40.0
MIN_SAMPLE = 5


def share(condition: Column) -> Column:
    """Per cent of the group where the condition holds."""
    return F.avg(holds(condition).cast("double")) * 100


def mean_if(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def horizon_stats(hits: DataFrame, by: Sequence[str], excess: str, raw: str, least: int = MIN_SAMPLE) -> DataFrame:
    """Sample size, win share, mean, quartiles and spread of the excess, and the raw figures beside it."""
    x, r = F.col(excess), F.col(raw)
    agg = hits.groupBy(*by).agg(
        F.count(x).alias("n"), (F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))) * 100).alias("win"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.avg(r).alias("raw_mean"), (F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))) * 100).alias("raw_win"))
    q = quantiles(hits, by, excess, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    out = agg.join(q, list(by), "left")
    return out.select(*by, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c)
                                  for c in ("win", "mean", "median", "p25", "p75", "std", "raw_mean", "raw_win")])


def long_horizons(hits: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """(keep..., horizon, exc, fwd): one row per hit and horizon."""
    parts = F.array(*[F.struct(F.lit(str(k)).alias("horizon"), F.col(f"exc_{k}d").alias("exc"), F.col(f"fwd_{k}d").alias("fwd")) for k in horizons])
    return hits.select(*keep, F.explode(parts).alias("__s")).select(*keep, "__s.horizon", "__s.exc", "__s.fwd")


def histogram(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float] = EXCESS_EDGES, bound: float = EXCESS_CLIP) -> DataFrame:
    """Counts per open-ended bin; bin i holds values with exactly i edges at or below them."""
    v = F.least(F.greatest(F.col(value), F.lit(-bound)), F.lit(bound))
    place = sum(((v >= e).cast("int") for e in edges), F.lit(0))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def equal_width_histogram(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin of [low, high]; the last bin includes its right edge, values outside are left out."""
    v = F.col(value)
    place = F.least(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)) - 1
    return df.filter(v.between(low, high)).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def concentration(hits: DataFrame, by: Sequence[str], value: str, top: int = 10, least: int = 20) -> DataFrame:
    """Share of the gross positive result produced by the ``top`` names, per group."""
    known = hits.filter(F.col(value).isNotNull())
    names = known.groupBy(*by, "isin").agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    total = names.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.count(F.lit(1)).alias("names"), F.count_if(F.col("__sum") > 0).alias("winners"),
        F.sum(F.greatest(F.col("__sum"), F.lit(0.0))).alias("gross_up"))
    best = top_n(names, list(by) or [F.lit(0)], F.col("__sum"), top).groupBy(*by).agg(F.sum(F.greatest(F.col("__sum"), F.lit(0.0))).alias("__top"))
    out = total.join(best, list(by)) if by else total.crossJoin(best)
    out = out.filter(F.col("n") >= least)
    mid = quantiles(known, by, value, {"median": 0.5})
    out = out.join(mid, list(by)) if by else out.crossJoin(mid)
    return out.withColumn("top10_share", F.when(F.col("gross_up") > 0, F.col("__top") / F.col("gross_up") * 100)).drop("__top")


def breakdown(hits: DataFrame, dimension: Column, horizons: Sequence[int], by: Sequence[str] = ("rule",)) -> DataFrame:
    """Horizon statistics per (rule, group, horizon): by size band, by year."""
    tagged = hits.withColumn("group", dimension)
    return horizon_stats(long_horizons(tagged, horizons, [*by, "group"]), [*by, "group", "horizon"], "exc", "fwd")


def breakdowns(hits: DataFrame, dimensions: dict[str, Column], horizons: Sequence[int], by: Sequence[str] = ("rule",), least: int = MIN_SAMPLE) -> DataFrame:
    """Horizon statistics over all hits and by each of several dimensions: one aggregate with grouping sets, so one exchange.

    (by..., dimension, group, horizon, n, ...): ``dimension`` is 'all' or a name of ``dimensions``; a hit without a group takes no
    part in that dimension. Quartiles come from the order statistics of the same groups (``breakdown_quartiles``).
    """
    long = long_horizons(hits.withColumns(dimensions), horizons, [*by, *dimensions])
    x, r = F.col("exc"), F.col("fwd")
    sets = [[*by, "horizon"], *([*by, d, "horizon"] for d in dimensions)]
    out = long.groupingSets(sets, *by, *dimensions, "horizon").agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dimensions], F.count(x).alias("n"), (F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))) * 100).alias("win"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.avg(r).alias("raw_mean"), (F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))) * 100).alias("raw_win"))
    which, group = F.lit("all"), F.lit("all")
    for d in dimensions:
        which = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(which)
        group = F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(group)
    out = out.select(*by, which.alias("dimension"), group.alias("group"), "horizon", "n",
                     *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("win", "mean", "std", "raw_mean", "raw_win")])
    return out.filter(F.col("group").isNotNull())


def breakdown_quartiles(hits: DataFrame, dimensions: dict[str, Column], horizons: Sequence[int], by: Sequence[str] = ("rule",), least: int = MIN_SAMPLE) -> DataFrame:
    """(by..., dimension, group, horizon, median, p25, p75) for the groups of ``breakdowns``, exact and without a task per group."""
    groups = F.array(*[F.struct(F.lit(d).alias("dimension"), x.cast("string").alias("group")) for d, x in {"all": F.lit("all"), **dimensions}.items()])
    spread = hits.withColumn("__d", F.explode(groups)).withColumns({"dimension": F.col("__d.dimension"), "group": F.col("__d.group")}).filter(F.col("group").isNotNull())
    long = long_horizons(spread, horizons, [*by, "dimension", "group"])
    keys = [*by, "dimension", "group", "horizon"]
    found = quantiles(long, keys, "exc", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    enough = long.groupBy(*keys).agg(F.count("exc").alias("__n")).filter(F.col("__n") >= least)
    return found.join(enough.drop("__n"), keys, "left_semi")


def years_positive(by_year: DataFrame, horizon: str = "20") -> DataFrame:
    known = by_year.filter((F.col("horizon") == horizon) & F.col("mean").isNotNull())
    return known.groupBy("rule").agg(F.count_if(F.col("mean") > 0).alias("years_positive"), F.count(F.lit(1)).alias("years_total"))


def bracket_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outcome shares, win rate, averages, expectancy in R, profit factor."""
    ret = F.col("gross")
    win, loss = ret > 0, ret <= 0
    gain, pain = F.coalesce(sum_if(ret, win), F.lit(0.0)), F.coalesce(sum_if(-ret, loss), F.lit(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[share(F.col("why") == w).alias(f"{w}_pct") for w in ("target", "stop", "time")],
        share(win).alias("win"), F.avg(ret).alias("avg"), F.coalesce(mean_if(ret, win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(mean_if(ret, loss), F.lit(0.0)).alias("avg_loss"), F.avg("r_multiple").alias("expectancy_r"),
        F.when(pain > 0, gain / pain).alias("profit_factor"), F.avg("bars").alias("avg_bars"), F.avg("risk_pct").alias("avg_risk"))


def _month_means(trades: DataFrame, by: Sequence[str], value: str, least: int = 1) -> DataFrame:
    months = trades.groupBy(*by, F.trunc("date", "month").alias("mo")).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("k"))
    return months.filter(F.col("k") >= least)


def reversal_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Headline numbers of a net trade list, with monthly consistency."""
    net = F.col("net")
    win, loss = net > 0, net <= 0
    head = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(net).alias("net"), share(win).alias("win"),
        F.coalesce(mean_if(net, win), F.lit(0.0)).alias("avg_win"), F.coalesce(mean_if(net, loss), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.try_divide(sum_if(net, win), -sum_if(net, loss)), F.lit(0.0)).alias("profit_factor"),
        F.avg("bars").alias("avg_bars"), share(F.col("why") == "reversal").alias("on_reversal"), share(net < -8).alias("big_loss"))
    head = head.withColumn("payoff", F.when(F.col("avg_loss") < 0, F.col("avg_win") / -F.col("avg_loss")).otherwise(0.0))
    months = _month_means(trades, by, "net").groupBy(*by).agg(share(F.col("m") > 0).alias("months_up"), F.min("m").alias("worst_month"))
    return head.join(months, list(by)) if by else head.crossJoin(months)


def lab_stats(trades: DataFrame, by: Sequence[str], least: int = 25) -> DataFrame:
    """Study statistics; null group when small or one-sided."""
    net = F.col("net")
    win, loss = net > 0, net <= 0
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(win).alias("win"), F.avg(net).alias("net"), mean_if(net, win).alias("avg_win"),
        mean_if(net, loss).alias("avg_loss"), F.try_divide(mean_if(net, win), -mean_if(net, loss)).alias("payoff"),
        F.try_divide(sum_if(net, win), -sum_if(net, loss)).alias("pf"), share(F.col("why") == "stop").alias("stopped"),
        F.avg("bars").alias("bars"), F.avg(ratio(net, F.col("risk_pct"))).alias("exp_r"), F.avg("risk_pct").alias("risk"),
        F.countDistinct("date").alias("days"),
        (F.count(F.lit(1)) / F.greatest(F.datediff(F.max("date"), F.min("date")) / 30.44, F.lit(1.0))).alias("per_month"))
    mids = quantile_columns(trades, by, {"median": ("net", 0.5), "mae_med": ("mae", 0.5), "mfe_med": ("mfe", 0.5)})
    out = out.join(mids, list(by)) if by else out.crossJoin(mids)
    return out.filter((F.col("n") >= least) & F.col("avg_win").isNotNull() & F.col("avg_loss").isNotNull())


def consistency(trades: DataFrame, by: Sequence[str], value: str = "r_multiple", least: int = 5) -> DataFrame:
    """Monthly means: share positive, worst month, longest run of months at or below zero, yearly Sharpe, return per slot-month."""
    months = _month_means(trades, by, value, least)
    w = Window.partitionBy(*by).orderBy("mo") if by else Window.partitionBy(F.lit(0)).orderBy("mo")
    months = months.withColumn("__p", F.row_number().over(w))
    last_up = F.max(F.when(F.col("m") > 0, F.col("__p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    months = months.withColumn("__run", F.col("__p") - F.coalesce(last_up, F.lit(0)))
    agg = months.groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"), share(F.col("m") > 0).alias("months_up"), F.min("m").alias("worst_month"),
        F.max("__run").alias("losing_run"), (F.try_divide(F.avg("m"), F.stddev_samp("m")) * 12 ** 0.5).alias("sharpe"))
    pace = trades.groupBy(*by).agg((F.avg("net") * 21 / F.greatest(F.avg("bars"), F.lit(1.0))).alias("per_slot_month"))
    return agg.join(pace, list(by)) if by else agg.crossJoin(pace)


def losing_streak(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Longest run of days whose trades all ended at or below zero.

    Days, not single trades, so the ordered pass stays bounded by the calendar.
    """
    days = trades.groupBy(*by, "date").agg(F.max("net").alias("best"))
    w = Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date")
    days = days.withColumn("__p", F.row_number().over(w))
    last_up = F.max(F.when(F.col("best") > 0, F.col("__p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("__run", F.col("__p") - F.coalesce(last_up, F.lit(0)))
    return days.groupBy(*by).agg(F.max("__run").alias("losing_days"))


def quarter_table(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    quarter = F.concat(F.year("date"), F.lit("Q"), F.quarter("date"))
    return trades.groupBy(*by, quarter.alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("net") > 0).alias("win"), F.avg("net").alias("net"),
        share(F.col("why") == "stop").alias("stopped"))


def quarter_verdict(quarters: DataFrame, by: Sequence[str], value: str = "net", min_share: float = 0.6, floor: float = -8.0) -> DataFrame:
    """Pass when enough quarters are positive and the worst one stays above the floor."""
    out = quarters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("quarters_tested"), F.count_if(F.col(value) > 0).alias("quarters_positive"), F.min(value).alias("worst_quarter"),
        F.min_by("quarter", value).alias("worst_q"))
    passed = (F.col("quarters_positive") / F.col("quarters_tested") >= min_share) & (F.col("worst_quarter") > floor)
    return out.withColumn("quarter_pass", passed.cast("int"))


def excursion_report(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """How far winners dip before working, and how far losers run first."""
    side = F.when(F.col("net") > 0, "winners").otherwise("losers")
    tagged = trades.withColumn("side", side)
    q = quantile_columns(tagged, [*by, "side"], {
        "mae_p25": ("mae", 0.25), "mae_med": ("mae", 0.5), "mae_p75": ("mae", 0.75), "mae_p90": ("mae", 0.9), "mfe_med": ("mfe", 0.5)})
    n = tagged.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n"))
    return n.join(q, [*by, "side"])


def breach_shares(trades: DataFrame, by: Sequence[str], widths: Sequence[float]) -> DataFrame:
    """Per stop width: share of winners that dipped beyond it (what a tighter stop would have cost)."""
    cells = trades.filter(F.col("net") > 0).select(*by, "mae", F.explode(F.array(*[F.lit(float(x)) for x in widths])).alias("width"))
    return cells.groupBy(*by, "width").agg(share(F.col("mae") <= -F.col("width")).alias("breached"))


def survivorship(trades: DataFrame, by: Sequence[str], size: str, floor: float) -> DataFrame:
    """Results of names below and above a size floor at the signal, and of unknown size."""
    group = F.when(F.col(size).isNull(), "unknown").when(F.col(size) >= floor, "above").otherwise("below")
    return trades.groupBy(*by, group.alias("size_group")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("net") > 0).alias("win"), F.avg("net").alias("net"))


def crowding(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signals of the same strategy on the same date, on every trade: counted per date, joined back."""
    counts = trades.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("same_day"))
    return trades.join(counts, [*by, "date"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Most frequent value per group (smallest on a tie) and the number of distinct values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy(*by).agg(F.max("k").alias("__top"), F.count(F.lit(1)).alias("nunique"))
    joined = counts.join(top, list(by)) if by else counts.crossJoin(top)
    return joined.filter(F.col("k") == F.col("__top")).groupBy(*by).agg(F.min(column).alias("mode"), F.first("nunique").alias("nunique"), F.first("k").alias("n"))
