"""All AND combinations of the leading filters from one table of masks.

Every trade gets a mask of the leaders it passes. Trades with equal masks add up, so 8 leaders leave at most 256 rows per half, and
a combination keeps the rows whose mask contains it: all combinations of two and three are sums over supersets of that
table. No trade is joined to a combination.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.core import holds

MOST_LEADERS = 16


@dataclass(frozen=True)
class Rule:
    """Fixed values of a passing filter: trades kept per half, kept per month of the half, and the size of a combination."""

    least_kept: int = 30
    least_per_month: float = 20.0
    widest: int = 3


def numbered(leaders: DataFrame, order: list) -> DataFrame:
    """``leaders`` (candidate, ...) with their bit ``i``: a table of ``MOST_LEADERS`` rows at most, so its window is bounded."""
    kept = leaders.orderBy(*order).limit(MOST_LEADERS)
    return kept.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def masked(trades: DataFrame, kept: DataFrame, leaders: DataFrame, ident: str = "sid") -> DataFrame:
    """``trades`` with ``mask``: bit i is set where leader i keeps the trade (``kept``: candidate, ident)."""
    bits = kept.join(leaders.select("candidate", "i"), "candidate").groupBy(ident).agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    return trades.join(bits, ident, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def combinations(trades: DataFrame, leaders: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Results of every combination of one to ``rule.widest`` leaders, per half, and whether it passes in both.

    ``trades`` has half, date, net, bad, good (flags) and mask; ``leaders`` has candidate and i. A combination passes a half when it
    keeps enough trades, in all and per month, with a higher win rate and mean than all trades, and loses fewer good trades
    per bad one than chance would.
    """
    sums = {"n": F.count("net"), "s": F.sum("net"), "w": F.count_if(F.col("net") > 0), "b": F.sum(F.col("bad").cast("int")), "g": F.sum(F.col("good").cast("int"))}
    table = trades.groupBy("half", "mask").agg(*[x.alias(c) for c, x in sums.items()])
    spans = trades.groupBy("half").agg(F.greatest(F.datediff(F.max("date"), F.min("date")) / 30.44, F.lit(1.0)).alias("months"))
    total = table.groupBy("half").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    width = leaders.agg(F.count("*").alias("__k"))  # one row
    subset = F.explode(F.filter(F.sequence(F.lit(1), F.expr("shiftleft(1, __k) - 1").cast("int")), lambda m: F.bit_count(m) <= rule.widest)).alias("combo")
    every = width.filter("__k > 0").select(subset)
    # at most 2 halves x 2**leaders masks on one side and the combinations of the leaders on the other
    met = table.crossJoin(every)
    inside = F.expr("(mask & combo) = combo")
    cells = met.groupBy("half", "combo").agg(*[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(c) for c in sums])
    cells = cells.join(total, "half").join(spans, "half")
    lost_good, lost_bad = F.col("all_g") - F.col("g"), F.col("all_b") - F.col("b")
    cells = cells.select(
        "half", "combo", F.col("all_n").alias("n_all"), F.col("n").alias("n_kept"), (F.col("n") / F.col("all_n")).alias("kept_pct"), (F.col("n") / F.col("months")).alias("kept_per_month"),
        F.try_divide(F.col("w"), F.col("n")).alias("win_kept"), F.try_divide(F.col("s"), F.col("n")).alias("mean_kept"), F.try_divide(F.col("b"), F.col("n")).alias("bad_kept"),
        F.try_divide(F.col("all_w") - F.col("w"), F.col("all_n") - F.col("n")).alias("win_removed"), F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("mean_removed"),
        (lost_bad / F.greatest("all_b", F.lit(1))).alias("bad_removed_share"), (lost_good / F.greatest("all_g", F.lit(1))).alias("good_removed_share"),
        F.when(lost_bad > 0, lost_good / lost_bad).alias("cost"), (F.col("all_g") / F.greatest("all_b", F.lit(1))).alias("cost_by_chance"),
        (F.col("all_w") / F.col("all_n")).alias("base_win"), (F.col("all_s") / F.col("all_n")).alias("base_mean"))
    good = ((F.col("n_kept") >= rule.least_kept) & (F.col("kept_per_month") >= rule.least_per_month) & (F.col("win_kept") > F.col("base_win"))
            & (F.col("mean_kept") > F.col("base_mean")) & (F.col("cost") < F.col("cost_by_chance")))
    cells = cells.withColumn("__good", holds(good).cast("int"))
    both = cells.groupBy("combo").agg((F.sum("__good") == 2).cast("int").alias("passes"))
    names = every.join(leaders.select("candidate", "i"), F.expr("(shiftright(combo, i) & 1) = 1")).groupBy("combo").agg(
        F.concat_ws(" AND ", F.transform(F.array_sort(F.collect_list(F.struct("i", "candidate"))), lambda x: x["candidate"])).alias("filter"), F.count("*").alias("k"))
    return cells.join(both, "combo").join(names, "combo").drop("__good", "combo", "base_win", "base_mean")


def leaderboard(results: DataFrame) -> DataFrame:
    """Passing combinations, one row each: worse half's win rate, mean and share kept; ``place`` orders them by these."""
    one = results.filter("passes = 1").groupBy("filter", "k").agg(F.min("win_kept").alias("worse_win"), F.min("mean_kept").alias("worse_mean"), F.min("kept_pct").alias("worse_kept"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("worse_win"), F.desc("worse_mean"), F.desc("worse_kept"), "filter")  # combinations of the leaders only
    return one.withColumn("place", F.row_number().over(order))
