"""Which market gates would have helped: every gate and combination judged on trades that were reduced to their dates first.

A gate has one state per session, so a date needs two 64-bit masks: gates whose state is known, and gates that are on. Trades become
sums per (strategy, half, date); dates with equal masks add up. All gates, and all pairs of them, are then bit tests on that
table, whose size is bounded by the calendar: no trade ever meets a gate. The clustered error needs no second pass either: with
one state per date a cluster's score is its sum of nets less its count times the mean, so sums of squares and products do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import holds

POOLED = "POOLED_MAIN"


@dataclass(frozen=True)
class Limits:
    """Fixed values of the study: trades per side of a cell, share of sessions on, trades per month, edge and t of a robust gate."""

    least_side: int = 30
    least_on_pct: float = 40.0
    least_month: int = 20
    least_quarter_side: int = 20
    edge: float = 0.5
    t: float = 2.0


@dataclass(frozen=True)
class Combination:
    """A gate on its own (``b`` = ``a``) or two joined by AND, OR or AND_NOT; unknown where one of them is."""

    name: str
    a: str
    b: str
    mode: str = "AND"


def singles(names: Sequence[str]) -> list[Combination]:
    return [Combination(n, n, n) for n in names]


def pairs(names: Sequence[str]) -> list[Combination]:
    """AND and OR of every two of ``names``."""
    return [Combination(f"{a} {mode} {b}", a, b, mode) for i, a in enumerate(names) for b in names[i + 1:] for mode in ("AND", "OR")]


def date_masks(gates: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, known, lit) of a gate table (gate, date, on): bit i stands for ``names[i]``; at most 64 names."""
    if len(names) > 64:
        raise ValueError("a mask holds 64 gates; study more in several runs")
    place = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("gate"))
    bit = F.expr("shiftleft(1L, __i)")
    marked = gates.withColumn("__i", place).filter(F.col("__i").isNotNull())
    return marked.groupBy("date").agg(F.bit_or(F.when(F.col("on").isNotNull(), bit).otherwise(0)).alias("known"), F.bit_or(F.when(F.col("on") == 1, bit).otherwise(0)).alias("lit"))


def _unfolded(patterns: DataFrame, names: Sequence[str], wanted: Sequence[Combination]) -> DataFrame:
    """A row per pattern and combination that is known under it, with its state ``on``."""
    place = {n: i for i, n in enumerate(names)}
    cells = [F.struct(F.lit(w.name).alias("gate"), F.lit(place[w.a]).alias("a"), F.lit(place[w.b]).alias("b"), F.lit(w.mode).alias("mode")) for w in wanted]
    rows = patterns.withColumn("__w", F.explode(F.array(*cells))).select(*patterns.columns, "__w.*")
    bit = lambda mask, at: F.expr(f"(shiftright({mask}, {at}) & 1) = 1")
    on = (F.when(F.col("mode") == "AND", bit("lit", "a") & bit("lit", "b")).when(F.col("mode") == "OR", bit("lit", "a") | bit("lit", "b"))
          .otherwise(bit("lit", "a") & ~bit("lit", "b")))
    return rows.filter(bit("known", "a") & bit("known", "b")).withColumn("on", on).drop("known", "lit", "a", "b", "mode")


def _summed(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of ``columns`` where the gate is on (``_on``) and off (``_off``)."""
    side = {"on": F.col("on"), "off": ~F.col("on")}
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(s, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k, s in side.items() for c in columns])


def _clustered_t(diff: Column) -> Column:
    """t of on less off with errors clustered by date, from the sums of a cell."""
    part = []
    for k in ("on", "off"):
        n, mean = F.col(f"n_{k}"), F.col(f"mean_{k}")
        part.append((F.col(f"ss_{k}") - mean * F.col(f"sn_{k}") * 2 + mean * mean * F.col(f"nn_{k}")) / (n * n))
    variance = part[0] + part[1]
    return F.when((F.col("n_on") >= 5) & (F.col("n_off") >= 5) & (variance > 0), diff / F.sqrt(variance))


def _days(trades: DataFrame, main: Sequence[str], split: Column) -> DataFrame:
    """Sums per (strategy, half, date), the main strategies pooled beside them."""
    half = F.when(F.col("date") < split, "H1").otherwise("H2")
    days = trades.groupBy("strategy", half.alias("half"), "date").agg(F.count("net").alias("n"), F.sum("net").alias("s"), F.count_if(F.col("net") > 0).alias("w"))
    pool = days.filter(F.col("strategy").isin(list(main))).groupBy("half", "date").agg(*[F.sum(c).alias(c) for c in ("n", "s", "w")])
    return days.unionByName(pool.withColumn("strategy", F.lit(POOLED)))


def gate_cells(trades: DataFrame, masks: DataFrame, names: Sequence[str], wanted: Sequence[Combination], main: Sequence[str], split: Column,
               limits: Limits = Limits()) -> DataFrame:
    """One row per (gate, strategy, half): trades, means and wins on and off, difference, clustered t, testable and pass."""
    days = _days(trades, main, split).join(masks, "date")
    squares = {"n": F.sum("n"), "s": F.sum("s"), "w": F.sum("w"), "ss": F.sum(F.col("s") * F.col("s")), "sn": F.sum(F.col("s") * F.col("n")), "nn": F.sum(F.col("n") * F.col("n"))}
    patterns = days.groupBy("strategy", "half", "known", "lit").agg(*[x.alias(c) for c, x in squares.items()])
    cells = _summed(_unfolded(patterns, names, wanted), ["gate", "strategy", "half"], list(squares))
    cells = cells.withColumns({f"mean_{k}": F.try_divide(F.col(f"s_{k}"), F.col(f"n_{k}")) for k in ("on", "off")})
    diff = F.col("mean_on") - F.col("mean_off")
    testable = (F.col("n_on") >= limits.least_side) & (F.col("n_off") >= limits.least_side)
    return cells.select(
        "gate", "strategy", "half", (F.col("n_on") + F.col("n_off")).alias("n_all"), ((F.col("s_on") + F.col("s_off")) / (F.col("n_on") + F.col("n_off"))).alias("mean_all"),
        "n_on", "mean_on", (F.try_divide(F.col("w_on"), F.col("n_on")) * 100).alias("win_on"), "n_off", "mean_off", (F.try_divide(F.col("w_off"), F.col("n_off")) * 100).alias("win_off"),
        diff.alias("diff"), _clustered_t(diff).alias("t_cluster"), testable.cast("int").alias("testable"), holds(testable & (diff > 0)).cast("int").alias("pass"))


def gate_verdicts(trades: DataFrame, masks: DataFrame, names: Sequence[str], wanted: Sequence[Combination], main: Sequence[str], split: Column,
                  limits: Limits = Limits(), cells: DataFrame | None = None) -> DataFrame:
    """One row per gate: time in market, trades judged and dropped, main strategies testable and passing in both halves, promoted,
    usable, robust, and what months mostly on or off and quarters say."""
    cells = gate_cells(trades, masks, names, wanted, main, split, limits) if cells is None else cells
    first = F.col("half") == "H1"
    sessions = masks.groupBy("known", "lit", F.when(F.col("date") < split, "H1").otherwise("H2").alias("half")).agg(F.count("*").alias("d"))
    market = _unfolded(sessions, names, wanted).groupBy("gate").agg(*[
        (F.sum(F.when(where & F.col("on"), F.col("d")).otherwise(F.when(where, 0))) / F.sum(F.when(where, F.col("d"))) * 100).alias(n)
        for n, where in (("on_all", F.lit(True)), ("on_h1", first), ("on_h2", ~first))])
    both = cells.filter(F.col("strategy").isin(list(main))).groupBy("gate", "strategy").agg(
        *[F.coalesce(F.max(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}_{h}") for h in ("H1", "H2") for c in ("testable", "pass")])
    both = both.groupBy("gate").agg(F.count_if((F.col("testable_H1") == 1) & (F.col("testable_H2") == 1)).alias("n_testable"), F.count_if((F.col("pass_H1") == 1) & (F.col("pass_H2") == 1)).alias("n_pass"))
    strong = holds((F.col("diff") >= limits.edge) & (F.col("t_cluster") >= limits.t)).cast("int")
    pooled = cells.filter(F.col("strategy") == POOLED).groupBy("gate").agg(F.sum(strong).alias("strong"))
    known = cells.filter(F.col("strategy") != POOLED).groupBy("gate").agg(F.sum("n_all").alias("n_evaluated"))
    days = _days(trades, main, split).filter(F.col("strategy") == POOLED).join(masks, "date")
    evidence = []
    for unit in ("month", "quarter"):
        patterns = days.groupBy(F.trunc("date", unit).alias("p"), "known", "lit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        evidence.append(_summed(_unfolded(patterns, names, wanted), ["gate", "p"], ["n", "s"]))
    n, mean = F.col("n_on") + F.col("n_off"), (F.col("s_on") + F.col("s_off")) / (F.col("n_on") + F.col("n_off"))
    months = evidence[0].filter(n >= limits.least_month).select("gate", mean.alias("m"), (F.col("n_on") / n >= 0.5).alias("mostly"))
    on, off = F.col("mostly"), ~F.col("mostly")
    months = months.groupBy("gate").agg(
        F.count_if(on).alias("months_on"), F.count_if(off).alias("months_off"), F.avg(F.when(on, F.col("m"))).alias("month_mean_on"), F.avg(F.when(off, F.col("m"))).alias("month_mean_off"),
        (F.avg(F.when(off, (F.col("m") < 0).cast("double"))) * 100).alias("off_negative"), (F.avg(F.when(on, (F.col("m") < 0).cast("double"))) * 100).alias("on_negative"))
    quarters = evidence[1].filter((F.col("n_on") >= limits.least_quarter_side) & (F.col("n_off") >= limits.least_quarter_side))
    quarters = quarters.groupBy("gate").agg(F.count("*").alias("quarters"), F.count_if(F.col("s_on") / F.col("n_on") > F.col("s_off") / F.col("n_off")).alias("quarter_wins"))
    out = market.join(both, "gate", "left").join(pooled, "gate", "left").join(known, "gate", "left").join(months, "gate", "left").join(quarters, "gate", "left")
    out = out.na.fill(0, ["n_testable", "n_pass", "strong", "n_evaluated", "months_on", "months_off", "quarters", "quarter_wins"])
    everything = trades.agg(F.count("net").alias("__n"))  # one row
    out = out.crossJoin(everything).withColumn("n_dropped", F.col("__n") - F.col("n_evaluated")).drop("__n")
    promoted, usable = (F.col("n_testable") == len(main)) & (F.col("n_pass") == len(main)), F.col("on_all") >= limits.least_on_pct
    return out.withColumns({"promoted": promoted.cast("int"), "usable": usable.cast("int"), "robust": (promoted & usable & (F.col("strong") == 2)).cast("int")}).drop("strong")
