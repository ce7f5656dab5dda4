"""The strategy audit: every rule from its state to an account, all rules in the same jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import catalogue
from ..functions.order_stats import quantiles
from ..operators import allocation as al, outcomes as oc, rules as ro, stats
from ..session import cut_lineage

QUIET = 20


def fresh_signals(states: DataFrame, quiet: int = QUIET) -> DataFrame:
    """State rows whose rule was false for ``quiet`` rows before (the start of a key counts as quiet).

    Only true rows are needed: the distance to the previous true row of the same key and rule decides.
    """
    w = Window.partitionBy("rule", "isin").orderBy("r")
    gap = F.col("r") - F.lag("r").over(w)
    return states.withColumn("__g", gap).filter(F.col("__g").isNull() | (F.col("__g") > quiet)).drop("__g")


def family_trades(panel: DataFrame, signals: DataFrame, families: dict[str, oc.Exit]) -> DataFrame:
    """Outcomes of fresh signals under the exit of their rule's family, on one path; watchlist rules do not trade."""
    only = {f: F.col("rule").isin([n for n in names]) for f, names in catalogue.FAMILY.items() if f in families}
    cells = {f: exit for f, exit in families.items() if f in only}
    trades = oc.many_touches(panel, signals, cells, only=only)
    return trades.select("sid", "rule", "isin", "date", "r", "entry", "exit", "exit_r", "bars", "why", "net", "rs_rank", F.col("cell").alias("family"))


def strategy_audit(panel: DataFrame, rules: Sequence[ro.Rule], families: dict[str, oc.Exit] | None = None, slots: int = 10,
                   apply_floors: bool = False) -> DataFrame:
    """One row per rule: signals, trade quality, account growth and drawdown.

    Contaminated rows are dropped before positions are counted, so "next row" skips them.
    """
    if "contaminated" in panel.columns:
        panel = panel.filter(~F.col("contaminated")).drop("r")
    panel = cut_lineage(oc.with_position(panel))
    keep = ["isin", "date", "r", "next_open", "last_r", "atr_pct", "rs_rank"]
    states = ro.hits(panel, rules, keep, apply_floors, emit=False).drop("score", "emit")
    raw = states.groupBy("rule").agg(F.count(F.lit(1)).alias("n_signals_raw"))
    fresh = cut_lineage(fresh_signals(states).withColumn("sid", F.concat_ws("|", "rule", "isin", "r")))
    counts = raw.join(fresh.groupBy("rule").agg(F.count(F.lit(1)).alias("n_signals_fresh")), "rule")
    trades = cut_lineage(oc.with_sessions(family_trades(panel, fresh, families or oc.FAMILIES), panel).withColumn("scenario", F.col("rule")))
    quality = trades.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_trades"), stats.share(F.col("net") > 0).alias("win_pct"), F.avg("net").alias("mean_ret_pct"),
        stats.share(F.col("why") == "stop").alias("stopped_pct"), stats.share(F.col("why") == "time").alias("capped_pct"))
    quality = quality.join(quantiles(trades, ["rule"], "net", {"median_ret_pct": 0.5}), "rule")
    book = al.Book(slots=slots, settle="same")
    queue = al.candidates(trades, book, -F.coalesce(F.col("rs_rank"), F.lit(-1.0)))
    calendar = oc.session_index(panel)
    closes = panel.join(F.broadcast(calendar), "date").select("isin", "session_i", F.col("adj_close").alias("close"))
    queue = cut_lineage(al.with_marks(queue, closes))
    account = al.metrics(al.equity_curve(queue, book)).select(F.col("scenario").alias("rule"), F.col("cagr").alias("cagr_pct"), F.col("maxdd").alias("max_dd_pct"))
    taken = al.taken_trades(queue, book).groupBy(F.col("scenario").alias("rule")).agg(F.count(F.lit(1)).alias("n_signals_taken"))
    return counts.join(quality, "rule").join(account, "rule", "left").join(taken, "rule", "left")
