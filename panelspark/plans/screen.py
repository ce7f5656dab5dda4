"""The daily screen and the historical study as one lazy plan: panel -> features -> ranks -> market -> rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.core import holds
from ..operators import cross, market, quality, rules as rule_ops
from ..operators.features import build_features

MARKET_COLUMNS = ["mkt_vix", "mkt_vix_pctile_1y", "mkt_nifty_range_20d", "mkt_breadth_50", "mkt_gate_on"]


def fresh_expressions(rules: Sequence[rule_ops.Rule]) -> dict[str, str]:
    """Expressions behind the ``fresh_*`` columns the given rules read."""
    known = {r.name: r.expr for r in rule_ops.load_rules()}
    read = set().union(*[r.columns for r in rules]) if rules else set()
    return {n: e for n, e in known.items() if f"fresh_{n}" in read}


def screen_panel(bars: DataFrame, rules: Sequence[rule_ops.Rule], index_bars: DataFrame | None = None,
                 actions: DataFrame | None = None, jump_pct: float | None = None, extra: Iterable[str] = (),
                 volatility: str = "India VIX", benchmark: str = "Nifty 50") -> DataFrame:
    """Everything the rules read, one row per (isin, date).

    One exchange on the key (features, contamination, fresh flags), the cross-section ranks, and one
    broadcast of the date-level market table.
    """
    fresh = fresh_expressions(rules)
    read = set(extra).union(*[r.columns for r in rules], *[r.columns for r in [rule_ops.Rule("x", e) for e in fresh.values()]])
    outside = {"rs_rank", "rs_score", "bars_available", "contaminated", *MARKET_COLUMNS, *[f"fresh_{n}" for n in fresh]}
    wanted = sorted((read - outside - set(bars.columns)) | {"turnover_median_20d"})
    ranked = bool(read & {"rs_rank", "rs_score"})
    gated = bool(read & set(MARKET_COLUMNS))
    if ranked:
        wanted = sorted(set(wanted) | set(cross.RS_WEIGHTS))
    panel = build_features(bars, wanted)
    if jump_pct is not None:
        panel = quality.with_contamination(panel, actions, jump_pct)
    if fresh:  # none of them reads another fresh flag, so all share one stage
        panel = market.add_fresh_flags(panel, fresh)
    if ranked:
        panel = cross.add_relative_strength(panel)
    if gated:
        day = market.advance_decline(build_features(bars, ["sma_50"]))
        state = market.gate_series(day).select("date", "mkt_breadth_50", "mkt_gate_on")
        if index_bars is not None:
            state = state.join(market.index_columns(index_bars, volatility, benchmark), "date", "full")
        panel = market.attach_market(panel, state)
    return panel


def latest_screen(panel: DataFrame, rules: Sequence[rule_ops.Rule]) -> DataFrame:
    return rule_ops.latest_hits(panel, rules)


def historical_hits(panel: DataFrame, rules: Sequence[rule_ops.Rule], keep: Sequence[str] = ("isin", "date"),
                    apply_floors: bool = True) -> DataFrame:
    return rule_ops.hits(panel, rules, keep, apply_floors)


def listing_columns(panel: DataFrame) -> DataFrame:
    """``new_listing`` marks keys with fewer than 60 bars in total."""
    total = panel.groupBy("isin").agg(F.count(F.lit(1)).alias("__n"))
    return panel.join(total, "isin").withColumn("new_listing", holds(F.col("__n") < 60).cast("int")).drop("__n")
