"""Time the headline queries, one end-to-end run and one on the many-key panel; prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelspark.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "W1_sma", "W2_ema", "W3_rsi", "W7_52week", "W8_prior_extremes", "W11_contraction", "W13_turnover_median", "W22_beta", "L3_period_levels", "L5_width_rank",
    "E4_event_segments", "E10_level_crosses", "A3_hour_bars", "A4_week_bars", "X1_relative_strength", "X2_forward_returns", "X6_breadth", "X16_market_gate", "X12_index_analytics",
    "R3_historical_hits", "R3_all_rules", "T1_bracket", "T2_reversal", "T5_managed_stop_half", "T8_one_open_per_key", "A5_horizon_stats", "A9_trade_stats", "A13_excursion_report",
    "M1_column_upsert", "M5_symbol_history", "J3_point_in_time", "J4_suffix_factor", "Q3_contamination", "K1_equal_slots", "V2_clustered_slope", "V10_filter_search",
    "V14_strategy_audit", "X19_gate_catalogue",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def many_keys(spark) -> tuple[int, float, float]:
    """On the panel of every supplier and day: its rows, seconds for features and all rules, seconds for outcomes and statistics."""
    from panelspark.operators import outcomes as oc, rules as ro, stats
    from panelspark.plans.screen import screen_panel
    from panelspark.registry.cross import index_bars
    from panelspark.registry.outcomes import ALL, BRACKET
    from panelspark.session import cut_lineage
    from panelspark.sources import panels
    bars = cut_lineage(panels.day_panel(spark, SF))
    index = index_bars(spark, SF, panels.stored_week_panel(spark, SF))
    start = time.time()
    panel = cut_lineage(oc.with_position(screen_panel(bars, ALL, index, volatility="AFRICA", benchmark="ASIA", extra=["atr_pct"])))
    found = cut_lineage(ro.hits(panel, ALL, ["isin", "date"], emit=False))
    middle = time.time()
    signals = panel.join(found, ["isin", "date"]).selectExpr("*", "concat_ws('|', rule, isin, r) AS sid")
    run(stats.bracket_stats(oc.first_touch(panel, signals, BRACKET), ["rule"]))
    return bars.count(), round(middle - start, 3), round(time.time() - middle, 3)


def end_to_end(spark) -> None:
    """Panel, every feature, all rules, outcomes of the hits and their statistics."""
    from panelspark.operators import outcomes as oc, rules as ro, stats
    from panelspark.registry.outcomes import ALL, BRACKET, _panel
    from panelspark.session import cut_lineage
    panel = cut_lineage(oc.with_position(_panel(spark, SF, ALL, extra=["atr_pct"])))
    found = ro.hits(panel, ALL, ["isin", "date"], emit=False)
    signals = panel.join(found, ["isin", "date"]).selectExpr("*", "concat_ws('|', rule, isin, r) AS sid")
    run(stats.bracket_stats(oc.first_touch(panel, signals, BRACKET), ["rule"]))


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    from panelspark.registry import QUERIES
    run(QUERIES["A1_counts_by_date"](spark, SF))  # start the executors and the code cache
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, SF))
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    start = time.time()
    end_to_end(spark)
    took["end_to_end"] = round(time.time() - start, 3)
    many_rows, took["many_keys_features_rules"], took["many_keys_outcomes"] = many_keys(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "many_keys_rows": many_rows}))
    spark.stop()


if __name__ == "__main__":
    main()
