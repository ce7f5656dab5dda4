"""The rule catalogue: screening rules held as data."""

from __future__ import annotations

# Rule names, expressions, emitted columns, ordering and history floors.
RULES: list[dict] = [
    {"name": "minervini_trend_template",
     "expr": "adj_close > sma_50 and adj_close > sma_150 and adj_close > sma_200 and sma_50 > sma_150 and "
             "sma_150 > sma_200 and sma_200_slope > 0 and pct_from_52w_low > 30 and pct_from_52w_high > "
             "-25 and rs_rank >= 70",
     "emit": ["adj_close", "rs_rank", "pct_from_52w_high", "pct_from_52w_low", "sma_200_slope", "ret_60d"],
     "sort_by": "rs_rank"},
    {"name": "vcp_squeeze",
     "expr": "adj_close > sma_50 and sma_50 > sma_200 and sma_200_slope > 0 and contract_seq == 1 and "
             "contract_ratio < 0.7 and tightness < 8 and vol_dryup < 0.9 and base_depth > -12 and rs_rank "
             ">= 60",
     "emit": ["adj_close", "contract_a", "contract_b", "contract_c", "contract_ratio", "vol_dryup", "base_depth", "rs_rank"],
     "sort_by": "contract_ratio", "ascending": True, "min_history": 60},
    {"name": "ema21_pullback",
     "expr": "adj_close > sma_50 and sma_50 > sma_200 and sma_200_slope > 0 and dist_ema_21 > -4 and "
             "dist_ema_21 < 1.5 and ext_ema21_15 >= 5 and off_high_10 < -2 and rsi_14 > 40 and rsi_14 < 62 "
             "and ret_60d > 8",
     "emit": ["adj_close", "dist_ema_21", "ext_ema21_15", "off_high_10", "rsi_14", "ret_20d", "rs_rank"],
     "sort_by": "rs_rank"},
    {"name": "high_tight_breakout",
     "expr": "adj_close > hi_250_prior and vol_ratio > 1.5 and ret_1d > 1 and adj_close > sma_50 and "
             "rs_rank >= 60",
     "emit": ["adj_close", "pct_from_52w_high", "vol_ratio", "ret_1d", "rs_rank", "high_52w"],
     "sort_by": "vol_ratio"},
    {"name": "inside_bar_coil",
     "expr": "inside_bar == 1 and adj_close > sma_20 and sma_20 > sma_50 and sma_50 > sma_200 and atr_pct "
             "< 5 and rs_rank >= 50",
     "emit": ["adj_close", "atr_pct", "rsi_14", "ret_20d", "rs_rank"],
     "sort_by": "rs_rank", "min_history": 60},
    {"name": "close_above_monthly_tc",
     "expr": "adj_close > m_cpr_tc and adj_close > sma_50",
     "emit": ["adj_close", "m_cpr_tc", "m_cpr_bc", "m_cpr_width", "rsi_14"],
     "sort_by": "ret_20d"},
    {"name": "narrow_cpr_breakout",
     "expr": "m_cpr_width < 2.0 and m_cpr_width_rank < 0.34 and adj_close > m_cpr_tc and "
             "since_m_cpr_tc_cross <= 5 and adj_close > sma_200",
     "emit": ["adj_close", "m_cpr_tc", "m_cpr_width", "m_cpr_width_rank", "since_m_cpr_tc_cross", "ret_20d", "vol_ratio"],
     "sort_by": "m_cpr_width", "ascending": True},
    {"name": "weekly_tc_reclaim",
     "expr": "adj_close > w_cpr_tc and since_w_cpr_tc_cross <= 3 and adj_close > sma_20 and ret_5d > 0",
     "emit": ["adj_close", "w_cpr_tc", "w_cpr_width", "since_w_cpr_tc_cross", "ret_5d", "rsi_14"],
     "sort_by": "ret_5d"},
    {"name": "volume_shocker",
     "expr": "vol_ratio > 3 and ret_1d > 2 and adj_close > sma_20",
     "emit": ["adj_close", "vol_ratio", "volume", "vol_sma_20", "ret_1d", "turnover_median_20d"],
     "sort_by": "vol_ratio", "min_history": 60},
    {"name": "momentum_leaders",
     "expr": "mom_12_1 > 15 and ret_60d > 12 and ret_120d > 15 and adj_close > sma_50 and sma_50 > sma_200",
     "emit": ["adj_close", "mom_12_1", "ret_60d", "ret_120d", "rsi_14", "pct_from_52w_high"],
     "sort_by": "ret_60d"},
    {"name": "oversold_in_uptrend",
     "expr": "rsi_14 < 35 and adj_close > sma_200 and ret_120d > 0",
     "emit": ["adj_close", "rsi_14", "sma_200", "ret_20d", "pct_from_52w_high"],
     "sort_by": "rsi_14", "ascending": True},
    {"name": "trend_stack",
     "expr": "adj_close > sma_20 and sma_20 > sma_50 and sma_50 > sma_200 and rsi_14 < 70",
     "emit": ["adj_close", "sma_20", "sma_50", "sma_200", "rsi_14", "ret_60d"],
     "sort_by": "ret_60d"},
    {"name": "monthly_r1_breakout",
     "expr": "adj_close > m_r1 and since_m_r1_cross <= 3 and vol_ratio > 1.3 and adj_close > sma_50 and "
             "sma_50 > sma_200",
     "emit": ["adj_close", "m_r1", "m_r2", "dist_m_r1", "since_m_r1_cross", "vol_ratio", "ret_5d"],
     "sort_by": "since_m_r1_cross", "ascending": True, "min_history": 60},
    {"name": "monthly_r1_retest",
     "expr": "dist_m_r1 > 0 and low3_dist_m_r1 < 1.0 and low3_dist_m_r1 > -2.5 and since_m_r1_cross >= 2 "
             "and since_m_r1_cross <= 15 and adj_close > sma_50 and sma_50 > sma_200",
     "emit": ["adj_close", "m_r1", "dist_m_r1", "low3_dist_m_r1", "since_m_r1_cross", "rsi_14", "ret_5d"],
     "sort_by": "dist_m_r1", "ascending": True, "min_history": 60},
    {"name": "pocket_pivot",
     "expr": "pocket_pivot == 1 and adj_close > sma_50 and sma_50 > sma_200 and sma_200_slope > 0 and "
             "base_depth > -15 and dist_sma_10 < 5 and dist_sma_10 > -5 and rs_rank >= 50",
     "emit": ["adj_close", "volume", "down_vol_max_10", "base_depth", "dist_sma_10", "rs_rank"],
     "sort_by": "rs_rank", "min_history": 60},
    {"name": "donchian_breakout",
     "expr": "adj_close > hi_20_prior and adj_close > sma_50 and sma_50 > sma_200 and vol_ratio > 1.2 and "
             "atr_pct > 1.5 and rs_rank >= 50",
     "emit": ["adj_close", "hi_20_prior", "vol_ratio", "atr_pct", "ret_20d", "rs_rank"],
     "sort_by": "rs_rank", "min_history": 60},
    {"name": "three_weeks_tight",
     "expr": "tight_3w_pct < 1.5 and adj_close > sma_50 and sma_50 > sma_200 and sma_200_slope > 0 and "
             "pct_from_52w_high > -15 and rs_rank >= 60",
     "emit": ["adj_close", "tight_3w_pct", "pct_from_52w_high", "vol_dryup", "ret_60d", "rs_rank"],
     "sort_by": "tight_3w_pct", "ascending": True, "min_history": 60},
    {"name": "stage2_base_breakout",
     "expr": "adj_close > hi_60_prior and adj_close > sma_150 and sma_150_slope > 0 and adj_close > "
             "sma_200 and vol_ratio > 1.5 and rs_rank >= 60",
     "emit": ["adj_close", "hi_60_prior", "vol_ratio", "sma_150_slope", "ret_120d", "rs_rank"],
     "sort_by": "vol_ratio", "min_history": 90},
    {"name": "episodic_pivot",
     "expr": "gap_pct > 4 and vol_ratio > 4 and close_pos > 0.6 and adj_close > sma_50",
     "emit": ["adj_close", "gap_pct", "vol_ratio", "close_pos", "ret_1d", "turnover_median_20d"],
     "sort_by": "gap_pct", "min_history": 60},
    {"name": "rsi2_reversion",
     "expr": "rsi_2 < 8 and adj_close > sma_200 and adj_close > sma_50 and sma_200_slope > 0 and ret_120d "
             "> 0",
     "emit": ["adj_close", "rsi_2", "rsi_14", "dist_sma_50", "ret_120d", "pct_from_52w_high"],
     "sort_by": "rsi_2", "ascending": True, "min_history": 200},
    {"name": "r1_breakout_retest",
     "expr": "since_r1_vol_breakout >= 2 and since_r1_vol_breakout <= 15 and adj_close > m_r1 and "
             "adj_close > ema_9 and ( (low3_dist_m_r1 < 1.0 and low3_dist_m_r1 > -2.5) or (low3_dist_ema_9 "
             "< 1.0 and low3_dist_ema_9 > -2.5) ) and sma_50 > sma_200",
     "emit": ["adj_close", "m_r1", "dist_m_r1", "low3_dist_m_r1", "low3_dist_ema_9", "since_r1_vol_breakout", "vol_vs_ema21", "rsi_14"],
     "sort_by": "since_r1_vol_breakout", "ascending": True, "min_history": 60},
    {"name": "spring_reclaim",
     "expr": "since_spring <= 3 and adj_close > lo_20_prior and atr_to_spring >= 1.5 and adj_close > "
             "sma_200 and sma_200_slope > 0 and ud_vol_20 > 1.0 and rs_rank >= 45",
     "emit": ["adj_close", "spring_low", "dist_spring_low", "atr_to_spring", "since_spring", "ud_vol_20", "close_pos", "rs_rank"],
     "sort_by": "since_spring", "ascending": True, "min_history": 200},
    {"name": "held_breakout",
     "expr": "since_brk_60 >= 3 and since_brk_60 <= 15 and brk_cushion > 0 and closes_above_brk >= 3 and "
             "brk_vol > 1.0 and adj_close > brk_level and sma_50 > sma_200 and rs_rank >= 55",
     "emit": ["adj_close", "brk_level", "brk_cushion", "closes_above_brk", "since_brk_60", "brk_vol", "rs_rank"],
     "sort_by": "brk_cushion", "min_history": 90},
    {"name": "accumulation_thrust",
     "expr": "ud_vol_20 > 1.5 and close_pos_3 > 0.55 and adj_close > sma_50 and sma_50 > sma_200 and "
             "sma_200_slope > 0 and base_depth > -10 and atr_ratio_60 < 1.0 and rs_rank >= 60",
     "emit": ["adj_close", "ud_vol_20", "close_pos_3", "base_depth", "atr_ratio_60", "rs_rank"],
     "sort_by": "ud_vol_20", "min_history": 200},
    {"name": "near_52w_high",
     "expr": "pct_from_52w_high > -12 and adj_close > sma_50 and sma_50 > sma_200 and sma_200_slope > 0 "
             "and rs_rank >= 80",
     "emit": ["adj_close", "pct_from_52w_high", "high_52w", "ret_250d", "mom_12_1", "rs_rank"],
     "sort_by": "pct_from_52w_high", "min_history": 250},
    {"name": "base_breakout_r1",
     "expr": "base_range_60 < 25 and pct_from_52w_low < 45 and adj_close > m_r1 and since_r1_vol_breakout "
             "<= 5 and adj_close > sma_50 and sma_200_slope > -3",
     "emit": ["adj_close", "m_r1", "base_range_60", "pct_from_52w_low", "since_r1_vol_breakout", "vol_vs_ema21", "sma_200_slope"],
     "sort_by": "base_range_60", "ascending": True, "min_history": 250},
    {"name": "stage2_portfolio",
     "expr": "adj_close > hi_60_prior and adj_close > sma_150 and sma_150_slope > 0 and adj_close > "
             "sma_200 and vol_ratio > 1.5 and rs_rank >= 60 and gap_pct <= 2 and base_depth > -10",
     "emit": ["adj_close", "hi_60_prior", "vol_ratio", "gap_pct", "base_depth", "sma_150_slope", "rs_rank"],
     "sort_by": "vol_ratio", "min_history": 200},
    {"name": "double_seven",
     "expr": "new_lo7 == 1 and adj_close > sma_200",
     "emit": ["adj_close", "lo7_prior", "hi7_prior", "sma_200", "rsi_2", "rsi_14", "ret_5d"],
     "sort_by": "rsi_2", "ascending": True, "min_history": 200},
    {"name": "leader_dip",
     "expr": "rs_rank >= 80 and adj_close > sma_200 and (new_lo7 == 1 or rsi_2 < 10)",
     "emit": ["adj_close", "rs_rank", "rsi_2", "lo7_prior", "hi7_prior", "dist_sma_10", "dist_sma_50", "sma_150_slope", "sma_200"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "leader_dip_playbook",
     "expr": "rs_rank >= 80 and adj_close > sma_200 and (new_lo7 == 1 or rsi_2 < 10) and dist_ema_21 >= "
             "2.6",
     "emit": ["adj_close", "rs_rank", "dist_ema_21", "dist_sma_50", "rsi_2", "rsi_14", "atr_pct", "stop_3atr", "hi7_prior", "sma_200"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "trend_stack_swing",
     "expr": "fresh_trend_stack == 1 and mkt_vix_pctile_1y >= 63.7 and mkt_nifty_range_20d >= 6.855",
     "emit": ["adj_close", "rs_rank", "ema_50", "dist_sma_50", "atr_pct", "stop_3atr", "mkt_vix_pctile_1y", "mkt_nifty_range_20d", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "momentum_swing",
     "expr": "fresh_momentum_leaders == 1 and pct_from_52w_high >= -9.94 and mkt_vix_pctile_1y >= 59.9 and "
             "mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "mom_12_1", "pct_from_52w_high", "atr_pct", "stop_4atr", "tgt_3r_4atr", "mkt_vix_pctile_1y", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 250},
    {"name": "sw_leader_dip_concentrated",
     "expr": "rs_rank >= 80 and adj_close > sma_200 and new_lo7 == 1 and rsi_2 < 10 and dist_ema_21 >= 2.6 "
             "and mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "dist_ema_21", "dist_sma_50", "rsi_2", "atr_pct", "stop_3atr", "hi7_prior", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "sw_rsi2_snapback",
     "expr": "rsi_2 < 8 and adj_close > sma_200 and adj_close > sma_50 and sma_200_slope > 0 and ret_120d "
             "> 0 and dist_sma_50 >= 8.7 and mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "rsi_2", "dist_sma_50", "dist_ema_21", "atr_pct", "stop_4atr", "hi7_prior", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "sw_double_seven",
     "expr": "new_lo7 == 1 and adj_close > sma_200 and dist_ema_21 >= 1.0 and atr_pct >= 5.3 and "
             "mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "dist_ema_21", "atr_pct", "stop_3atr", "lo7_prior", "hi7_prior", "rsi_2", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "sw_monthly_r1_retest",
     "expr": "dist_m_r1 > 0 and dist_m_r1 < 3.0 and low3_dist_m_r1 < 1.0 and low3_dist_m_r1 > -2.5 and "
             "since_m_r1_cross >= 2 and since_m_r1_cross <= 15 and dist_sma_200 >= 33 and atr_pct >= 4.3 "
             "and mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "m_r1", "dist_m_r1", "low3_dist_m_r1", "dist_sma_200", "atr_pct", "stop_3atr", "hi7_prior", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "vl_volume_spike_breakout",
     "expr": "vol_ratio >= 5 and adj_close > close_hi_20 and close_pos >= 0.7 and rs_rank >= 60 and "
             "adj_close > sma_200 and ema_21 > ema_50 and mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "vol_ratio", "close_pos", "dist_ema_21", "atr_pct", "stop_3atr", "close_hi_20", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 250},
    {"name": "vl_long_base_breakout",
     "expr": "adj_close > close_hi_500 and vol_ratio >= 2 and adj_close > sma_200 and mkt_gate_on == 1 and "
             "bars_available >= 500",
     "emit": ["adj_close", "rs_rank", "vol_ratio", "close_hi_500", "atr_pct", "stop_3atr", "sma_200", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 500},
    {"name": "vl_wyckoff_spring",
     "expr": "spring == 1 and adj_close > sma_200 and vol_ratio >= 2 and mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "spring_low", "vol_ratio", "dist_spring_low", "atr_pct", "stop_3atr", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "vl_pocket_pivot",
     "expr": "pocket_pivot == 1 and adj_close > sma_50 and adj_close > sma_200 and dist_ema_21 <= 15 and "
             "mkt_gate_on == 1",
     "emit": ["adj_close", "rs_rank", "dist_sma_10", "dist_ema_21", "atr_pct", "stop_3atr", "down_vol_max_10", "mkt_gate_on"],
     "sort_by": "rs_rank", "ascending": False, "min_history": 200},
    {"name": "smooth_momentum",
     "expr": "mom_12_1 > 15 and ret_60d > 12 and ret_120d > 15 and adj_close > sma_50 and sma_50 > sma_200 "
             "and smooth_60 >= 55",
     "emit": ["adj_close", "mom_12_1", "smooth_60", "ret_60d", "ret_120d", "rs_rank"],
     "sort_by": "mom_12_1", "min_history": 250},
]

# Exit family of each rule in the audit.
FAMILY: dict[str, list[str]] = {
    "mean_reversion": [
        "sw_rsi2_snapback", "sw_double_seven", "sw_leader_dip_concentrated", "sw_monthly_r1_retest", "leader_dip_playbook",
        "rsi2_reversion", "oversold_in_uptrend", "double_seven", "leader_dip", "spring_reclaim", "vl_wyckoff_spring"],
    "trend_continuation": [
        "momentum_leaders", "trend_stack", "trend_stack_swing", "momentum_swing", "near_52w_high", "donchian_breakout",
        "stage2_base_breakout", "high_tight_breakout", "minervini_trend_template", "ema21_pullback",
        "vl_volume_spike_breakout", "vl_long_base_breakout", "vl_pocket_pivot", "pocket_pivot", "held_breakout",
        "three_weeks_tight", "stage2_portfolio", "smooth_momentum", "r1_breakout_retest", "base_breakout_r1",
        "monthly_r1_breakout", "monthly_r1_retest", "vcp_squeeze", "episodic_pivot", "volume_shocker"],
    "watchlist": [
        "close_above_monthly_tc", "weekly_tc_reclaim", "inside_bar_coil", "narrow_cpr_breakout", "accumulation_thrust"],
}
