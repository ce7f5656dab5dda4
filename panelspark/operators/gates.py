"""The gate catalogue: market-state conditions as data, evaluated in one pass over the date table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.core import pct, ratio
from ..functions.windows import CALENDAR as D

# Gate -> (column, direction, threshold). "q50" is the 50th percentile of the first half.
GATES: dict[str, tuple[str, str, float | str]] = {
    "faber_10m_sma": ("nifty_gt_10m_sma", ">", 0.5),
    "nifty_above_200dma": ("nifty_above_200dma", ">", 0.5),
    "nifty_above_50dma": ("nifty_above_50dma", ">", 0.5),
    "nifty_above_20dma": ("nifty_above_20dma", ">", 0.5),
    "nifty_20dma_rising": ("nifty_20dma_slope", ">", 0.0),
    "golden_cross": ("nifty_sma50_gt_sma200", ">", 0.5),
    "abs_mom_12m": ("nifty_ret_252", ">", 0.0),
    "abs_mom_6m": ("nifty_ret_126", ">", 0.0),
    "not_deep_drawdown": ("nifty_dd_252", ">", -10.0),
    "midcap_10m_sma": ("mid_gt_10m_sma", ">", 0.5),
    "midcap_above_50dma": ("midcap_above_50dma", ">", 0.5),
    "risk_appetite_mid": ("mid_vs_nifty_20d", ">", 0.0),
    "vix_below_20dma": ("vix_vs_20dma", "<", 0.0),
    "vix_below_10dma": ("vix_vs_10dma", "<", 0.0),
    "vix_below_50dma": ("vix_vs_50dma", "<", 0.0),
    "vix_below_15": ("vix", "<", 15.0),
    "vix_pctile_below_50": ("vix_pctile_1y", "<", 50.0),
    "vix_falling_10d": ("vix_roc_10d", "<", 0.0),
    "vix_falling_5d": ("vix_chg_5d", "<", 0.0),
    "vix_z60_low": ("vix_z_60", "<", "q50"),
    "no_vix_spike": ("vix_spike", "<", 0.5),
    "vrp_high": ("vrp", ">", "q50"),
    "rvol20_not_high": ("nifty_rvol_20", "<", "q75"),
    "rvol60_not_high": ("nifty_rvol_60", "<", "q75"),
    "range20_low": ("nifty_range_20d", "<", "q50"),
    "breadth50_gt_50": ("p_b50", ">", 50.0),
    "breadth200_gt_50": ("p_b200", ">", 50.0),
    "breadth50_rising": ("p_b50_up", ">", 0.5),
    "breadth50_sma20_gt_50": ("p_b50_sma20", ">", 50.0),
    "breadth50_hysteresis": ("p_b50_hyst", ">", 0.5),
    "breadth50_sustained": ("p_b50_sustained_on", ">", 0.5),
    "nhnl20_positive": ("p_nhnl_20", ">", 0.0),
    "zweig_ema_gt_50": ("p_zweig_ema", ">", 0.5),
    "zweig_thrust_window": ("p_zweig_thrust_on", ">", 0.5),
    "mcclellan_osc_pos": ("p_mcc_osc", ">", 0.0),
    "mcclellan_sum_rising": ("p_mcc_sum_rising", ">", 0.5),
    "ad_line_gt_sma50": ("p_ad_gt_sma", ">", 0.5),
    "nhnl_positive": ("p_nhnl_10", ">", 0.0),
    "pct_pos_20d_gt_50": ("p_pos20", ">", 50.0),
    "ew_above_sma50": ("p_ew_gt_sma50", ">", 0.5),
    "ew_above_sma200": ("p_ew_gt_sma200", ">", 0.5),
    "dispersion_low": ("p_disp_20", "<", "q50"),
    "no_bear_rebound": ("bear_rebound", "<", 0.5),
    "not_expiry_week": ("expiry_week", "<", 0.5),
    "turn_of_month_only": ("turn_of_month", ">", 0.5),
    "not_earnings_season": ("earnings_season", "<", 0.5),
}


def index_state(main: DataFrame, mid: DataFrame, vix: DataFrame) -> DataFrame:
    """Index, mid-size index and volatility columns per date (each input: date, close, high, low)."""
    x = F.col("close")
    rets = main.withColumn("__r", ratio(x, D.lag(x)) - 1)
    m = rets.select(
        "date", *[pct(x, D.lag(x, n)).alias(f"nifty_ret_{n}") for n in (126, 252)], pct(x, D.highest(x, 252)).alias("nifty_dd_252"),
        pct(x, D.lag(x, 20)).alias("nifty_ret_20d"), *[(x > D.mean(x, n)).cast("int").alias(f"nifty_above_{n}dma") for n in (20, 50, 200)],
        (D.mean(x, 50) > D.mean(x, 200)).cast("int").alias("nifty_sma50_gt_sma200"),
        *[(D.std(F.col("__r"), n) * 252 ** 0.5 * 100).alias(f"nifty_rvol_{n}") for n in (20, 60)],
        pct(D.highest(F.col("high"), 20), D.lowest(F.col("low"), 20)).alias("nifty_range_20d"), D.mean(x, 20).alias("__m20"))
    m = m.withColumn("nifty_20dma_slope", pct(F.col("__m20"), D.lag(F.col("__m20"), 10))).drop("__m20")
    c = mid.select("date", (x > D.mean(x, 50)).cast("int").alias("midcap_above_50dma"), pct(x, D.lag(x, 20)).alias("__mid20"))
    v = vix.select("date", x.alias("vix"), *[pct(x, D.mean(x, n)).alias(f"vix_vs_{n}dma") for n in (10, 20, 50)],
                   pct(x, D.lag(x, 10)).alias("vix_roc_10d"), pct(x, D.lag(x, 5)).alias("vix_chg_5d"),
                   ratio(x - D.mean(x, 60), D.std(x, 60)).alias("vix_z_60"), (x > D.mean(x, 10) * 1.2).cast("int").alias("vix_spike"),
                   D.rank_in_window(x, 252).alias("vix_pctile_1y"))
    out = m.join(c, "date", "left").join(v, "date", "left")
    rebound = F.when(F.col("nifty_dd_252").isNotNull(), ((F.col("nifty_dd_252") <= -10) & (F.col("nifty_ret_20d") >= 5)).cast("int"))
    return out.withColumns({"mid_vs_nifty_20d": F.col("__mid20") - F.col("nifty_ret_20d"), "vrp": F.col("vix") - F.col("nifty_rvol_20"),
                            "bear_rebound": rebound}).drop("__mid20")


def breadth_state(day: DataFrame) -> DataFrame:
    """Breadth columns of the gate catalogue from a breadth series that went through the market operators."""
    known = F.sum(F.col("ew_ret_1d").isNotNull().cast("int")).over(D.so_far())
    day = day.withColumns({"__known": known, "__ew": F.exp("ew_log")})
    return day.select(
        "date", F.col("b50").alias("p_b50"), F.col("b200").alias("p_b200"), F.col("pct_pos_20d").alias("p_pos20"),
        (F.col("b50") > D.lag(F.col("b50"), 10)).cast("int").alias("p_b50_up"), D.mean(F.col("b50"), 20, 15).alias("p_b50_sma20"),
        F.col("hysteresis").alias("p_b50_hyst"), F.col("b50_sustained_on").alias("p_b50_sustained_on"), F.col("nhnl_20").alias("p_nhnl_20"),
        F.col("nhnl_10").alias("p_nhnl_10"), F.col("zweig_ema").alias("p_zweig_ema"), F.col("thrust_on").alias("p_zweig_thrust_on"),
        F.col("mcc_osc").alias("p_mcc_osc"), F.col("mcc_sum_rising").alias("p_mcc_sum_rising"),
        (F.col("ad_line") > F.col("ad_line_sma50")).cast("int").alias("p_ad_gt_sma"), D.mean(F.col("dispersion"), 20).alias("p_disp_20"),
        *[F.when(F.col("__known") >= n, (F.col("__ew") > D.mean(F.col("__ew"), n)).cast("int")).alias(f"p_ew_gt_sma{n}") for n in (50, 200)])


def gate_table(state: DataFrame, first_half, gates: dict | None = None) -> DataFrame:
    """(gate, date, on): 1, 0 or null where the signal is undefined; absent columns leave their gates out.

    Percentile thresholds come from the first-half sessions of the date table (one row per session).
    """
    gates = {g: spec for g, spec in (gates or GATES).items() if spec[0] in state.columns}
    quantile = {f"__t_{g}": (c, float(t[1:]) / 100) for g, (c, _, t) in gates.items() if isinstance(t, str)}
    if quantile:
        levels = state.filter(first_half).agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in quantile.items()])
        state = state.crossJoin(F.broadcast(levels))
    cells = []
    for g, (c, op, t) in gates.items():
        level = F.col(f"__t_{g}") if isinstance(t, str) else F.lit(float(t))
        on = (F.col(c) > level) if op == ">" else (F.col(c) < level)
        cells.append(F.struct(F.lit(g).alias("gate"), on.cast("int").alias("on")))
    return state.select("date", F.explode(F.array(*cells)).alias("g")).select("g.gate", "date", "g.on")
