"""Per-key window, recursion, event and level queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import events as ev
from ..functions.core import holds, pct, ratio
from ..functions.windows import PANEL as S
from ..operators.features import build_features
from ..sources import bars as bar_io, panels
from .base import BARS, DAYS, MINUTES, W, register, roll

KEY = "isin:s date:d "


def features(spark, sf_dir, *wanted):
    return build_features(panels.week_panel(spark, sf_dir), wanted or None)


def feature_query(name: str, columns: str, sql: str) -> None:
    """A selection of the feature panel; ``sql`` is the select list over ``bars`` or a full ``WITH``."""
    wanted = [c.split(":")[0] for c in columns.split()]
    if "@@" not in sql:
        sql = f"WITH {BARS} @@ SELECT isin, date, {sql} FROM bars"
    register(name, KEY + columns, lambda s, d: features(s, d, *wanted), sql)


def pct_sql(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0) - 1) * 100"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


SMA = {n: roll("avg", "adj_close", n) for n in (10, 20, 50, 150, 200)}

feature_query("W1_sma", "sma_10:f4 sma_20:f4 sma_50:f4 sma_150:f4 sma_200:f4",
              ", ".join(f"{x} AS sma_{n}" for n, x in SMA.items()))

# Recursions: the SQL twin walks one row at a time.
RECURSION = f"""WITH RECURSIVE {BARS},
diffs AS MATERIALIZED (SELECT isin, date, r, adj_close AS x, CAST(volume AS DOUBLE) AS v,
  adj_close - lag(adj_close) OVER ({W}) AS d,
  greatest(adj_high - adj_low, abs(adj_high - lag(adj_close) OVER ({W})), abs(adj_low - lag(adj_close) OVER ({W}))) AS tr
  FROM bars),
walk AS (
  SELECT isin, date, r, x AS e9, x AS e21, x AS e50, x AS e200, v AS vema, tr AS atr,
         CAST(NULL AS DOUBLE) AS g14, CAST(NULL AS DOUBLE) AS l14, CAST(NULL AS DOUBLE) AS g2, CAST(NULL AS DOUBLE) AS l2
  FROM diffs WHERE r = 1
  UNION ALL
  SELECT n.isin, n.date, n.r, w.e9 * (1 - 2.0/10) + n.x * 2.0/10, w.e21 * (1 - 2.0/22) + n.x * 2.0/22,
         w.e50 * (1 - 2.0/51) + n.x * 2.0/51, w.e200 * (1 - 2.0/201) + n.x * 2.0/201,
         w.vema * (1 - 2.0/22) + n.v * 2.0/22, w.atr * (13.0/14) + n.tr / 14.0,
         CASE WHEN n.r = 2 THEN greatest(n.d, 0) ELSE w.g14 * (13.0/14) + greatest(n.d, 0) / 14.0 END,
         CASE WHEN n.r = 2 THEN greatest(-n.d, 0) ELSE w.l14 * (13.0/14) + greatest(-n.d, 0) / 14.0 END,
         CASE WHEN n.r = 2 THEN greatest(n.d, 0) ELSE w.g2 * 0.5 + greatest(n.d, 0) * 0.5 END,
         CASE WHEN n.r = 2 THEN greatest(-n.d, 0) ELSE w.l2 * 0.5 + greatest(-n.d, 0) * 0.5 END
  FROM walk w JOIN diffs n ON n.isin = w.isin AND n.r = w.r + 1)
"""


def _rsi(n: int) -> str:
    return (f"CASE WHEN r <= {n} THEN NULL WHEN l{n} = 0 AND g{n} > 0 THEN 100.0 WHEN l{n} = 0 THEN 50.0 "
            f"ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi_{n}")


feature_query("W2_ema", "ema_9:f4 ema_21:f4 ema_50:f4 ema_200:f4 vol_ema_21:f4",
              RECURSION + "@@ SELECT isin, date, " + ", ".join(
                  f"CASE WHEN r >= {n} THEN e{n} END AS ema_{n}" for n in (9, 21, 50, 200))
              + ", CASE WHEN r >= 21 THEN vema END AS vol_ema_21 FROM walk")
feature_query("W3_rsi", "rsi_14:f4 rsi_2:f4", RECURSION + f"@@ SELECT isin, date, {_rsi(14)}, {_rsi(2)} FROM walk")
feature_query("W4_atr", "atr_14:f4 atr_pct:f4",
              RECURSION + "@@ SELECT w.isin, w.date, CASE WHEN w.r > 14 THEN atr END AS atr_14, "
              "CASE WHEN w.r > 14 THEN atr / adj_close * 100 END AS atr_pct "
              "FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r")
feature_query("P4_atr_prices", "stop_3atr:f4 stop_4atr:f4 tgt_3r_4atr:f4",
              RECURSION + "@@ SELECT w.isin, w.date, " + ", ".join(
                  f"CASE WHEN w.r > 14 THEN adj_close * (1 {s} {k} * (atr / adj_close * 100) / 100) END AS {n}"
                  for n, s, k in (("stop_3atr", "-", 3), ("stop_4atr", "-", 4), ("tgt_3r_4atr", "+", 12)))
              + " FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r")

feature_query("W5_bollinger", "bb_mid:f4 bb_upper:f4 bb_lower:f4 bb_bandwidth:f4 bb_pct_b:f4",
              f"WITH {BARS}, t AS (SELECT *, {SMA[20]} AS m, {roll('stddev_pop', 'adj_close', 20)} AS sd FROM bars) "
              "@@ SELECT isin, date, m AS bb_mid, m + 2 * sd AS bb_upper, m - 2 * sd AS bb_lower, "
              "((m + 2 * sd) - (m - 2 * sd)) / m * 100 AS bb_bandwidth, "
              "(adj_close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) AS bb_pct_b FROM t")
feature_query("W6_returns", " ".join(f"ret_{n}d:f4" for n in (1, 5, 20, 60, 120, 250)) + " mom_12_1:f4",
              ", ".join(f"{pct_sql('adj_close', lag('adj_close', n))} AS ret_{n}d" for n in (1, 5, 20, 60, 120, 250))
              + f", {pct_sql(lag('adj_close', 22), lag('adj_close', 252))} AS mom_12_1")
HI52, LO52 = roll("max", "adj_high", 250, 60), roll("min", "adj_low", 250, 60)
feature_query("W7_52week", "high_52w:f4 low_52w:f4 pct_from_52w_high:f4 pct_from_52w_low:f4",
              f"{HI52} AS high_52w, {LO52} AS low_52w, {pct_sql('adj_close', HI52)} AS pct_from_52w_high, "
              f"{pct_sql('adj_close', LO52)} AS pct_from_52w_low")
_prior = {"hi_20_prior": ("max", "adj_high", 20, 10), "hi_60_prior": ("max", "adj_high", 60, 30),
          "hi_250_prior": ("max", "adj_high", 250, 60), "lo_20_prior": ("min", "adj_low", 20, 10),
          "lo7_prior": ("min", "adj_close", 7, None), "hi7_prior": ("max", "adj_close", 7, None),
          "close_hi_20": ("max", "adj_close", 20, None), "low5_prior": ("min", "adj_low", 5, None),
          "low10_prior": ("min", "adj_low", 10, None)}
feature_query("W8_prior_extremes", " ".join(f"{n}:f4" for n in _prior),
              ", ".join(f"{roll(a, x, n, m, True)} AS {k}" for k, (a, x, n, m) in _prior.items()))
register("W8_long_base", KEY + "close_hi_500:f4 range_500_pct:f4",
         lambda s, d: build_features(panels.day_panel(s, d), ["close_hi_500", "range_500_pct"]),
         f"WITH {DAYS}, t AS (SELECT isin, date, {roll('max', 'adj_close', 500, None, True)} AS close_hi_500, "
         f"{roll('min', 'adj_close', 500, None, True)} AS lo FROM days) "
         "@@ SELECT isin, date, close_hi_500, (close_hi_500 / lo - 1) * 100 AS range_500_pct FROM t")
feature_query("W9_slopes", "sma_200_slope:f4 sma_150_slope:f4 sma_50_slope:f4",
              f"WITH {BARS}, t AS (SELECT *, {SMA[200]} AS a, {SMA[150]} AS b, {SMA[50]} AS c FROM bars) "
              f"@@ SELECT isin, date, {pct_sql('a', lag('a', 20))} AS sma_200_slope, "
              f"{pct_sql('b', lag('b', 20))} AS sma_150_slope, {pct_sql('c', lag('c', 10))} AS sma_50_slope FROM t")
feature_query("W10_pullback", "ext_ema21_15:f4 off_high_10:f4 base_depth:f4",
              RECURSION + f", t AS (SELECT b.*, CASE WHEN w.r >= 21 THEN (b.adj_close / e21 - 1) * 100 END AS d21 "
              f"FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r) @@ SELECT isin, date, "
              f"{roll('max', 'd21', 15, 5, True)} AS ext_ema21_15, {pct_sql('adj_close', roll('max', 'adj_high', 10, 5))} AS off_high_10, "
              f"{pct_sql('adj_close', roll('max', 'adj_high', 40, 20))} AS base_depth FROM t")
feature_query("W11_contraction", "range_ratio:f4 contract_a:f4 contract_b:f4 contract_c:f4 contract_seq:i contract_ratio:f4 atr_ratio_60:f4",
              RECURSION + f", t AS (SELECT b.*, {roll('max', 'adj_high', 10, over='PARTITION BY b.isin ORDER BY b.date')} - "
              f"{roll('min', 'adj_low', 10, over='PARTITION BY b.isin ORDER BY b.date')} AS span, "
              f"{roll('avg', 'adj_close', 10, over='PARTITION BY b.isin ORDER BY b.date')} AS m, "
              "CASE WHEN w.r > 14 THEN atr END AS a14 FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r), "
              f"u AS (SELECT *, span / m * 100 AS wd FROM t), "
              f"v AS (SELECT *, {lag('wd', 20)} AS ca, {lag('wd', 10)} AS cb FROM u) "
              f"@@ SELECT isin, date, span / nullif({lag('span', 10)}, 0) AS range_ratio, ca AS contract_a, cb AS contract_b, "
              "wd AS contract_c, CASE WHEN wd < cb AND cb < ca THEN 1 ELSE 0 END AS contract_seq, wd / ca AS contract_ratio, "
              f"a14 / {lag('a14', 60)} AS atr_ratio_60 FROM v")
feature_query("W12_volume", "vol_sma_20:f4 vol_ratio:f4 vol_dryup:f4 vol_vs_ema21:f4 pb_vol_dry:f4",
              RECURSION + ", t AS (SELECT b.*, CASE WHEN w.r >= 21 THEN vema END AS ve FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r), "
              f"u AS (SELECT *, {roll('avg', 'volume', 20, 10)} AS v20, {roll('avg', 'volume', 10)} AS v10, "
              f"{roll('avg', 'volume', 40)} AS v40, {roll('avg', 'volume', 3)} AS v3 FROM t) "
              f"@@ SELECT isin, date, v20 AS vol_sma_20, volume / v20 AS vol_ratio, v10 / v40 AS vol_dryup, "
              f"volume / ve AS vol_vs_ema21, v3 / {lag('v10', 3)} AS pb_vol_dry FROM u")
feature_query("W13_turnover_median", "turnover_est:f2 turnover_median_20d:f2",
              f"turnover AS turnover_est, {roll('median', 'turnover', 20, 10)} AS turnover_median_20d")
feature_query("W14_up_down_volume", "ud_vol_20:f4",
              f"WITH {BARS}, t AS (SELECT *, CASE WHEN adj_close > {lag('adj_close')} THEN volume ELSE 0 END AS up FROM bars) "
              f"@@ SELECT isin, date, {roll('sum', 'up', 20, 15)} * 1.0 / nullif({roll('sum', '(volume - up)', 20, 15)}, 0) AS ud_vol_20 FROM t")
_PP = (f"WITH {BARS}, t AS (SELECT *, {lag('adj_close')} AS pc FROM bars), "
       "u AS (SELECT *, CASE WHEN adj_close < pc THEN volume END AS dv FROM t), "
       f"x AS (SELECT *, {roll('max', 'dv', 10, 3, True)} AS m FROM u) ")
feature_query("W15_pocket_pivot", "down_vol_max_10:n pocket_pivot:i",
              _PP + "@@ SELECT isin, date, m AS down_vol_max_10, CASE WHEN adj_close > pc AND volume > m THEN 1 ELSE 0 END AS pocket_pivot FROM x")
_BASE = (f"WITH {BARS}, t AS (SELECT *, {roll('max', 'adj_high', 60, 40, True)} AS bh, {roll('min', 'adj_low', 60, 40, True)} AS bl, "
         f"{lag('adj_close')} AS pc FROM bars), u AS (SELECT *, CASE WHEN adj_close > (bh + bl) / 2 THEN 1 ELSE 0 END AS upper, "
         "CASE WHEN adj_close > pc THEN 1 ELSE 0 END AS up FROM t) ")
feature_query("W16_share_windows", "smooth_60:f4 time_in_upper_half:f4",
              _BASE + f"@@ SELECT isin, date, {roll('avg', 'up', 60, 40)} * 100 AS smooth_60, {roll('avg', 'upper', 60, 40)} * 100 AS time_in_upper_half FROM u")
feature_query("W17_base_geometry", "base_range_60:f4 base_hi_60:f4",
              _BASE + "@@ SELECT isin, date, (bh - bl) / adj_close * 100 AS base_range_60, bh AS base_hi_60 FROM u")
CLOSE_POS = "CASE WHEN adj_high > adj_low THEN least(greatest((adj_close - adj_low) / (adj_high - adj_low), 0), 1) END"
LOW3 = roll("min", "adj_low", 3, 1)
feature_query("W18_close_position", "close_pos_3:f4 low3_pct:f4 confirm_low_pct:f4",
              f"WITH {BARS}, t AS (SELECT *, {CLOSE_POS} AS cp FROM bars) "
              f"@@ SELECT isin, date, {roll('avg', 'cp', 3, 2)} AS close_pos_3, {pct_sql(LOW3, 'adj_close')} AS low3_pct, "
              f"{pct_sql('adj_low', 'adj_close')} AS confirm_low_pct FROM t")
feature_query("P5_range_position", "close_pos:f4", f"{CLOSE_POS} AS close_pos")
_CANDLE = (f"WITH {BARS}, t AS (SELECT *, {lag('adj_close')} AS pc, {lag('adj_close', 2)} AS ppc, {lag('adj_open')} AS po, "
           f"{lag('adj_high')} AS ph, {lag('adj_low')} AS pl, {CLOSE_POS} AS cp, nullif(adj_high - adj_low, 0) AS rg, "
           f"{roll('min', 'adj_low', 20, None, True)} AS l20 FROM bars), "
           "u AS (SELECT *, (least(adj_open, adj_close) - adj_low) / rg AS lw, abs(adj_close - adj_open) / rg AS bp FROM t), "
           "x AS (SELECT *, CASE WHEN pc < po AND adj_close > adj_open AND adj_open <= pc AND adj_close >= po THEN 1 ELSE 0 END AS be, "
           "CASE WHEN lw >= 0.5 AND cp >= 0.6 THEN 1 ELSE 0 END AS hm, CASE WHEN bp <= 0.1 THEN 1 ELSE 0 END AS dj, "
           "CASE WHEN adj_close > ph THEN 1 ELSE 0 END AS cph FROM u) ")
feature_query("W19_candles", "lower_wick:f4 body_pct:f4 bull_engulf:i hammer:i doji:i close_above_prev_high:i any_reversal:i inside_bar:i two_up:i higher_low:i",
              _CANDLE + "@@ SELECT isin, date, lw AS lower_wick, bp AS body_pct, be AS bull_engulf, hm AS hammer, dj AS doji, "
              "cph AS close_above_prev_high, CASE WHEN be + hm + cph > 0 THEN 1 ELSE 0 END AS any_reversal, "
              "CASE WHEN adj_high <= ph AND adj_low >= pl THEN 1 ELSE 0 END AS inside_bar, "
              "CASE WHEN adj_close > pc AND pc > ppc THEN 1 ELSE 0 END AS two_up, CASE WHEN adj_low > l20 THEN 1 ELSE 0 END AS higher_low FROM x")
register("W20_history", KEY + "bars_available:i bars_total:i",
         lambda s, d: panels.week_panel(s, d).select(
             "isin", "date", S.row().alias("bars_available"),
             F.count(F.lit(1)).over(Window.partitionBy("isin")).alias("bars_total")),
         f"WITH {BARS} @@ SELECT isin, date, r AS bars_available, last_r AS bars_total FROM bars")


def _money_volume(spark, sf_dir):
    c, h, l, v = (F.col(x) for x in ("adj_close", "adj_high", "adj_low", "volume"))
    df = panels.week_panel(spark, sf_dir).withColumn("__pc", S.lag(c))
    df = df.withColumns({
        "dv": F.when(c > F.col("__pc"), v).when(c < F.col("__pc"), -v).otherwise(F.lit(0)),
        "mfv": v * (((c - l) / (h - l + 1e-9)) * 2 - 1)})
    df = df.withColumns({"obv": F.sum("dv").over(S.so_far()),
                         "cmf_20": ratio(S.total(F.col("mfv"), 20), S.total(v, 20))})
    return df.withColumns({"obv_hi_60": S.highest(F.col("obv"), 60, prior=True), "cmf_prev": S.lag(F.col("cmf_20"))}).withColumn(
        "cmf_cross", holds((F.col("cmf_20") > 0) & (F.col("cmf_prev") <= 0)).cast("int"))


register("W21_obv_cmf", KEY + "obv:i obv_hi_60:n cmf_20:f4 cmf_cross:i", _money_volume,
         f"WITH {BARS}, t AS (SELECT *, {lag('adj_close')} AS pc, volume * (2 * ((adj_close - adj_low) / (adj_high - adj_low + 1e-9)) - 1) AS mfv FROM bars), "
         "u AS (SELECT *, CASE WHEN adj_close > pc THEN volume WHEN adj_close < pc THEN -volume ELSE 0 END AS dv FROM t), "
         f"x AS (SELECT *, sum(dv) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv, {roll('sum', 'mfv', 20)} / {roll('sum', 'volume', 20)} AS cmf_20 FROM u) "
         f"@@ SELECT isin, date, obv, {roll('max', 'obv', 60, None, True)} AS obv_hi_60, cmf_20, "
         f"CASE WHEN cmf_20 > 0 AND {lag('cmf_20')} <= 0 THEN 1 ELSE 0 END AS cmf_cross FROM x")


def _beta(spark, sf_dir):
    df = panels.week_panel(spark, sf_dir).withColumn("ret", pct(F.col("adj_close"), S.lag(F.col("adj_close"))))
    market = df.groupBy("date").agg(F.avg("ret").alias("mkt"))
    df = df.join(market, "date").withColumns({
        "__b": S.beta(F.col("ret"), F.col("mkt"), 250, 120),
        "__bp": S.beta(F.col("ret"), F.col("mkt"), 250, 200, population=True)})
    return df.withColumns({"beta_250": S.lag(F.col("__b")), "beta_pop": F.col("__bp")})


register("W22_beta", KEY + "beta_250:f4 beta_pop:f4", _beta,
         f"WITH {BARS}, t AS (SELECT *, {pct_sql('adj_close', lag('adj_close'))} AS ret FROM bars), "
         "m AS (SELECT date, avg(ret) AS mkt FROM t GROUP BY 1), "
         "u AS (SELECT isin, date, CASE WHEN mkt IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN mkt END AS x FROM t JOIN m USING (date)), "
         f"v AS (SELECT isin, date, CASE WHEN count(x) OVER f >= 120 THEN covar_samp(y, x) OVER f / var_samp(x) OVER f END AS b, "
         f"CASE WHEN count(x) OVER f >= 200 THEN covar_pop(y, x) OVER f / var_pop(x) OVER f END AS bp FROM u "
         f"WINDOW f AS ({W} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)) "
         f"@@ SELECT isin, date, {lag('b')} AS beta_250, bp AS beta_pop FROM v")
register("W23_window_rank", KEY + "rank_60:f4",
         lambda s, d: panels.week_panel(s, d).select("isin", "date", S.rank_in_window(F.col("adj_close"), 60).alias("rank_60")),
         f"WITH {BARS} @@ SELECT a.isin, a.date, CASE WHEN a.r >= 60 THEN (count(*) FILTER (b.adj_close < a.adj_close) + "
         "(count(*) FILTER (b.adj_close = a.adj_close) + 1) / 2.0) / 60 * 100 END AS rank_60 FROM bars a JOIN bars b "
         "ON a.isin = b.isin AND b.r BETWEEN a.r - 59 AND a.r GROUP BY a.isin, a.date, a.r")


def _z(spark, sf_dir):
    c = F.col("adj_close")
    df = panels.week_panel(spark, sf_dir).withColumn("ret", ratio(c, S.lag(c)) - 1)
    return df.withColumns({"z_60": ratio(c - S.mean(c, 60), S.std(c, 60)),
                           "rvol_20": S.std(F.col("ret"), 20) * 252 ** 0.5 * 100,
                           "dd_252": pct(c, S.highest(c, 252)), "roc_10": pct(c, S.lag(c, 10))})


register("W24_trend_block", KEY + "z_60:f4 rvol_20:f4 dd_252:f4 roc_10:f4", _z,
         f"WITH {BARS}, t AS (SELECT *, adj_close / {lag('adj_close')} - 1 AS ret FROM bars) @@ SELECT isin, date, "
         f"(adj_close - {roll('avg', 'adj_close', 60)}) / ({roll('stddev_samp', 'adj_close', 60)}) AS z_60, "
         f"({roll('stddev_samp', 'ret', 20)}) * sqrt(252) * 100 AS rvol_20, {pct_sql('adj_close', roll('max', 'adj_close', 252))} AS dd_252, "
         f"{pct_sql('adj_close', lag('adj_close', 10))} AS roc_10 FROM t")
feature_query("W26_daily_cpr", "d_cpr_p:f4 d_cpr_tc:f4 d_cpr_bc:f4 d_cpr_width:f4",
              f"WITH {BARS}, t AS (SELECT isin, date, {lag('adj_high')} AS h, {lag('adj_low')} AS l, {lag('adj_close')} AS c FROM bars), "
              "u AS (SELECT *, (h + l + c) / 3 AS p, (h + l) / 2 AS m FROM t), v AS (SELECT *, 2 * p - m AS q FROM u) "
              "@@ SELECT isin, date, p AS d_cpr_p, CASE WHEN p IS NOT NULL THEN greatest(q, m) END AS d_cpr_tc, CASE WHEN p IS NOT NULL THEN least(q, m) END AS d_cpr_bc, "
              "CASE WHEN p IS NOT NULL THEN (greatest(q, m) - least(q, m)) / p * 100 END AS d_cpr_width FROM v")


def _extension(spark, sf_dir):
    c = F.col("adj_close")
    df = features(spark, sf_dir, "dist_sma_50", "sma_50", "atr_14", "dist_sma_200").withColumn("max_dist_sma50_20", S.highest(F.col("dist_sma_50"), 20, 10, prior=True))
    return df.withColumns({"sma50_less_atr": F.col("sma_50") - F.col("atr_14"),
                           "down3": holds((c < S.lag(c)) & (S.lag(c) < S.lag(c, 2)) & (S.lag(c, 2) < S.lag(c, 3))).cast("int")})


register("W27_extension", KEY + "max_dist_sma50_20:f4 sma50_less_atr:f4 down3:i dist_sma_200:f4", _extension,
         RECURSION + f", t AS (SELECT b.*, CASE WHEN w.r > 14 THEN atr END AS a14 FROM walk w JOIN bars b ON b.isin = w.isin AND b.r = w.r), "
         f"u AS (SELECT *, {SMA[50]} AS s50, {SMA[200]} AS s200, {lag('adj_close')} AS c1, {lag('adj_close', 2)} AS c2, {lag('adj_close', 3)} AS c3 FROM t), "
         "x AS (SELECT *, (adj_close / s50 - 1) * 100 AS d50 FROM u) "
         f"@@ SELECT isin, date, {roll('max', 'd50', 20, 10, True)} AS max_dist_sma50_20, s50 - a14 AS sma50_less_atr, "
         "CASE WHEN adj_close < c1 AND c1 < c2 AND c2 < c3 THEN 1 ELSE 0 END AS down3, (adj_close / s200 - 1) * 100 AS dist_sma_200 FROM x")
feature_query("W28_gap", "gap_pct:f4", f"{pct_sql('adj_open', lag('adj_close'))} AS gap_pct")


def _ema_turns(spark, sf_dir):
    e21, e50, c = F.col("ema_21"), F.col("ema_50"), F.col("adj_close")
    df = features(spark, sf_dir, "ema_21", "ema_50")
    return df.select("isin", "date", ev.crossed_above(e21, e50).cast("int").alias("ema_cross"),
                     holds((c > e21) & (S.lag(c) <= S.lag(e21))).cast("int").alias("ema21_turn"))


register("W29_ema_turns", KEY + "ema_cross:i ema21_turn:i", _ema_turns,
         RECURSION + ", t AS (SELECT w.isin, w.date, x.adj_close AS c, CASE WHEN w.r >= 21 THEN e21 END AS a, CASE WHEN w.r >= 50 THEN e50 END AS b "
         "FROM walk w JOIN bars x ON x.isin = w.isin AND x.r = w.r) "
         f"@@ SELECT isin, date, CASE WHEN a > b AND NOT coalesce({lag('a')} > {lag('b')}, false) THEN 1 ELSE 0 END AS ema_cross, "
         f"CASE WHEN c > a AND {lag('c')} <= {lag('a')} THEN 1 ELSE 0 END AS ema21_turn FROM t")
feature_query("P3_distances", "dist_sma_10:f4 dist_sma_50:f4 pct_from_52w_high:f4",
              f"{pct_sql('adj_close', SMA[10])} AS dist_sma_10, {pct_sql('adj_close', SMA[50])} AS dist_sma_50, {pct_sql('adj_close', HI52)} AS pct_from_52w_high")

# ------------------------------------------------------------------ calendar-period levels
def levels_cte(prefix: str, period: str) -> str:
    p = prefix
    return f"""{p}_agg AS (SELECT isin, {period} AS per, max(adj_high) AS h, min(adj_low) AS l, arg_max(adj_close, date) AS c FROM bars GROUP BY 1, 2),
{p}_prev AS (SELECT isin, per, lag(h) OVER q AS h, lag(l) OVER q AS l, lag(c) OVER q AS c FROM {p}_agg WINDOW q AS (PARTITION BY isin ORDER BY per)),
{p}_lv AS (SELECT isin, per, p AS {p}_p, 2 * p - l AS {p}_r1, 2 * p - h AS {p}_s1, p + (h - l) AS {p}_r2, p - (h - l) AS {p}_s2,
  h + 2 * (p - l) AS {p}_r3, l - 2 * (h - p) AS {p}_s3, greatest(2 * p - m, m) AS {p}_cpr_tc, least(2 * p - m, m) AS {p}_cpr_bc,
  (greatest(2 * p - m, m) - least(2 * p - m, m)) / p * 100 AS {p}_cpr_width
  FROM (SELECT *, (h + l + c) / 3 AS p, (h + l) / 2 AS m FROM {p}_prev WHERE h IS NOT NULL) AS z)"""


WEEK, MONTH = "CAST(date_trunc('week', date) AS DATE)", "CAST(date_trunc('month', date) AS DATE)"
LEVELS = f"WITH {BARS}, {levels_cte('w', WEEK)}, {levels_cte('m', MONTH)}, " + (
    f"lv AS (SELECT bars.*, w_lv.* EXCLUDE (isin, per), m_lv.* EXCLUDE (isin, per) FROM bars "
    f"LEFT JOIN w_lv ON w_lv.isin = bars.isin AND w_lv.per = {WEEK.replace('date)', 'bars.date)')} "
    f"LEFT JOIN m_lv ON m_lv.isin = bars.isin AND m_lv.per = {MONTH.replace('date)', 'bars.date)')})")
feature_query("L1_pivots", " ".join(f"m_{x}:f4" for x in ("p", "r1", "r2", "r3", "s1", "s2", "s3")),
              LEVELS + " @@ SELECT * FROM lv")
feature_query("L2_cpr", "m_cpr_tc:f4 m_cpr_bc:f4 m_cpr_width:f4", LEVELS + " @@ SELECT * FROM lv")
feature_query("L3_period_levels", "w_p:f4 w_r1:f4 w_s1:f4 w_cpr_tc:f4 w_cpr_width:f4 dist_m_r1:f4 low3_dist_m_r1:f4",
              LEVELS + f" @@ SELECT *, {pct_sql('adj_close', 'm_r1')} AS dist_m_r1, {pct_sql(LOW3, 'm_r1')} AS low3_dist_m_r1 FROM lv")
WEEK_FRI = "CAST(date_trunc('week', date + INTERVAL 2 DAY) AS DATE)"
register("L4_three_weeks_tight", KEY + "tight_3w_pct:f4",
         lambda s, d: build_features(panels.day_panel(s, d), ["tight_3w_pct"]),
         f"WITH {DAYS}, k AS (SELECT *, {WEEK_FRI} AS wk FROM days), a AS (SELECT isin, wk, arg_max(adj_close, date) AS c FROM k GROUP BY 1, 2), "
         "s AS (SELECT isin, wk, CASE WHEN count(c) OVER f >= 3 THEN (max(c) OVER f - min(c) OVER f) / max(c) OVER f * 100 END AS sp FROM a "
         "WINDOW f AS (PARTITION BY isin ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), "
         "p AS (SELECT isin, wk, lag(sp) OVER (PARTITION BY isin ORDER BY wk) AS tight_3w_pct FROM s) "
         "@@ SELECT k.isin, k.date, tight_3w_pct FROM k LEFT JOIN p ON p.isin = k.isin AND p.wk = k.wk")
feature_query("L5_width_rank", "m_cpr_width_rank:f4",
              LEVELS + f", mm AS (SELECT isin, {MONTH} AS mo, first(m_cpr_width ORDER BY date) AS wd FROM lv GROUP BY 1, 2), "
              "ar AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY mo) AS k FROM mm), "
              "rk AS (SELECT a.isin, a.mo, CASE WHEN count(b.wd) + count(DISTINCT a.wd) >= 6 THEN count(*) FILTER (b.wd < a.wd) * 1.0 / nullif(count(b.k), 0) END AS q "
              "FROM ar a LEFT JOIN ar b ON b.isin = a.isin AND b.k BETWEEN a.k - 11 AND a.k - 1 GROUP BY a.isin, a.mo) "
              f"@@ SELECT lv.isin, lv.date, q AS m_cpr_width_rank FROM lv JOIN rk ON rk.isin = lv.isin AND rk.mo = {MONTH.replace('date)', 'lv.date)')}")

# ------------------------------------------------------------------ events
def since(flag: str, w: str = W) -> str:
    return f"r - max(CASE WHEN {flag} THEN r END) OVER ({w} ROWS UNBOUNDED PRECEDING)"


def crossed(x: str, level: str) -> str:
    return f"(coalesce({x} > {level}, false) AND NOT coalesce({lag(f'{x} > {level}')}, false))"


register("E1_crossed_above", KEY + "crossed:i",
         lambda s, d: features(s, d, "sma_20").select("isin", "date", ev.crossed_above(F.col("adj_close"), F.col("sma_20")).cast("int").alias("crossed")),
         f"WITH {BARS}, t AS (SELECT *, {SMA[20]} AS m FROM bars) @@ SELECT isin, date, CASE WHEN {crossed('adj_close', 'm')} THEN 1 ELSE 0 END AS crossed FROM t")
register("E2_rows_since", KEY + "since_new_high:n",
         lambda s, d: features(s, d, "new_hi7").select("isin", "date", ev.rows_since(F.col("new_hi7") == 1).alias("since_new_high")),
         f"WITH {BARS}, t AS (SELECT *, adj_close > {roll('max', 'adj_close', 7, None, True)} AS f FROM bars) @@ SELECT isin, date, {since('f')} AS since_new_high FROM t")
_BRK = (f"WITH {BARS}, t AS (SELECT *, {roll('max', 'adj_high', 60, 30, True)} AS hp FROM bars), "
        f"u AS (SELECT *, {crossed('adj_close', 'hp')} AS brk FROM t), "
        f"v AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS seg, "
        f"last_value(CASE WHEN brk THEN hp END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS lvl FROM u) ")
feature_query("E3_value_at_event", "brk_level:f4 since_brk_60:n", _BRK + f"@@ SELECT isin, date, lvl AS brk_level, {since('brk')} AS since_brk_60 FROM v")
feature_query("E4_event_segments", "low_since_brk:f4 closes_above_brk:i brk_cushion:f4",
              _BRK + ", x AS (SELECT *, min(adj_low) OVER s AS ls, sum(CASE WHEN adj_close > lvl THEN 1 ELSE 0 END) OVER s AS ca FROM v "
              "WINDOW s AS (PARTITION BY isin, seg ORDER BY date ROWS UNBOUNDED PRECEDING)) "
              "@@ SELECT isin, date, ls AS low_since_brk, ca AS closes_above_brk, (ls / lvl - 1) * 100 AS brk_cushion FROM x")
_STATE = f"WITH {BARS}, t AS (SELECT *, CASE WHEN adj_close > {SMA[20]} THEN 1 ELSE 0 END AS e FROM bars) "


def _state(s, d):
    return features(s, d, "sma_20").withColumn("e", holds(F.col("adj_close") > F.col("sma_20")))


register("E5_fresh_after_quiet", KEY + "fresh:i",
         lambda s, d: _state(s, d).select("isin", "date", ev.fresh_after_quiet(F.col("e"), 3).cast("int").alias("fresh")),
         _STATE + f"@@ SELECT isin, date, CASE WHEN e = 1 AND {roll('sum', 'e', 3, None, True)} = 0 THEN 1 ELSE 0 END AS fresh FROM t")
register("E6_fresh_or_first", KEY + "fresh:i",
         lambda s, d: _state(s, d).select("isin", "date", ev.fresh_or_first(F.col("e"), 20).cast("int").alias("fresh")),
         _STATE + f"@@ SELECT isin, date, CASE WHEN e = 1 AND coalesce(sum(e) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS fresh FROM t")
register("E7_run_length", KEY + "run:i",
         lambda s, d: _state(s, d).select("isin", "date", ev.run_length(F.col("e")).alias("run")),
         _STATE + f", g AS (SELECT *, sum(1 - e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS seg FROM t) "
         "@@ SELECT isin, date, sum(e) OVER (PARTITION BY isin, seg ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM g")
_SPRING = (f"t AS (SELECT bars.*, {roll('min', 'adj_low', 20, 10, True)} AS lp, {CLOSE_POS} AS cp FROM bars), "
           "u AS (SELECT *, coalesce(adj_low < lp AND adj_close > lp AND cp > 0.5, false) AS sp FROM t), "
           f"v AS (SELECT *, {since('sp')} AS ss, last_value(CASE WHEN sp THEN adj_low END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS sl FROM u)")
feature_query("E8_spring", "spring:i since_spring:n spring_low:f4 dist_spring_low:f4 atr_to_spring:f4",
              RECURSION + f", {_SPRING} @@ SELECT v.isin, v.date, CASE WHEN sp THEN 1 ELSE 0 END AS spring, ss AS since_spring, sl AS spring_low, "
              "(adj_close / sl - 1) * 100 AS dist_spring_low, CASE WHEN v.r > 14 THEN (adj_close - sl) / atr END AS atr_to_spring "
              "FROM v JOIN walk w ON w.isin = v.isin AND w.r = v.r")
feature_query("E9_confirmed_cross", "since_r1_vol_breakout:n",
              RECURSION + ", " + LEVELS.removeprefix(f"WITH {BARS}, ") +
              f", t AS (SELECT lv.*, CASE WHEN w.r >= 21 THEN vema END AS ve FROM lv JOIN walk w ON w.isin = lv.isin AND w.r = lv.r), "
              f"u AS (SELECT *, {crossed('adj_close', 'm_r1')} AND coalesce(volume > ve, false) AS f FROM t) "
              f"@@ SELECT isin, date, {since('f')} AS since_r1_vol_breakout FROM u")
_CR = ("m_cpr_tc", "w_cpr_tc", "m_p", "m_r1")
feature_query("E10_level_crosses", " ".join(f"since_{x}_cross:n" for x in _CR) + " dist_m_cpr_tc:f4 low3_dist_w_cpr_tc:f4",
              LEVELS + ", u AS (SELECT *, " + ", ".join(f"{crossed('adj_close', x)} AS f_{x}" for x in _CR) + " FROM lv) @@ SELECT isin, date, "
              + ", ".join(f"{since(f'f_{x}')} AS since_{x}_cross" for x in _CR)
              + f", {pct_sql('adj_close', 'm_cpr_tc')} AS dist_m_cpr_tc, {pct_sql(LOW3, 'w_cpr_tc')} AS low3_dist_w_cpr_tc FROM u")
feature_query("E11_since_high", "pb_days:n",
              f"WITH {BARS}, t AS (SELECT *, adj_high >= {roll('max', 'adj_high', 10)} AS f FROM bars) @@ SELECT isin, date, {since('f')} AS pb_days FROM t")
register("E15_first_in_period", KEY + "first_touch:i",
         lambda s, d: features(s, d, "m_cpr_tc").withColumn("__e", F.col("adj_low") <= F.col("m_cpr_tc")).withColumn(
             "__m", F.trunc("date", "month")).withColumn(
             "__k", F.sum(holds(F.col("__e")).cast("int")).over(
                 Window.partitionBy("isin", "__m").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).select(
             "isin", "date", (holds(F.col("__e")) & (F.col("__k") == 1)).cast("int").alias("first_touch")),
         LEVELS + f", t AS (SELECT *, CASE WHEN adj_low <= m_cpr_tc THEN 1 ELSE 0 END AS e, {MONTH} AS mo FROM lv) "
         "@@ SELECT isin, date, CASE WHEN e = 1 AND sum(e) OVER (PARTITION BY isin, mo ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 THEN 1 ELSE 0 END AS first_touch FROM t")
register("A3_hour_bars", "isin:s hour:s open:f4 high:f4 low:f4 close:f4 volume:i",
         lambda s, d: bar_io.hour_bars(panels.minute_panel(s, d)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")),
         f"WITH {MINUTES}, h AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01 09:15:00') AS hour FROM minutes) "
         "@@ SELECT isin, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, first(open ORDER BY ts, event_id) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM h GROUP BY isin, 2")
register("A4_week_bars", "isin:s week:d open:f4 high:f4 low:f4 close:f4 volume:i",
         lambda s, d: bar_io.week_bars(panels.day_panel(s, d)),
         f"WITH {DAYS}, k AS (SELECT *, {WEEK_FRI} + 4 AS week FROM days) "
         "@@ SELECT isin, week, arg_min(adj_open, date) AS open, max(adj_high) AS high, min(adj_low) AS low, arg_max(adj_close, date) AS close, sum(volume) AS volume FROM k GROUP BY 1, 2")
