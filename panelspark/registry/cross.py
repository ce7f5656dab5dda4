"""Cross-section, market-state, index and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import quadrant
from ..operators import cross, indices, market
from ..operators.features import build_features
from ..session import cut_lineage
from ..sources import panels
from .base import BARS, W, register, roll
from .windows import HI52, KEY, LO52, RECURSION, SMA, lag, pct_sql


def pct_rank_sql(x: str, by: str = "date") -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, ({x} IS NULL) ORDER BY {x}) "
            f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by}, ({x} IS NULL)) END")


RS = f"""rs0 AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 60))} AS r60, {pct_sql('adj_close', lag('adj_close', 120))} AS r120,
  {pct_sql('adj_close', lag('adj_close', 250))} AS r250 FROM bars),
rs1 AS (SELECT *, {pct_rank_sql('r60')} AS p60, {pct_rank_sql('r120')} AS p120, {pct_rank_sql('r250')} AS p250 FROM rs0),
rs2 AS (SELECT *, 0.4 * p60 + 0.2 * p120 + 0.4 * p250 AS sc FROM rs1),
rs3 AS (SELECT *, round(sc, 12) AS rs_score FROM rs2),
rs AS MATERIALIZED (SELECT isin, date, r, rs_score, round_even({pct_rank_sql('rs_score')} * 99, 0) AS rs_rank FROM rs3)"""


def _rs(spark, sf_dir):
    return cross.add_relative_strength(build_features(panels.stored_week_panel(spark, sf_dir), list(cross.RS_WEIGHTS)))


register("X1_relative_strength", KEY + "rs_score:f4 rs_rank:n", _rs, f"WITH {BARS}, {RS} @@ SELECT * FROM rs")
FWD = ", ".join(f"{pct_sql(f'lead(adj_close, {k}) OVER ({W})', 'adj_close')} AS fwd_{k}d" for k in (1, 5, 20))
FORWARD = (f"fw AS (SELECT *, {FWD} FROM bars), fb AS (SELECT date, " + ", ".join(f"avg(fwd_{k}d) AS bench_{k}d" for k in (1, 5, 20))
           + " FROM fw GROUP BY 1), fx AS MATERIALIZED (SELECT fw.*, fb.* EXCLUDE (date), "
           + ", ".join(f"fwd_{k}d - bench_{k}d AS exc_{k}d" for k in (1, 5, 20)) + " FROM fw JOIN fb USING (date))")
register("X2_forward_returns", KEY + " ".join(f"fwd_{k}d:f3 bench_{k}d:f3 exc_{k}d:f3" for k in (1, 5, 20)),
         lambda s, d: cross.add_forward_returns(panels.stored_week_panel(s, d)), f"WITH {BARS}, {FORWARD} @@ SELECT * FROM fx")
register("X3_open_forward", KEY + "ofwd_5d:f3 ofwd_10d:f3 ofwd_20d:f3",
         lambda s, d: cross.add_open_forward_returns(panels.week_panel(s, d)),
         f"WITH {BARS} @@ SELECT isin, date, " + ", ".join(
             f"{pct_sql(f'lead(adj_close, {k}) OVER ({W})', f'lead(adj_open) OVER ({W})')} AS ofwd_{k}d" for k in (5, 10, 20)) + " FROM bars")
register("X4_top_n", KEY + "ret_20d:f4 place:i",
         lambda s, d: cross.top_n(build_features(panels.week_panel(s, d), ["ret_20d"]).filter("ret_20d is not null"), ["date"], F.col("ret_20d"), 5),
         f"WITH {BARS}, t AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 20))} AS ret_20d FROM bars) "
         "@@ SELECT isin, date, ret_20d, row_number() OVER (PARTITION BY date ORDER BY ret_20d DESC, isin) AS place FROM t WHERE ret_20d IS NOT NULL "
         "QUALIFY place <= 5")
register("X5_composite_score", KEY + "score:f6",
         lambda s, d: cross.composite_score(cut_lineage(build_features(panels.week_panel(s, d), ["ret_20d", "vol_ratio", "dist_sma_50"])),
                                            {"ret_20d": 1, "vol_ratio": -1, "dist_sma_50": 1}),
         f"WITH {BARS}, t AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 20))} AS a, -(volume / ({roll('avg', 'volume', 20, 10)})) AS b, "
         f"{pct_sql('adj_close', SMA[50])} AS c FROM bars) @@ SELECT isin, date, (coalesce({pct_rank_sql('a')}, 0.5) + "
         f"coalesce({pct_rank_sql('b')}, 0.5) + coalesce({pct_rank_sql('c')}, 0.5)) / 3 AS score FROM t")
_BF = ["sma_20", "sma_50", "sma_200", "ret_1d", "ret_20d", "pct_from_52w_high", "pct_from_52w_low", "rsi_14"]
DAYS_SQL = (f"bx AS (SELECT *, {SMA[20]} AS s20, {SMA[50]} AS s50, {SMA[200]} AS s200, {pct_sql('adj_close', lag('adj_close'))} AS ret_1d, "
            f"{pct_sql('adj_close', lag('adj_close', 20))} AS ret_20d, {pct_sql('adj_close', HI52)} AS ph, {pct_sql('adj_close', LO52)} AS pl FROM bars)")


def _f(s, d):
    return build_features(panels.week_panel(s, d), _BF)


register("X6_breadth", "date:d members:i above_20:i above_50:i above_200:i pct_above_50:f4 pct_above_200:f4 advancing:i declining:i new_highs:i new_lows:i median_rsi:f4 median_ret_1d:f4",
         lambda s, d: cross.breadth(cut_lineage(_f(s, d))),
         RECURSION + f", {DAYS_SQL}, w2 AS (SELECT isin, r, CASE WHEN r <= 14 THEN NULL WHEN l14 = 0 AND g14 > 0 THEN 100.0 WHEN l14 = 0 THEN 50.0 "
         "ELSE 100 - 100 / (1 + g14 / l14) END AS rsi FROM walk) @@ SELECT date, count(*) AS members, count(*) FILTER (adj_close > s20) AS above_20, "
         "count(*) FILTER (adj_close > s50) AS above_50, count(*) FILTER (adj_close > s200) AS above_200, count(*) FILTER (adj_close > s50) * 100.0 / count(*) AS pct_above_50, "
         "count(*) FILTER (adj_close > s200) * 100.0 / count(*) AS pct_above_200, count(*) FILTER (ret_1d > 0) AS advancing, count(*) FILTER (ret_1d < 0) AS declining, "
         "count(*) FILTER (ph > -1) AS new_highs, count(*) FILTER (pl < 1) AS new_lows, median(rsi) AS median_rsi, median(ret_1d) AS median_ret_1d "
         "FROM bx JOIN w2 ON bx.isin = w2.isin AND bx.r = w2.r GROUP BY date")
DAY = f"""{DAYS_SQL}, dy0 AS (SELECT date, count(*) AS n, count(*) FILTER (ret_1d > 0) AS adv, count(*) FILTER (ret_1d < 0) AS dec,
  avg(CASE WHEN adj_close > s20 THEN 100.0 ELSE 0 END) AS breadth_above_20, avg(CASE WHEN adj_close > s50 THEN 100.0 ELSE 0 END) AS breadth_above_50,
  avg(CASE WHEN adj_close > s200 THEN 100.0 ELSE 0 END) AS breadth_above_200,
  avg(CASE WHEN s50 IS NULL THEN NULL WHEN adj_close > s50 THEN 1.0 ELSE 0 END) * 100 AS b50,
  avg(CASE WHEN s200 IS NULL THEN NULL WHEN adj_close > s200 THEN 1.0 ELSE 0 END) * 100 AS b200,
  avg(CASE WHEN ret_1d > 0 THEN 1.0 ELSE 0 END) * 100 AS adv_ratio, avg(CASE WHEN ret_20d > 0 THEN 1.0 ELSE 0 END) * 100 AS pct_pos_20d,
  count(*) FILTER (ph >= -0.5) AS nh, count(*) FILTER (pl <= 0.5) AS nl, stddev_samp(ret_1d) AS dispersion, avg(ret_1d) AS ew_ret_1d FROM bx GROUP BY date),
dy AS MATERIALIZED (SELECT *, (nh - nl) * 100.0 / n AS new_hi_minus_lo, sum(ln(1 + coalesce(ew_ret_1d, 0) / 100)) OVER (ORDER BY date) AS ew_log,
  row_number() OVER (ORDER BY date) AS i FROM dy0)"""
register("X7_breadth_series", "date:d breadth_above_20:f4 breadth_above_50:f4 breadth_above_200:f4 adv_ratio:f4 pct_pos_20d:f4 new_hi_minus_lo:f4 dispersion:f3 ew_ret_1d:f3 breadth_50_chg_10d:f4",
         lambda s, d: cross.breadth_series(_f(s, d)),
         f"WITH {BARS}, {DAY} @@ SELECT *, breadth_above_50 - lag(breadth_above_50, 10) OVER (ORDER BY date) AS breadth_50_chg_10d FROM dy")
register("X8_equal_weight_level", "index_name:s date:d log_level:f5",
         lambda s, d: cross.equal_weight_level(panels.week_panel(s, d).join(panels.region_map(s, d), "isin"), ["index_name"]),
         f"WITH {BARS}, t AS (SELECT *, adj_close / {lag('adj_close')} - 1 AS ret FROM bars), m AS (SELECT r_name AS index_name, date, avg(ret) AS mr "
         "FROM t JOIN nation ON n_name = isin JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) "
         "@@ SELECT index_name, date, sum(ln(1 + coalesce(mr, 0))) OVER (PARTITION BY index_name ORDER BY date) AS log_level FROM m")
LEVEL = ("lv0 AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY isin ORDER BY date) - 1 AS ret FROM bars), "
         "lv1 AS (SELECT r_name AS index_name, date, avg(ret) AS mr, sum(turnover) AS mine FROM lv0 JOIN nation ON n_name = isin JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), "
         "lv2 AS (SELECT *, sum(ln(1 + coalesce(mr, 0))) OVER (PARTITION BY index_name ORDER BY date) AS lg, sum(mine) OVER (PARTITION BY date) AS total, "
         "row_number() OVER (PARTITION BY index_name ORDER BY date DESC) AS back FROM lv1)")


def _levels(s, d):
    return cross.equal_weight_level(panels.week_panel(s, d).join(panels.region_map(s, d), "isin"), ["index_name"])


register("X9_level_returns", "index_name:s ret_1D:f3 ret_1W:f3",
         lambda s, d: indices.returns_from_level(_levels(s, d), {"1D": 1, "1W": 5}),
         f"WITH {BARS}, {LEVEL} @@ SELECT a.index_name, (exp(a.lg - b.lg) - 1) * 100 AS ret_1D, (exp(a.lg - c.lg) - 1) * 100 AS ret_1W  "
         "FROM lv2 a JOIN lv2 b ON a.index_name = b.index_name AND b.back = 2 JOIN lv2 c ON a.index_name = c.index_name AND c.back = 6 "
         "WHERE a.back = 1")


def _turnover(s, d):
    bars = panels.stored_week_panel(s, d).join(panels.region_map(s, d), "isin")
    total = bars.groupBy("date").agg(F.sum("turnover").alias("total"))
    return bars.groupBy("index_name", "date").agg(F.sum("turnover").alias("mine")).join(total, "date")


def _span(x: str, n: int, back: int = 0) -> str:
    return f"(SELECT avg({x}) FROM sh z WHERE z.index_name = a.index_name AND z.back BETWEEN {back + 1} AND {back + n})"


register("X10_money_flow", "index_name:s turnover_cr:f4 share_pct:f4 share_5d:f4 share_60d:f4 flow_delta:f4 dod_pp:f4 wow_pp:f4 mom_pp:f4 turnover_wow:f4 turnover_mom:f4",
         lambda s, d: indices.money_flow(_turnover(s, d)),
         f"WITH {BARS}, {LEVEL}, sh AS (SELECT *, mine / total * 100 AS share FROM lv2) @@ SELECT index_name, mine / 1e7 AS turnover_cr, share AS share_pct, "
         f"{_span('share', 5)} AS share_5d, {_span('share', 60)} AS share_60d, {_span('share', 5)} - {_span('share', 60)} AS flow_delta, "
         f"{_span('share', 1)} - {_span('share', 1, 1)} AS dod_pp, {_span('share', 5)} - {_span('share', 5, 5)} AS wow_pp, {_span('share', 21)} - {_span('share', 21, 21)} AS mom_pp, "
         f"({_span('mine', 5)} / {_span('mine', 5, 5)} - 1) * 100 AS turnover_wow, ({_span('mine', 21)} / {_span('mine', 21, 21)} - 1) * 100 AS turnover_mom FROM sh a WHERE back = 1")
ROTATION = (f"WITH {BARS}, {LEVEL}, rr0 AS (SELECT s.index_name, s.date, 100 * exp(s.lg - b.lg) AS rs, row_number() OVER (PARTITION BY s.index_name ORDER BY s.date) AS i "
            "FROM lv2 s JOIN lv2 b ON b.index_name = 'ASIA' AND b.date = s.date WHERE s.index_name <> 'ASIA'), "
            "rr1 AS (SELECT *, CASE WHEN i >= 14 THEN 100 + (rs - avg(rs) OVER w) / nullif(stddev_pop(rs) OVER w, 0) END AS x FROM rr0 WINDOW w AS (PARTITION BY index_name ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), "
            "rr2 AS (SELECT *, CASE WHEN count(x) OVER w >= 5 THEN 100 + (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) END AS y FROM rr1 WINDOW w AS (PARTITION BY index_name ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
            "rr AS (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY date DESC) AS back FROM rr2 WHERE y IS NOT NULL)")
QUADRANT = "CASE WHEN x >= 100 AND y >= 100 THEN 'leading' WHEN x >= 100 THEN 'weakening' WHEN y >= 100 THEN 'improving' ELSE 'lagging' END"
register("X11_rotation", "index_name:s rs_ratio:f4 rs_mom:f4 quadrant:s trail_points:i",
         lambda s, d: indices.rotation(_levels(s, d), "ASIA").withColumn("trail_points", F.size("trail")),
         ROTATION + f" @@ SELECT index_name, x AS rs_ratio, y AS rs_mom, {QUADRANT} AS quadrant, (SELECT count(*) FROM rr z WHERE z.index_name = rr.index_name AND z.back <= 5) AS trail_points FROM rr WHERE back = 1")
register("P10_labels", KEY + "quadrant:s",
         lambda s, d: build_features(panels.week_panel(s, d), ["ret_5d", "ret_20d"]).filter("ret_5d is not null and ret_20d is not null").withColumn(
             "quadrant", quadrant(F.col("ret_20d") + 100, F.col("ret_5d") + 100)),
         f"WITH {BARS}, t AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 20))} + 100 AS x, {pct_sql('adj_close', lag('adj_close', 5))} + 100 AS y FROM bars) "
         f"@@ SELECT isin, date, {QUADRANT} AS quadrant FROM t WHERE x IS NOT NULL AND y IS NOT NULL")


def _analytics(s, d):
    """Indices over the members valid on the last session, benchmark included."""
    bars = panels.stored_week_panel(s, d)
    from ..operators.dims import members_on
    asof = bars.agg(F.max("date").alias("as_of"))
    members = members_on(panels.membership(s, d, bars), asof).select("index_name", "isin")
    joined = bars.join(members, "isin")
    levels = cross.equal_weight_level(joined, ["index_name"])
    total = joined.groupBy("date").agg(F.sum("turnover").alias("total"))
    flow = indices.money_flow(joined.groupBy("index_name", "date").agg(F.sum("turnover").alias("mine")).join(total, "date"))
    size = members.groupBy("index_name").agg(F.count(F.lit(1)).alias("members"))
    latest = build_features(bars, _BF).join(members, "isin")
    latest = latest.join(asof, F.col("date") == F.col("as_of"), "left_semi")
    part = cross.breadth(latest, ["index_name"]).drop("members")
    spin = indices.rotation(levels, "ASIA")
    return (size.join(indices.returns_from_level(levels, {"1D": 1, "1W": 5}).drop("date"), "index_name")
            .join(part, "index_name", "left").join(flow.drop("date"), "index_name").join(spin, "index_name", "left"))


MEMBER = ("mem0 AS (SELECT isin, min(date) AS from_date, list(date ORDER BY date) AS ds FROM bars GROUP BY 1), "
          "mem AS (SELECT r_name AS index_name, isin, isin AS symbol, isin AS name, n_nationkey, from_date, CASE WHEN n_nationkey % 3 = 0 THEN ds[len(ds) // 2 + 1] END AS to_date "
          "FROM mem0 JOIN nation ON n_name = isin JOIN region ON n_regionkey = r_regionkey)")
register("X12_index_analytics", "index_name:s members:i ret_1D:f3 above_50:n advancing:n share_pct:f4 wow_pp:f4 quadrant:s", _analytics,
         f"WITH {BARS}, {MEMBER}, ao AS (SELECT max(date) AS d FROM bars), lm AS (SELECT index_name, isin FROM mem, ao WHERE from_date <= d AND (to_date IS NULL OR to_date > d)), "
         f"lv0 AS (SELECT *, adj_close / {lag('adj_close')} - 1 AS ret, {SMA[50]} AS s50 FROM bars), "
         "lv1 AS (SELECT index_name, date, avg(ret) AS mr, sum(turnover) AS mine FROM lv0 JOIN lm USING (isin) GROUP BY 1, 2), "
         "lv2 AS (SELECT *, sum(ln(1 + coalesce(mr, 0))) OVER (PARTITION BY index_name ORDER BY date) AS lg, sum(mine) OVER (PARTITION BY date) AS total, "
         "row_number() OVER (PARTITION BY index_name ORDER BY date DESC) AS back FROM lv1), sh AS (SELECT *, mine / total * 100 AS share FROM lv2), "
         + ROTATION.split(LEVEL + ", ")[1]
         + f", pt AS (SELECT index_name, count(*) FILTER (adj_close > s50) AS above_50, count(*) FILTER (ret > 0) AS advancing FROM lv0 JOIN lm USING (isin), ao WHERE date = d GROUP BY 1) "
         f"@@ SELECT a.index_name, (SELECT count(*) FROM lm WHERE lm.index_name = a.index_name) AS members, (exp(a.lg - b.lg) - 1) * 100 AS ret_1D, above_50, advancing, "
         f"a.share AS share_pct, {_span('share', 5)} - {_span('share', 5, 5)} AS wow_pp, q.quadrant "
         f"FROM sh a JOIN sh b ON b.index_name = a.index_name AND b.back = 2 LEFT JOIN pt ON pt.index_name = a.index_name "
         f"LEFT JOIN (SELECT index_name, {QUADRANT} AS quadrant FROM rr WHERE back = 1) q ON q.index_name = a.index_name WHERE a.back = 1")


def index_bars(s, d, bars=None):
    """Region series standing in for published indices: mean close, high and low of the members."""
    return (panels.week_panel(s, d) if bars is None else bars).join(panels.region_map(s, d), "isin").groupBy("index_name", "date").agg(
        F.avg("adj_close").alias("close"), F.avg("adj_high").alias("high"), F.avg("adj_low").alias("low"))


IX = ("ix AS MATERIALIZED (SELECT r_name AS index_name, date, avg(adj_close) AS close, avg(adj_high) AS high, avg(adj_low) AS low, "
      "row_number() OVER (PARTITION BY r_name ORDER BY date) AS i FROM bars JOIN nation ON n_name = isin JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)")
VIX = ("vx AS (SELECT a.date, a.close AS mkt_vix, CASE WHEN a.i >= 252 THEN (count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2.0) / 252 * 100 END AS mkt_vix_pctile_1y "
       "FROM ix a JOIN ix b ON b.index_name = a.index_name AND b.i BETWEEN a.i - 251 AND a.i WHERE a.index_name = 'AFRICA' GROUP BY a.date, a.close, a.i), "
       f"nf AS (SELECT date, ({roll('max', 'high', 20, over='ORDER BY date')} / {roll('min', 'low', 20, over='ORDER BY date')} - 1) * 100 AS mkt_nifty_range_20d FROM ix WHERE index_name = 'ASIA')")
register("X13_index_columns", "date:d mkt_vix:f4 mkt_vix_pctile_1y:f4 mkt_nifty_range_20d:f4",
         lambda s, d: market.index_columns(index_bars(s, d), "AFRICA", "ASIA"),
         f"WITH {BARS}, {IX}, {VIX} @@ SELECT * FROM vx FULL JOIN nf USING (date)")
GATE = f"""{DAY}, zr AS (SELECT i, date, b50, adv * 1.0 / nullif(adv + dec, 0) AS a, row_number() OVER (ORDER BY date) AS j FROM dy WHERE adv + dec > 0),
zw AS (SELECT j, i, a AS e FROM zr WHERE j = 1 UNION ALL SELECT n.j, n.i, w.e * (9.0 / 11) + n.a * (2.0 / 11) FROM zw w JOIN zr n ON n.j = w.j + 1),
hy AS (SELECT i, b50, CASE WHEN b50 IS NULL THEN NULL WHEN b50 > 50 THEN 1 ELSE 0 END AS st FROM dy WHERE i = 1
  UNION ALL SELECT d.i, d.b50, CASE WHEN d.b50 IS NULL THEN h.st WHEN h.st IS NULL THEN CASE WHEN d.b50 > 50 THEN 1 ELSE 0 END
    WHEN h.st = 1 AND d.b50 < 40 THEN 0 WHEN h.st = 0 AND d.b50 > 50 THEN 1 ELSE h.st END FROM hy h JOIN dy d ON d.i = h.i + 1),
ze AS (SELECT dy.date, dy.i, dy.b50, e, CASE WHEN hy.b50 IS NOT NULL THEN st END AS hysteresis,
  min(e) OVER (ORDER BY dy.i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mn FROM dy JOIN hy ON hy.i = dy.i LEFT JOIN zw ON zw.i = dy.i),
gt0 AS (SELECT *, CASE WHEN i > 10 AND e > 0.615 AND mn < 0.40 THEN 1 ELSE 0 END AS thrust FROM ze),
gt AS MATERIALIZED (SELECT *, max(thrust) OVER (ORDER BY i ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS thrust_on FROM gt0),
gate AS MATERIALIZED (SELECT *, b50 AS mkt_breadth_50, CASE WHEN hysteresis = 1 OR thrust_on = 1 THEN 1 ELSE 0 END AS mkt_gate_on FROM gt)"""


def _gate(s, d):
    return market.gate_series(market.advance_decline(build_features(panels.week_panel(s, d), ["sma_50"])))


register("X14_hysteresis_gate", "date:d b50:f4 hysteresis:n", _gate, f"WITH RECURSIVE {BARS}, {GATE} @@ SELECT * FROM gate")
register("X15_thrust_window", "date:d zweig_ema:f6 thrust:i thrust_on:i", _gate, f"WITH RECURSIVE {BARS}, {GATE} @@ SELECT *, e AS zweig_ema FROM gate WHERE e IS NOT NULL OR TRUE")
register("X16_market_gate", "date:d mkt_breadth_50:f4 mkt_gate_on:i", _gate, f"WITH RECURSIVE {BARS}, {GATE} @@ SELECT * FROM gate")
register("J2_broadcast_market", KEY + "mkt_gate_on:i",
         lambda s, d: market.attach_market(panels.week_panel(s, d), _gate(s, d).select("date", "mkt_gate_on")),
         f"WITH RECURSIVE {BARS}, {GATE} @@ SELECT isin, bars.date, mkt_gate_on FROM bars JOIN gate USING (date)")
register("J5_outer_date_join", "date:d mkt_vix:f4 mkt_gate_on:n",
         lambda s, d: market.index_columns(index_bars(s, d), "AFRICA", "ASIA").filter(F.year("date") % 2 == 0).join(_gate(s, d).filter(F.month("date") > 3), "date", "full"),
         f"WITH RECURSIVE {BARS}, {IX}, {VIX}, {GATE}, a AS (SELECT date, mkt_vix FROM vx WHERE year(date) % 2 = 0), b AS (SELECT date, mkt_gate_on FROM gate WHERE month(date) > 3) "
         "@@ SELECT * FROM a FULL JOIN b USING (date)")
OSC = (GATE + """, ra AS (SELECT i, date, (adv - dec) * 1.0 / (adv + dec) AS nt, row_number() OVER (ORDER BY date) AS j FROM dy WHERE adv + dec > 0),
mc AS (SELECT j, i, nt, nt * 1000 AS a, nt * 1000 AS b FROM ra WHERE j = 1 UNION ALL SELECT n.j, n.i, n.nt, w.a * 0.9 + n.nt * 100, w.b * 0.95 + n.nt * 50 FROM mc w JOIN ra n ON n.j = w.j + 1),
os AS (SELECT dy.*, a - b AS mcc_osc, nt FROM dy LEFT JOIN mc USING (i)),
ot AS (SELECT *, sum(mcc_osc) OVER (ORDER BY i) AS mcc_sum, sum(nt) OVER (ORDER BY i) AS ad_line,
"""
       + roll("avg", "new_hi_minus_lo", 10, over="ORDER BY i") + " AS nhnl_10, " + roll("avg", "new_hi_minus_lo", 20, 15, over="ORDER BY i") + " AS nhnl_20 FROM os)")
# The first session has no previous close, so its oscillator is unknown and starts one row later.
register("X17_oscillators", "date:d mcc_osc:f4 mcc_sum:f4 ad_line:f5 nhnl_10:f4 nhnl_20:f4",
         lambda s, d: market.oscillators(cross.breadth_series(_f(s, d))).filter("mcc_osc is not null"),
         f"WITH RECURSIVE {BARS}, {OSC} @@ SELECT * FROM ot WHERE mcc_osc IS NOT NULL")
register("X18_sustained_gate", "date:d b50_sustained_on:n",
         lambda s, d: market.sustained_gate(cross.breadth_series(_f(s, d)), 3),
         f"WITH {BARS}, {DAY}, t AS (SELECT *, CASE WHEN b50 < 50 THEN 1 WHEN b50 IS NOT NULL THEN 0 END AS lo FROM dy), u AS (SELECT *, {roll('sum', 'lo', 3, over='ORDER BY date')} AS s FROM t) "
         "@@ SELECT date, CASE WHEN s IS NOT NULL THEN CASE WHEN s < 3 THEN 1 ELSE 0 END END AS b50_sustained_on FROM u")
register("X20_regime_flags", "date:d ew_above_50:i ew_above_200:i breadth_half:i",
         lambda s, d: cross.market_return_flags(cross.breadth_series(_f(s, d))),
         f"WITH {BARS}, {DAY}, t AS (SELECT *, exp(ew_log) AS l FROM dy) @@ SELECT date, CASE WHEN l > {roll('avg', 'l', 50, over='ORDER BY date')} THEN 1 ELSE 0 END AS ew_above_50, "
         f"CASE WHEN l > {roll('avg', 'l', 200, over='ORDER BY date')} THEN 1 ELSE 0 END AS ew_above_200, CASE WHEN b50 > 50 THEN 1 ELSE 0 END AS breadth_half FROM t")


def _washout(s, d):
    bars = panels.stored_week_panel(s, d)
    panel = market.low_age(build_features(bars, ["low_52w", "high_52w"]))
    state = market.washout(cross.breadth_series(build_features(bars, _BF))).select("date", "mkt_washout")
    return market.attach_market(panel, state)


register("X21_washout", KEY + "mkt_washout:f4 bars_since_52w_low:n dd_depth_52w:f4", _washout,
         f"WITH {BARS}, {DAY}, wo AS (SELECT date, {roll('min', 'b50', 20, 5, over='ORDER BY date')} AS mkt_washout FROM dy), "
         f"lw AS (SELECT *, {HI52} AS h, {LO52} AS l FROM bars), lx AS (SELECT *, r - max(CASE WHEN adj_low <= l + 1e-9 THEN r END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ago FROM lw) "
         "@@ SELECT isin, lx.date, mkt_washout, CASE WHEN ago IS NOT NULL THEN least(ago, 250) END AS bars_since_52w_low, (l / h - 1) * 100 AS dd_depth_52w FROM lx JOIN wo USING (date)")
register("W2b_adjusted_ewm", "date:d breadth_thrust_10:f5",
         lambda s, d: market.breadth_thrust(cross.breadth_series(_f(s, d))),
         f"WITH {BARS}, {DAY} @@ SELECT a.date, sum(b.adv_ratio * pow(9.0 / 11, a.i - b.i)) / sum(pow(9.0 / 11, a.i - b.i)) AS breadth_thrust_10 FROM dy a JOIN dy b ON b.i <= a.i GROUP BY a.date")


def _ten(s, d):
    x = index_bars(s, d).filter(F.col("index_name") == "ASIA").select("date", "close")
    return market.ten_month_average(x)


register("W25_ten_month", "date:d faber_sma10m:f4 above_10m:n", _ten,
         f"WITH {BARS}, {IX}, a AS (SELECT *, date_trunc('month', date) AS mo FROM ix WHERE index_name = 'ASIA'), e AS (SELECT mo, arg_max(close, date) AS c FROM a GROUP BY 1), "
         "n AS (SELECT mo, CASE WHEN count(c) OVER w = 9 THEN sum(c) OVER w END AS s FROM e WINDOW w AS (ORDER BY mo ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)) "
         "@@ SELECT date, (s + close) / 10 AS faber_sma10m, CASE WHEN s IS NOT NULL THEN CASE WHEN close > (s + close) / 10 THEN 1 ELSE 0 END END AS above_10m FROM a JOIN n USING (mo)")
CAL = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE isodow(l_shipdate) < 6)"


def _calendar(s, d):
    days = panels.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return market.calendar_flags(days.filter(F.weekday("date") < 5))


register("L6_calendar_flags", "date:d turn_of_month:i expiry_week:i earnings_season:i", _calendar,
         f"WITH {CAL}, m AS (SELECT *, date_trunc('month', date) AS mo FROM cal), p AS (SELECT *, row_number() OVER (PARTITION BY mo ORDER BY date) AS a, "
         "row_number() OVER (PARTITION BY mo ORDER BY date DESC) AS b FROM m), t AS (SELECT mo, max(date) AS thu FROM m WHERE isodow(date) = 4 GROUP BY 1) "
         "@@ SELECT date, CASE WHEN a <= 3 OR b <= 2 THEN 1 ELSE 0 END AS turn_of_month, CASE WHEN EXISTS (SELECT 1 FROM t WHERE thu - p.date BETWEEN 0 AND 4) THEN 1 ELSE 0 END AS expiry_week, "
         "CASE WHEN (day(date) BETWEEN 12 AND 31 AND month(date) IN (1, 4, 7, 10)) OR (day(date) <= 15 AND month(date) IN (2, 5, 8, 11)) THEN 1 ELSE 0 END AS earnings_season FROM p")
register("L7_week_end", "date:d week_end:i", _calendar,
         f"WITH {CAL} @@ SELECT date, CASE WHEN coalesce(date_trunc('week', lead(date) OVER (ORDER BY date)) <> date_trunc('week', date), true) THEN 1 ELSE 0 END AS week_end FROM cal")
register("P8_date_parts", "date:d dow:i month:i iso_week:i iso_year:i quarter:i year:i", _calendar,
         f"WITH {CAL} @@ SELECT date, isodow(date) - 1 AS dow, month(date) AS month, week(date) AS iso_week, isoyear(date) AS iso_year, quarter(date) AS quarter, year(date) AS year FROM cal")
