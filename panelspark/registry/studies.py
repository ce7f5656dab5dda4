"""Allocation, validation, gate and composed study queries."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.order_stats import quantiles
from ..operators import allocation as al, cross, filter_lattice as fl, gate_study as gs, gates, market, outcomes as oc, rules as ro, setups, stats, validation as va
from ..operators.features import build_features
from ..session import cut_lineage
from ..sources import panels
from .base import BARS, register, roll
from .cross import _BF, CAL, IX, OSC, index_bars
from .outcomes import ALL, CELL_SQL, CELLS, COLUMNS, LOW, RULE_SQL, SESS, SIMPLE, SIMPLE_SQL, TK, WIDE, _panel, cell_sql, positioned, reversal_trades, sessions, signals, tagged
from .windows import KEY

SPLIT = "1998-06-01"


def trade_set(s, d):
    """Materialised non-overlapping trades with session numbers, halves and signal-day features."""
    panel, trades = sessions(s, d)
    half = F.when(F.col("date") < F.lit(SPLIT).cast("date"), "H1").otherwise("H2")
    return panel, cut_lineage(trades.withColumns({"half": half, "scenario": F.lit("double_seven"), "breadth": F.lit(55.0)}))


TS = SESS + f", fx AS MATERIALIZED (SELECT te.*, q1.vol_ratio, q1.rsi_14, q1.atr_pct, CASE WHEN te.date < DATE '{SPLIT}' THEN 'H1' ELSE 'H2' END AS half FROM te JOIN q1 ON q1.isin = te.isin AND q1.r = te.t)"
FEATURES = ["vol_ratio", "rsi_14", "atr_pct"]
LONG_SQL = "lg AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT isin, t, date, half, net, '{f}' AS feature, {f} AS x FROM fx" for f in FEATURES) + ")"


def _long(trades):
    return va.unpivot_features(trades, FEATURES, ["sid", "isin", "date", "half", "net"])


# ------------------------------------------------------------------ allocation
CURVE = "scenario:s session_i:i equity:f4 n_open:i"
TEN = al.Book(slots=5)


def _queue(trades, book=TEN):
    return al.candidates(trades, book, F.col("rsi_14"))


register("K1_equal_slots", CURVE, lambda s, d: al.equity_curve(_queue(trade_set(s, d)[1]), TEN))
RISK = al.Book(slots=5, sizing="risk", risk_per_trade=1.0, max_weight=0.25)


def _with_risk(trades):
    return trades.withColumn("risk_pct", F.least(F.greatest(F.col("atr_pct") / 10, F.lit(1.0)), F.lit(20.0)))


register("K2_risk_sizing", "scenario:s max_open_risk:f4 avg_open_risk:f4 sessions_loaded:i avg_open:f4",
         lambda s, d: al.open_risk_summary(al.equity_curve(al.candidates(_with_risk(trade_set(s, d)[1]), RISK, F.col("rsi_14")), RISK), 5))


def _marked(s, d):
    panel, trades = trade_set(s, d)
    book = replace(TEN, settle="same")
    calendar = oc.session_index(panel)
    closes = panel.join(F.broadcast(calendar), "date").select("isin", "session_i", F.col("adj_close").alias("close"))
    return al.equity_curve(al.with_marks(_queue(trades, book), closes), book)


register("K3_mark_to_market", CURVE, _marked)


def _overlays(s, d):
    _, trades = trade_set(s, d)
    ten = replace(TEN, settle="same")  # a place is free again on the exit session
    books = {"one_new": replace(ten, max_new=1), "top2": replace(ten, top_per_day=2), "pause": replace(ten, pause_after=3),
             "win_floor": replace(ten, win_floor=0.4), "halve": replace(ten, halve_at=0.1), "breadth": replace(al.Book(slots=10, settle="same"), breadth_slots=True)}
    parts = None
    for name, book in books.items():
        one = al.metrics(al.equity_curve(_queue(trades.withColumn("scenario", F.lit(name)), book), book))
        parts = one if parts is None else parts.unionByName(one)
    return parts


register("K4_overlays", "scenario:s total:f3 cagr:f3 maxdd:f4 years:f4", _overlays)
register("K5_top_k_holding", "scenario:s sid:s", lambda s, d: al.top_k_with_holding(trade_set(s, d)[1], -F.col("rsi_14"), 2))


def _metrics(s, d):
    panel, trades = trade_set(s, d)
    curve = cut_lineage(al.equity_curve(_queue(trades), TEN))
    return al.year_table(curve, oc.session_index(panel))


register("K6_year_table", "scenario:s period:d last:f4 ret:f4 max_dd_pct:f4", _metrics)
register("K7_stress", "scenario:s full:f3 h1:f3 h2:f3 random_mean:f3 random_worst:f3 random_p5:f3 random_p95:f3 robust:i",
         lambda s, d: al.stress(trade_set(s, d)[1], TEN, "rsi_14", SPLIT, draws=100))


def _random_top(s, d):
    """Mean net of random top-2-per-day selections over many draws."""
    _, trades = trade_set(s, d)
    drawn = al.random_orders(trades, 200)
    chosen = al.top_k_with_holding(drawn, F.col("luck").cast("double"), 2)
    return chosen.join(trades.select("sid", "net"), "sid").groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("net"))


register("K8_random_baseline", "scenario:s n:i net:f3", _random_top)


def _scored_slots(s, d):
    _, trades = trade_set(s, d)
    scored = cross.composite_score(trades, {"rsi_14": -1, "vol_ratio": 1}, ["sid"])
    book = al.Book(slots=5, allow_partial=True)
    return al.metrics(al.equity_curve(al.candidates(scored, book, -F.col("score")), book))


register("K9_scored_slots", "scenario:s total:f3 cagr:f3 maxdd:f4 years:f4", _scored_slots)

# ------------------------------------------------------------------ validation
register("V1_split_scores", "isin:s n_is:i n_oos:i is_mean:f3 oos_mean:f3 degradation:f3 is_rank:i oos_rank:i",
         lambda s, d: va.split_scores(trade_set(s, d)[1], ["isin"], "net", F.col("half") == "H1"),
         TS + ", z AS (SELECT isin, count(*) FILTER (half = 'H1') AS n_is, count(*) FILTER (half = 'H2') AS n_oos, avg(net) FILTER (half = 'H1') AS is_mean, avg(net) FILTER (half = 'H2') AS oos_mean FROM fx GROUP BY 1) "
         "@@ SELECT *, is_mean - oos_mean AS degradation, row_number() OVER (ORDER BY is_mean DESC NULLS LAST, isin) AS is_rank, row_number() OVER (ORDER BY oos_mean DESC NULLS LAST, isin) AS oos_rank FROM z")
register("V2_clustered_slope", "half:s n:i clusters:i slope:f4 t_cluster:f4", lambda s, d: va.clustered_slope(trade_set(s, d)[1], ["half"], "net", "rsi_14", "date"),
         TS + ", k AS (SELECT * FROM fx WHERE rsi_14 IS NOT NULL), m AS (SELECT half, count(*) AS n, regr_slope(net, rsi_14) AS b, regr_intercept(net, rsi_14) AS a, sum(rsi_14) AS sx, sum(rsi_14 * rsi_14) AS sxx FROM k GROUP BY 1), "
         "u AS (SELECT k.half, date, sum(net - a - b * rsi_14) AS u0, sum((net - a - b * rsi_14) * rsi_14) AS u1 FROM k JOIN m USING (half) GROUP BY 1, 2) "
         "@@ SELECT m.half, min(n) AS n, count(*) AS clusters, min(b) AS slope, min(b) / sqrt(sum(pow((n * u1 - sx * u0) / (n * sxx - sx * sx), 2))) AS t_cluster FROM u JOIN m USING (half) GROUP BY 1")
register("V3_clustered_mean", "half:s days:i mean:f3 t:f4", lambda s, d: va.clustered_mean(trade_set(s, d)[1], ["half"], "net"),
         TS + ", k AS (SELECT half, date, avg(net) AS m FROM fx GROUP BY 1, 2) @@ SELECT half, count(*) AS days, avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM k GROUP BY 1")
_RK = "(rank() OVER (PARTITION BY half ORDER BY {x}) + (count(*) OVER (PARTITION BY half, {x}) - 1) / 2.0)"
register("V4_spearman", "half:s n:i rho:f6", lambda s, d: va.spearman(trade_set(s, d)[1], ["sid"], ["half"], "rsi_14", "net"),
         TS + f", k AS (SELECT half, {_RK.format(x='rsi_14')} AS a, {_RK.format(x='net')} AS b FROM fx WHERE rsi_14 IS NOT NULL) @@ SELECT half, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY 1")
register("V4_welch", "half:s n1:i n0:i diff:f3 welch_t:f4", lambda s, d: va.welch(trade_set(s, d)[1], ["half"], "net", F.col("vol_ratio") > 1),
         TS + "@@ SELECT half, count(*) FILTER (vol_ratio > 1) AS n1, count(*) FILTER (vol_ratio <= 1) AS n0, avg(net) FILTER (vol_ratio > 1) - avg(net) FILTER (vol_ratio <= 1) AS diff, "
         "(avg(net) FILTER (vol_ratio > 1) - avg(net) FILTER (vol_ratio <= 1)) / sqrt(var_samp(net) FILTER (vol_ratio > 1) / count(*) FILTER (vol_ratio > 1) + var_samp(net) FILTER (vol_ratio <= 1) / count(*) FILTER (vol_ratio <= 1)) AS welch_t FROM fx GROUP BY 1")
INNER = [0.2, 0.4, 0.6, 0.8]


def _binned(s, d):
    long = _long(trade_set(s, d)[1]).withColumn("period", F.when(F.col("half") == "H1", "IS").otherwise("OOS"))
    return va.with_bins(long, va.bin_edges(long, INNER, F.col("half") == "H1"))


BINS = TS + f", {LONG_SQL}, eg AS (SELECT feature, list_distinct([" + ", ".join(f"quantile_cont(x, {p})" for p in INNER) + "]) AS e FROM lg WHERE half = 'H1' GROUP BY 1), " \
    "bn AS MATERIALIZED (SELECT lg.*, CASE WHEN half = 'H1' THEN 'IS' ELSE 'OOS' END AS period, CASE WHEN x IS NOT NULL THEN len(list_filter(e, lambda v: v < x)) + 1 END AS bin FROM lg JOIN eg USING (feature))"
register("V5_in_sample_bins", "feature:s bin:i period:s n:i", lambda s, d: _binned(s, d).filter("bin is not null").groupBy("feature", "bin", "period").agg(F.count(F.lit(1)).alias("n")),
         BINS + "@@ SELECT feature, bin, period, count(*) AS n FROM bn WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
TABLE_COLUMNS = "feature:s period:s bin:i n:i net:f3 win:f4 pf:f4 big_loss:f4 low:f4 high:f4"
TABLE_SQL = ("SELECT feature, period, bin, count(*) AS n, avg(net) AS net, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS win, sum(greatest(net, 0)) / nullif(sum(greatest(-net, 0)), 0) AS pf, "
             "avg(CASE WHEN net < -8 THEN 100.0 ELSE 0 END) AS big_loss, min(x) AS low, max(x) AS high FROM bn WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
register("V6_feature_table", TABLE_COLUMNS, lambda s, d: va.feature_table(_binned(s, d)), BINS + "@@ " + TABLE_SQL)


def _promotion(s, d):
    binned = cut_lineage(_binned(s, d))
    rho = va.spearman(binned, ["sid", "feature"], ["feature", "period"], "x", "net")
    return va.promotion(rho, va.monotonicity(va.feature_table(binned)))


register("V6_promotion", "feature:s passes_is_only:i promoted:i direction:n", _promotion)
register("V7_monotone_table", "feature:s period:s bins:i mono:f4 top_minus_bottom:f3", lambda s, d: va.monotonicity(va.feature_table(_binned(s, d))),
         BINS + f", tb AS ({TABLE_SQL}), rk AS (SELECT *, rank() OVER (PARTITION BY feature, period ORDER BY net) AS a FROM tb) "
         "@@ SELECT feature, period, count(*) AS bins, corr(a, bin) AS mono, arg_max(net, bin) - arg_min(net, bin) AS top_minus_bottom FROM rk GROUP BY 1, 2")
register("V8_binary_table", "half:s n_on:i n_off:i diff:f3 t_cluster:f4",
         lambda s, d: (lambda t: va.clustered_slope(t, ["half"], "net", "x", "date").join(t.groupBy("half").agg(F.count_if(F.col("x") == 1).alias("n_on"), F.count_if(F.col("x") == 0).alias("n_off")), "half").withColumnRenamed("slope", "diff"))(
             trade_set(s, d)[1].withColumn("x", (F.col("vol_ratio") > 1).cast("int"))),
         TS + ", k AS (SELECT half, date, net, CASE WHEN vol_ratio > 1 THEN 1.0 ELSE 0 END AS x FROM fx WHERE vol_ratio IS NOT NULL), m AS (SELECT half, count(*) AS n, regr_slope(net, x) AS b, regr_intercept(net, x) AS a, sum(x) AS sx, sum(x * x) AS sxx FROM k GROUP BY 1), "
         "u AS (SELECT k.half, date, sum(net - a - b * x) AS u0, sum((net - a - b * x) * x) AS u1, count(*) FILTER (x = 1) AS c1, count(*) FILTER (x = 0) AS c0 FROM k JOIN m USING (half) GROUP BY 1, 2) "
         "@@ SELECT m.half, sum(c1) AS n_on, sum(c0) AS n_off, min(b) AS diff, min(b) / sqrt(sum(pow((n * u1 - sx * u0) / (n * sxx - sx * sx), 2))) AS t_cluster FROM u JOIN m USING (half) GROUP BY 1")
register("V9_day_level", "date:d n:i net:f3 win:f4", lambda s, d: trade_set(s, d)[1].groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("net"), stats.share(F.col("net") > 0).alias("win")),
         TS + "@@ SELECT date, count(*) AS n, avg(net) AS net, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS win FROM fx GROUP BY 1")


def _search(s, d):
    _, trades = trade_set(s, d)
    long = _long(trades)
    tests = va.threshold_candidates(long, INNER, F.col("half") == "H1")
    return trades, long, tests


CAND = BINS.split(", eg AS")[0] + ", ca AS (SELECT feature, unnest(list_distinct([" + ", ".join(f"quantile_cont(x, {p})" for p in INNER) + "])) AS thr FROM lg WHERE half = 'H1' GROUP BY 1), cb AS (SELECT feature, thr, op FROM ca, (VALUES ('>='), ('<=')) o(op)), " \
    "ck AS MATERIALIZED (SELECT lg.*, thr, op, coalesce(CASE op WHEN '>=' THEN x >= thr ELSE x <= thr END, false) AS keep FROM lg JOIN cb USING (feature))"


def _results(s, d):
    trades, long, tests = _search(s, d)
    out = va.evaluate_filters(trades, long, tests)
    return out.join(tests.select("candidate", "op", "threshold"), "candidate")


register("V10_filter_search", "feature:s op:s threshold:f4 half:s n_all:i n_kept:i mean_kept:f3 win_kept:f5 mean_removed:f3 pf_kept:f4", _results,
         CAND + "@@ SELECT feature, op, thr AS threshold, half, count(*) AS n_all, count(*) FILTER (keep) AS n_kept, avg(net) FILTER (keep) AS mean_kept, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) FILTER (keep) AS win_kept, "
         "avg(net) FILTER (NOT keep) AS mean_removed, sum(net) FILTER (keep AND net > 0) / -(sum(net) FILTER (keep AND net <= 0)) AS pf_kept FROM ck GROUP BY 1, 2, 3, 4")


def _leaders(s, d):
    trades, long, tests = _search(s, d)
    tests = cut_lineage(tests)
    passing = va.passing_filters(va.evaluate_filters(trades, long, tests), va.base_rates(trades), least=20)
    best = cut_lineage(va.best_per_feature(passing))
    kept = va.kept_by_candidate(long, tests.join(best.select("candidate"), "candidate", "left_semi"))
    pairs = va.evaluate_pairs(kept, va.pair_candidates(best))
    singles = kept.groupBy("candidate", "half").agg(F.count(F.lit(1)).alias("n_kept"), F.avg("net").alias("mean_kept"), F.avg((F.col("net") > 0).cast("double")).alias("win_kept"))
    return singles.unionByName(pairs)


register("V10_filter_leaders", "candidate:s half:s n_kept:i mean_kept:f3 win_kept:f5", _leaders)


LATTICE_RULE = fl.Rule(least_per_month=0.5)  # the fixture has few trades a month
BAD, GOOD = -5.0, 3.0


def _lattice(s, d):
    """Every filter at the in-sample median of its feature, and their combinations of two and three."""
    trades, long, _ = _search(s, d)
    tests = va.threshold_candidates(long, [0.5], F.col("half") == "H1").withColumn("candidate", F.concat_ws(" ", "feature", "op"))
    leaders = cut_lineage(fl.numbered(tests.select("candidate"), ["candidate"]))
    flagged = trades.select("sid", "half", "date", "net", (F.col("net") < BAD).alias("bad"), (F.col("net") > GOOD).alias("good"))
    return cut_lineage(fl.combinations(fl.masked(flagged, va.kept_by_candidate(long, tests), leaders), leaders, LATTICE_RULE))


_SIX = [f"{f} {op}" for f in sorted(FEATURES) for op in ("<=", ">=")]
_COMBOS = [c for k in (1, 2, 3) for c in itertools.combinations(_SIX, k)]
LATTICE = (TS + ", " + LONG_SQL + ", ca AS (SELECT feature, quantile_cont(x, 0.5) AS thr FROM lg WHERE half = 'H1' GROUP BY 1), ck AS MATERIALIZED (SELECT lg.isin, lg.t, feature || ' ' || op AS candidate, "
           "coalesce(CASE op WHEN '>=' THEN x >= thr ELSE x <= thr END, false) AS keep FROM lg JOIN ca USING (feature), (VALUES ('>='), ('<=')) o(op)), cm(filter, k, candidate) AS (VALUES "
           + ", ".join(f"('{' AND '.join(c)}', {len(c)}, '{x}')" for c in _COMBOS for x in c)
           + "), kp AS (SELECT filter, k, isin, t, bool_and(keep) AS m FROM cm JOIN ck USING (candidate) GROUP BY 1, 2, 3, 4), ag AS (SELECT half, count(*) AS n_all, avg(net) AS bm, avg((net > 0)::INT) AS bw, count(*) FILTER (net < -5) AS ab, count(*) FILTER (net > 3) AS ag, "
           "greatest(date_diff('day', min(date), max(date)) / 30.44, 1.0) AS months FROM fx GROUP BY 1), "
           "rs AS (SELECT filter, k, half, count(*) FILTER (m) AS n_kept, avg((net > 0)::INT) FILTER (m) AS win_kept, avg(net) FILTER (m) AS mean_kept, avg((net < -5)::INT) FILTER (m) AS bad_kept, avg((net > 0)::INT) FILTER (NOT m) AS win_removed, "
           "avg(net) FILTER (NOT m) AS mean_removed, count(*) FILTER (NOT m AND net < -5) AS lb, count(*) FILTER (NOT m AND net > 3) AS lgd FROM kp JOIN fx ON fx.isin = kp.isin AND fx.t = kp.t GROUP BY 1, 2, 3), "
           "rr AS MATERIALIZED (SELECT rs.*, n_all, n_kept * 1.0 / n_all AS kept_pct, n_kept / months AS kept_per_month, lb * 1.0 / greatest(ab, 1) AS bad_removed_share, lgd * 1.0 / greatest(ag, 1) AS good_removed_share, "
           "CASE WHEN lb > 0 THEN lgd * 1.0 / lb END AS cost, ag * 1.0 / greatest(ab, 1) AS cost_by_chance, win_kept > bw AND mean_kept > bm AND n_kept >= 30 AND n_kept / months >= 0.5 AND lgd * 1.0 / nullif(lb, 0) < ag * 1.0 / greatest(ab, 1) AS ok FROM rs JOIN ag USING (half)), "
           "ps AS MATERIALIZED (SELECT rr.*, CASE WHEN count(*) FILTER (coalesce(ok, false)) OVER (PARTITION BY filter) = 2 THEN 1 ELSE 0 END AS passes FROM rr)")
register("V10_filter_lattice", "filter:s k:i half:s n_all:i n_kept:i kept_pct:f4 kept_per_month:f4 win_kept:f5 mean_kept:f3 bad_kept:f5 win_removed:f5 mean_removed:f3 bad_removed_share:f5 good_removed_share:f5 cost:f4 cost_by_chance:f4 passes:i", _lattice,
         LATTICE + "@@ SELECT * FROM ps")


def _active(s, d):
    trades, long, tests = _search(s, d)
    return va.months_active(va.kept_by_candidate(long, tests), trades, 5).join(tests.select("candidate", "feature", "op", "threshold"), "candidate")


register("V11_months_active", "feature:s op:s threshold:f4 months_active:f5", _active,
         CAND + ", mo AS (SELECT feature, op, thr, date_trunc('month', date) AS m, count(*) AS k FROM ck WHERE keep GROUP BY 1, 2, 3, 4) @@ SELECT feature, op, thr AS threshold, count(*) FILTER (k >= 5) * 1.0 / (SELECT count(DISTINCT date_trunc('month', date)) FROM fx) AS months_active FROM mo GROUP BY 1, 2, 3")


def _state(s, d):
    bars = panels.stored_week_panel(s, d)
    ix = cut_lineage(index_bars(s, d, bars))
    pick = lambda n: ix.filter(F.col("index_name") == n).drop("index_name")
    state = gates.index_state(pick("ASIA"), pick("EUROPE"), pick("AFRICA"))
    for name, out in (("ASIA", "nifty_gt_10m_sma"), ("EUROPE", "mid_gt_10m_sma")):
        state = state.join(market.ten_month_average(pick(name).select("date", "close")).select("date", F.col("above_10m").alias(out)), "date", "left")
    day = cut_lineage(market.sustained_gate(market.oscillators(market.gate_series(cross.breadth_series(build_features(bars, _BF))))))
    flags = market.calendar_flags(day.select("date")).select("date", "expiry_week", "turn_of_month", "earnings_season")
    return cut_lineage(state.join(gates.breadth_state(day), "date", "left").join(flags, "date", "left"))


def _gates(s, d):
    return gates.gate_table(_state(s, d), F.col("date") < F.lit(SPLIT).cast("date"))


XG = (f"WITH RECURSIVE {BARS}, {IX}, {OSC}, a AS (SELECT *, row_number() OVER (ORDER BY date) AS j FROM ix WHERE index_name = 'ASIA'), v AS (SELECT * FROM ix WHERE index_name = 'AFRICA'), "
      f"mm AS (SELECT a.date, a.close > {roll('avg', 'close', 50, over='ORDER BY date')} AS above50, (a.close / ({roll('max', 'close', 252, over='ORDER BY date')}) - 1) * 100 AS dd, a.close / lag(a.close, 126) OVER (ORDER BY date) - 1 AS r126 FROM a), "
      f"vv AS (SELECT date, close / ({roll('avg', 'close', 20, over='ORDER BY date')}) - 1 AS v20, (close - {roll('avg', 'close', 60, over='ORDER BY date')}) / ({roll('stddev_samp', 'close', 60, over='ORDER BY date')}) AS z FROM v), "
      f"zq AS (SELECT quantile_cont(z, 0.5) AS q FROM vv WHERE date < DATE '{SPLIT}')")
_ONOFF = "CASE WHEN {c} IS NULL THEN NULL WHEN {e} THEN 1 ELSE 0 END"
register("X19_gate_catalogue", "gate:s date:d on_value:n",
         lambda s, d: _gates(s, d).filter(F.col("gate").isin("nifty_above_50dma", "not_deep_drawdown", "abs_mom_6m", "vix_below_20dma", "vix_z60_low", "breadth50_hysteresis", "mcclellan_osc_pos", "zweig_thrust_window", "breadth50_gt_50")).withColumnRenamed("on", "on_value"),
         XG + "@@ " + " UNION ALL ".join(f"SELECT '{g}' AS gate, date, {_ONOFF.format(c=c, e=e)} AS on_value FROM {t}" for g, c, e, t in (
             ("nifty_above_50dma", "above50", "above50", "mm"), ("not_deep_drawdown", "dd", "dd > -10", "mm"), ("abs_mom_6m", "r126", "r126 > 0", "mm"),
             ("vix_below_20dma", "v20", "v20 < 0", "vv"), ("vix_z60_low", "z", "z < q", "vv, zq"), ("breadth50_hysteresis", "hysteresis", "hysteresis > 0.5", "gate"),
             ("mcclellan_osc_pos", "mcc_osc", "mcc_osc > 0", "ot"), ("zweig_thrust_window", "thrust_on", "thrust_on > 0.5", "gate"), ("breadth50_gt_50", "b50", "b50 > 50", "dy"))))
register("X19_all_gates", "gate:s sessions:i share_on:f4", lambda s, d: va.time_in_market(_gates(s, d)))


def _gate_cells(s, d):
    _, trades = trade_set(s, d)
    return va.evaluate_gates(trades.withColumn("strategy", F.lit("double_seven")), _gates(s, d).filter(F.col("gate").isin("nifty_above_50dma", "vix_below_20dma", "breadth50_gt_50")))


register("V12_gate_evaluation", "gate:s half:s n_on:i n_off:i mean_on:f3 mean_off:f3 diff:f3", _gate_cells,
         TS.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ", " + XG.split(f"WITH RECURSIVE {BARS}, ")[1] + ", gg AS (" + " UNION ALL ".join(
             f"SELECT '{g}' AS gate, date, {_ONOFF.format(c=c, e=e)} AS g FROM {t}" for g, c, e, t in (("nifty_above_50dma", "above50", "above50", "mm"), ("vix_below_20dma", "v20", "v20 < 0", "vv"), ("breadth50_gt_50", "b50", "b50 > 50", "dy")))
         + ") @@ SELECT gate, half, count(*) FILTER (g = 1) AS n_on, count(*) FILTER (g = 0) AS n_off, avg(net) FILTER (g = 1) AS mean_on, avg(net) FILTER (g = 0) AS mean_off, avg(net) FILTER (g = 1) - avg(net) FILTER (g = 0) AS diff "
         "FROM fx JOIN gg USING (date) WHERE g IS NOT NULL GROUP BY 1, 2")
# ------------------------------------------------------------------ the gate study: every gate whose state SQL restates, two strategies
def _over(fn, x, n, least=None):
    return roll(fn, x, n, least, over="ORDER BY date")


STATE_SQL = (f"gm AS (SELECT date, close AS c, {_over('avg', 'close', 20)} AS m20, {_over('avg', 'close', 50)} AS m50, {_over('avg', 'close', 200)} AS m200, {_over('max', 'close', 252)} AS top, "
             f"({_over('max', 'high', 20)} / ({_over('min', 'low', 20)}) - 1) * 100 AS rng, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM ix WHERE index_name = 'ASIA'), "
             f"gr0 AS (SELECT *, {_over('stddev_samp', 'ret', 20)} * sqrt(252) * 100 AS rv20, {_over('stddev_samp', 'ret', 60)} * sqrt(252) * 100 AS rv60, m20 / lag(m20, 10) OVER (ORDER BY date) - 1 AS slope, "
             "c / lag(c, 252) OVER (ORDER BY date) - 1 AS r252, c / lag(c, 126) OVER (ORDER BY date) - 1 AS r126, c / lag(c, 20) OVER (ORDER BY date) - 1 AS r20, (c / top - 1) * 100 AS dd FROM gm), "
             f"gv AS (SELECT date, close AS v, {_over('avg', 'close', 10)} AS v10, {_over('avg', 'close', 20)} AS v20, {_over('avg', 'close', 50)} AS v50, lag(close, 10) OVER (ORDER BY date) AS l10, lag(close, 5) OVER (ORDER BY date) AS l5, "
             f"(close - {_over('avg', 'close', 60)}) / ({_over('stddev_samp', 'close', 60)}) AS z FROM ix WHERE index_name = 'AFRICA'), "
             f"ge AS (SELECT date, close AS e, {_over('avg', 'close', 50)} AS e50, close / lag(close, 20) OVER (ORDER BY date) - 1 AS e20 FROM ix WHERE index_name = 'EUROPE'), "
             f"gb AS (SELECT date, b50, b200, pct_pos_20d, lag(b50, 10) OVER (ORDER BY date) AS b50l, {_over('avg', 'b50', 20, 15)} AS b50m, {_over('avg', 'dispersion', 20)} AS disp, nhnl_10, nhnl_20, mcc_osc, ad_line, {_over('avg', 'ad_line', 50)} AS adm FROM ot), "
             "st AS MATERIALIZED (SELECT * FROM gr0 LEFT JOIN gv USING (date) LEFT JOIN ge USING (date) LEFT JOIN gb USING (date) LEFT JOIN (SELECT date, hysteresis, thrust_on, e AS zw FROM gate) USING (date)), "
             "qs AS (SELECT quantile_cont(z, 0.5) AS qz, quantile_cont(v - rv20, 0.5) AS qv, quantile_cont(rv20, 0.75) AS q20, quantile_cont(rv60, 0.75) AS q60, quantile_cont(rng, 0.5) AS qr, quantile_cont(disp, 0.5) AS qd "
             f"FROM st WHERE date < DATE '{SPLIT}')")
GATE_SQL = {
    "nifty_above_200dma": "c > m200", "nifty_above_50dma": "c > m50", "nifty_above_20dma": "c > m20", "nifty_20dma_rising": "slope > 0", "golden_cross": "m50 > m200", "abs_mom_12m": "r252 > 0",
    "abs_mom_6m": "r126 > 0", "not_deep_drawdown": "dd > -10", "midcap_above_50dma": "e > e50", "risk_appetite_mid": "e20 - r20 > 0", "vix_below_20dma": "v < v20", "vix_below_10dma": "v < v10",
    "vix_below_50dma": "v < v50", "vix_below_15": "v < 15", "vix_falling_10d": "v < l10", "vix_falling_5d": "v < l5", "vix_z60_low": "z < qz", "no_vix_spike": "NOT v > v10 * 1.2", "vrp_high": "v - rv20 > qv",
    "rvol20_not_high": "rv20 < q20", "rvol60_not_high": "rv60 < q60", "range20_low": "rng < qr", "breadth50_gt_50": "b50 > 50", "breadth200_gt_50": "b200 > 50", "breadth50_rising": "b50 > b50l",
    "breadth50_sma20_gt_50": "b50m > 50", "breadth50_hysteresis": "hysteresis > 0.5", "nhnl20_positive": "nhnl_20 > 0", "zweig_ema_gt_50": "zw > 0.5", "zweig_thrust_window": "thrust_on > 0.5",
    "mcclellan_osc_pos": "mcc_osc > 0", "ad_line_gt_sma50": "ad_line > adm", "nhnl_positive": "nhnl_10 > 0", "pct_pos_20d_gt_50": "pct_pos_20d > 50", "dispersion_low": "disp < qd",
}
STUDIED = list(GATE_SQL)
MAIN = ["even", "odd"]
PAIRED = gs.pairs(["nifty_above_50dma", "vix_below_20dma", "breadth50_gt_50", "breadth50_hysteresis", "range20_low"]) + [
    gs.Combination("nifty_above_200dma AND NOT nifty_above_20dma", "nifty_above_200dma", "nifty_above_20dma", "AND_NOT"),
    gs.Combination("breadth50_hysteresis OR zweig_thrust_window", "breadth50_hysteresis", "zweig_thrust_window", "OR")]


def _study(s, d):
    _, trades = trade_set(s, d)
    trades = trades.select("date", "net", F.when(F.col("r") % 2 == 0, "even").otherwise("odd").alias("strategy"))
    return trades, cut_lineage(gs.date_masks(_gates(s, d), STUDIED))


def _judged(judge, wanted):
    def run(s, d):
        trades, masks = _study(s, d)
        return judge(trades, masks, STUDIED, wanted, MAIN, F.lit(SPLIT).cast("date"))
    return run


_STUDY = (TS + ", " + XG.split(f"WITH RECURSIVE {BARS}, ")[1] + ", " + STATE_SQL + ", tt AS MATERIALIZED (SELECT date, net, half, CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS strategy FROM fx), g1 AS MATERIALIZED ("
          + " UNION ALL ".join(f"SELECT '{g}' AS gate, date, {e} AS g FROM st, qs" for g, e in GATE_SQL.items()) + "), ")


def _study_sql(wanted):
    """The states of the wanted combinations, one row per trade and gate: the plain way."""
    how = {"AND": "a.g AND b.g", "OR": "a.g OR b.g", "AND_NOT": "a.g AND NOT b.g"}
    states = " UNION ALL ".join(f"SELECT '{w.name}' AS gate, a.date, {how[w.mode]} AS g FROM g1 a JOIN g1 b ON b.date = a.date AND a.gate = '{w.a}' AND b.gate = '{w.b}' WHERE a.g IS NOT NULL AND b.g IS NOT NULL" for w in wanted)
    return (_STUDY + f"gg AS MATERIALIZED ({states}), tg AS MATERIALIZED (SELECT gate, strategy, half, date, net, g FROM tt JOIN gg USING (date) UNION ALL SELECT gate, 'POOLED_MAIN', half, date, net, g FROM tt JOIN gg USING (date)), "
            "c0 AS (SELECT gate, strategy, half, count(*) AS n_all, avg(net) AS mean_all, count(*) FILTER (g) AS n_on, avg(net) FILTER (g) AS mean_on, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) FILTER (g) AS win_on, count(*) FILTER (NOT g) AS n_off, "
            "avg(net) FILTER (NOT g) AS mean_off, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) FILTER (NOT g) AS win_off FROM tg GROUP BY 1, 2, 3), "
            "cs AS (SELECT gate, strategy, half, g, date, sum(net - CASE WHEN g THEN mean_on ELSE mean_off END) AS e, any_value(CASE WHEN g THEN n_on ELSE n_off END) AS m FROM tg JOIN c0 USING (gate, strategy, half) GROUP BY 1, 2, 3, 4, 5), "
            "ct AS (SELECT gate, strategy, half, sum(e * e / (m * m)) AS var FROM cs GROUP BY 1, 2, 3), "
            "cl AS MATERIALIZED (SELECT c0.*, mean_on - mean_off AS diff, CASE WHEN n_on >= 5 AND n_off >= 5 AND var > 0 THEN (mean_on - mean_off) / sqrt(var) END AS t_cluster, "
            "CASE WHEN n_on >= 30 AND n_off >= 30 THEN 1 ELSE 0 END AS testable, CASE WHEN n_on >= 30 AND n_off >= 30 AND mean_on > mean_off THEN 1 ELSE 0 END AS pass FROM c0 JOIN ct USING (gate, strategy, half))")


CELL_COLUMNS = "gate:s strategy:s half:s n_all:i mean_all:f3 n_on:i mean_on:f3 win_on:f3 n_off:i mean_off:f3 win_off:f3 diff:f3 t_cluster:f3 testable:i pass:i"
VERDICT_COLUMNS = ("gate:s on_all:f3 on_h1:f3 on_h2:f3 n_testable:i n_pass:i n_evaluated:i n_dropped:i months_on:i months_off:i month_mean_on:f3 month_mean_off:f3 off_negative:f3 on_negative:f3 "
                   "quarters:i quarter_wins:i promoted:i usable:i robust:i")
VERDICT_SQL = (f", tm AS (SELECT gate, avg(CASE WHEN g THEN 100.0 ELSE 0 END) AS on_all, avg(CASE WHEN g THEN 100.0 ELSE 0 END) FILTER (date < DATE '{SPLIT}') AS on_h1, avg(CASE WHEN g THEN 100.0 ELSE 0 END) FILTER (date >= DATE '{SPLIT}') AS on_h2 FROM gg GROUP BY 1), "
               "bo AS (SELECT gate, strategy, min(testable) * (count(*) = 2)::INT AS ts, min(pass) * (count(*) = 2)::INT AS ps FROM cl WHERE strategy <> 'POOLED_MAIN' GROUP BY 1, 2), bs AS (SELECT gate, sum(ts) AS n_testable, sum(ps) AS n_pass FROM bo GROUP BY 1), "
               "po AS (SELECT gate, count(*) FILTER (diff >= 0.5 AND t_cluster >= 2.0) AS strong FROM cl WHERE strategy = 'POOLED_MAIN' GROUP BY 1), kn AS (SELECT gate, count(*) AS n_evaluated FROM tg WHERE strategy <> 'POOLED_MAIN' GROUP BY 1), "
               "mo AS (SELECT gate, date_trunc('month', date) AS p, avg(net) AS m, count(*) AS k, avg(g::INT) AS o FROM tg WHERE strategy = 'POOLED_MAIN' GROUP BY 1, 2 HAVING count(*) >= 20), "
               "ms AS (SELECT gate, count(*) FILTER (o >= 0.5) AS months_on, count(*) FILTER (o < 0.5) AS months_off, avg(m) FILTER (o >= 0.5) AS month_mean_on, avg(m) FILTER (o < 0.5) AS month_mean_off, "
               "avg(CASE WHEN m < 0 THEN 100.0 ELSE 0 END) FILTER (o < 0.5) AS off_negative, avg(CASE WHEN m < 0 THEN 100.0 ELSE 0 END) FILTER (o >= 0.5) AS on_negative FROM mo GROUP BY 1), "
               "qu AS (SELECT gate, date_trunc('quarter', date) AS p, avg(net) FILTER (g) - avg(net) FILTER (NOT g) AS df FROM tg WHERE strategy = 'POOLED_MAIN' GROUP BY 1, 2 HAVING count(*) FILTER (g) >= 20 AND count(*) FILTER (NOT g) >= 20), "
               "qw AS (SELECT gate, count(*) AS quarters, count(*) FILTER (df > 0) AS quarter_wins FROM qu GROUP BY 1) "
               "@@ SELECT gate, on_all, on_h1, on_h2, coalesce(n_testable, 0) AS n_testable, coalesce(n_pass, 0) AS n_pass, coalesce(n_evaluated, 0) AS n_evaluated, (SELECT count(*) FROM tt) - coalesce(n_evaluated, 0) AS n_dropped, "
               "coalesce(months_on, 0) AS months_on, coalesce(months_off, 0) AS months_off, month_mean_on, month_mean_off, off_negative, on_negative, coalesce(quarters, 0) AS quarters, coalesce(quarter_wins, 0) AS quarter_wins, "
               "(coalesce(n_testable, 0) = 2 AND coalesce(n_pass, 0) = 2)::INT AS promoted, (on_all >= 40)::INT AS usable, (coalesce(n_testable, 0) = 2 AND coalesce(n_pass, 0) = 2 AND on_all >= 40 AND strong = 2)::INT AS robust "
               "FROM tm LEFT JOIN bs USING (gate) LEFT JOIN po USING (gate) LEFT JOIN kn USING (gate) LEFT JOIN ms USING (gate) LEFT JOIN qw USING (gate)")
register("V12_gate_study", CELL_COLUMNS, _judged(gs.gate_cells, gs.singles(STUDIED)), _study_sql(gs.singles(STUDIED)) + "@@ SELECT * FROM cl")
register("V12_gate_verdicts", VERDICT_COLUMNS, _judged(gs.gate_verdicts, gs.singles(STUDIED)), _study_sql(gs.singles(STUDIED)) + VERDICT_SQL)
register("V12_gate_pairs", "gate:s sessions:i share_on:f4",
         lambda s, d: va.time_in_market(va.gate_pairs(_gates(s, d).filter(F.col("gate").isin("nifty_above_50dma", "vix_below_20dma", "breadth50_gt_50")))),
         _study_sql(gs.pairs(["breadth50_gt_50", "nifty_above_50dma", "vix_below_20dma"])).split(", tg AS MATERIALIZED")[0] + "@@ SELECT gate, count(*) AS sessions, avg(g::INT) * 100 AS share_on FROM gg GROUP BY 1")
register("V12_gate_combinations", VERDICT_COLUMNS, _judged(gs.gate_verdicts, PAIRED), _study_sql(PAIRED) + VERDICT_SQL)
register("X19_gate_states", "gate:s date:d on_value:n", lambda s, d: _gates(s, d).filter(F.col("gate").isin(STUDIED)).withColumnRenamed("on", "on_value"),
         _STUDY.removesuffix(", ") + "@@ SELECT gate, date, g::INT AS on_value FROM g1")
register("V13_null_expectation", "period:s features:i expected:f5",
         lambda s, d: va.monotonicity(va.feature_table(_binned(s, d))).groupBy("period").agg(F.count(F.lit(1)).alias("features")).withColumn("expected", F.col("features") * va.null_probability()),
         BINS + "@@ SELECT period, count(DISTINCT feature) AS features, count(DISTINCT feature) * 2 * (5.0 / 120) * (5.0 / 120) AS expected FROM bn WHERE bin IS NOT NULL GROUP BY 1")


def _audit(s, d):
    from ..plans.audit import strategy_audit
    families = {k: replace(v, stop=("atr", 0.2)) for k, v in oc.FAMILIES.items()}
    return strategy_audit(_panel(s, d, ALL, extra=["atr_pct", "ema_21", "hi7_prior", "rs_rank"]), ALL, families, slots=5)


register("V14_strategy_audit", "rule:s n_signals_raw:i n_signals_fresh:i n_trades:i n_signals_taken:n win_pct:f4 mean_ret_pct:f3 median_ret_pct:f3 stopped_pct:f4 capped_pct:f4 cagr_pct:f3 max_dd_pct:f4", _audit)


def _cell_halves(s, d):
    panel = positioned(s, d)
    trades = cut_lineage(oc.grid(panel, signals(panel), CELLS))
    first = F.col("date") < F.lit(SPLIT).cast("date")
    out = trades.groupBy("cell").agg(F.avg(F.when(first, F.col("net"))).alias("h1_net"), F.avg(F.when(~first, F.col("net"))).alias("h2_net"),
                                     stats.share(F.col("net") > 0).alias("win"))
    quarters = stats.quarter_verdict(stats.quarter_table(trades, ["cell"]), ["cell"])
    return out.join(quarters.select("cell", "quarter_pass"), "cell")


register("V15_verdicts", "cell:s h1_net:f3 h2_net:f3 quarter_pass:i verdict:s", lambda s, d: va.verdict(_cell_halves(s, d)))


def _selection(s, d):
    _, trades = trade_set(s, d)
    chosen = al.top_k_with_holding(trades, -F.col("rsi_14"), 2)
    picked = cut_lineage(trades.join(chosen.select("sid"), "sid", "left_semi"))
    conc = stats.concentration(picked, ["scenario"], "net").select("scenario", "names", "top10_share", "median")
    months = picked.groupBy("scenario").agg((F.count(F.lit(1)) / F.countDistinct(F.trunc("date", "month"))).alias("trades_per_month"))
    return stats.reversal_stats(picked, ["scenario"]).join(conc, "scenario").join(months, "scenario")


register("V16_selection_metrics", "scenario:s n:i net:f3 win:f4 months_up:f4 worst_month:f3 top10_share:f4 trades_per_month:f4", _selection)
register("V17_best_cells", "setup:s cell:s worse_net:f3 worse_win:f3",
         lambda s, d: va.best_cells(_cell_halves(s, d).select(F.lit("low7").alias("setup"), "cell", F.least("h1_net", "h2_net").alias("worse_net"), F.col("win").alias("worse_win"))),
         SIMPLE_SQL + ", " + ", ".join(cell_sql(c, True, stop="atr", **x) for c, x in CELL_SQL.items()) + ", al AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cell, date, net FROM tk_{c}" for c in CELL_SQL)
         + f"), hv AS (SELECT cell, least(avg(net) FILTER (date < DATE '{SPLIT}'), avg(net) FILTER (date >= DATE '{SPLIT}')) AS worse_net, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS worse_win FROM al GROUP BY 1), "
         "pl AS (SELECT *, row_number() OVER (ORDER BY worse_net DESC, worse_win DESC, cell) AS a, row_number() OVER (ORDER BY worse_win DESC, worse_net DESC, cell) AS b FROM hv) @@ SELECT 'low7' AS setup, cell, worse_net, worse_win FROM pl WHERE a <= 2 OR b = 1")


STOPS = {"0.1 ATR": oc.Exit(("atr", 0.1), target=2.0, **WIDE), "0.3 ATR": oc.Exit(("atr", 0.3), target=2.0, **WIDE), "8%": oc.Exit(("pct", 8.0), target=2.0), "15%": oc.Exit(("pct", 15.0), target=2.0)}


def _rule_settings(s, d):
    """Outcomes of several rules under several stops, per half."""
    panel = oc.with_position(_panel(s, d, SIMPLE, extra=["atr_pct", "hi7_prior", "ema_21"]))
    found = ro.hits(panel, SIMPLE, ["isin", "date"], emit=False).select("isin", "date", "rule")
    sig = cut_lineage(panel.join(found, ["isin", "date"]).withColumn("sid", F.concat_ws("|", "rule", "isin", "r")))
    base = cut_lineage(panel.select("isin", "date", "r", "adj_open", "adj_high", "adj_low", "adj_close", "last_r", "next_open"))
    trades = oc.many_touches(base, sig, STOPS)
    period = F.when(F.col("date") < F.lit(SPLIT).cast("date"), "IS").otherwise("OOS")
    return stats.bracket_stats(trades.withColumns({"period": period, "setting": F.col("cell")}), ["rule", "setting", "period"])


STOP_SQL = {"0.1 ATR": "entry * atr_pct / 100 * 0.1", "0.3 ATR": "entry * atr_pct / 100 * 0.3", "8%": "entry * 0.08", "15%": "entry * 0.15"}
register("V18_rules_by_stop", "rule:s setting:s period:s n:i stop_pct:f4 win:f4 avg:f3 expectancy_r:f4", _rule_settings,
         SIMPLE_SQL + ", " + ", ".join(cell_sql(f"{rule}_{i}", False, stop="any", target="2.0", cap=20, risk=risk, signal=f"r >= 60 AND {RULE_SQL[rule][0]}") for rule in RULE_SQL for i, risk in enumerate(STOP_SQL.values()))
         + f"@@ SELECT rule, setting, CASE WHEN date < DATE '{SPLIT}' THEN 'IS' ELSE 'OOS' END AS period, count(*) AS n, avg(CASE WHEN why = 'stop' THEN 100.0 ELSE 0 END) AS stop_pct, "
         "avg(CASE WHEN gross > 0 THEN 100.0 ELSE 0 END) AS win, avg(gross) AS avg, avg(r_multiple) AS expectancy_r FROM ("
         + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{name}' AS setting, date, why, gross, r_multiple FROM tr_{rule}_{i}" for rule in RULE_SQL for i, name in enumerate(STOP_SQL)) + ") GROUP BY 1, 2, 3")


def _uplift(s, d):
    """Composite of the in-sample directions: selected, unselected and random selections compared per half."""
    _, trades = trade_set(s, d)
    long = _long(trades).withColumn("period", F.when(F.col("half") == "H1", "IS").otherwise("OOS"))
    # The direction of each feature is one number from the in-sample half.
    signs = {r["feature"]: (1 if (r["rho"] or 0) >= 0 else -1) for r in va.spearman(long.filter("period = 'IS'"), ["sid", "feature"], ["feature"], "x", "net").collect()}
    scored = cut_lineage(cross.composite_score(trades, {f: signs[f] for f in FEATURES if f in signs}, ["sid"]))
    chosen = al.top_k_with_holding(scored, F.col("score"), 2).select("sid").withColumn("picked", F.lit(1))
    marked = scored.join(chosen, "sid", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    real = marked.groupBy("half").agg(F.avg(F.when(F.col("picked") == 1, F.col("net"))).alias("selected"), F.avg(F.when(F.col("picked") == 0, F.col("net"))).alias("unselected"))
    drawn = al.top_k_with_holding(al.random_orders(trades, 200), F.col("luck").cast("double"), 2).join(trades.select("sid", "half", "net"), "sid")
    draws = drawn.groupBy("half", "scenario").agg(F.avg("net").alias("m")).join(real, "half")
    beaten = draws.groupBy("half").agg(F.avg("m").alias("random"), stats.share(F.col("selected") > F.col("m")).alias("draws_beaten"))
    return real.join(beaten, "half")


register("V19_selection_uplift", "half:s selected:f3 unselected:f3 random:f3 draws_beaten:f2", _uplift)

# ------------------------------------------------------------------ setups
E_COLUMNS = "isin:s date:d setup:s"


def _bottoms(s, d):
    return setups.bottom_setups(build_features(panels.week_panel(s, d), setups.BOTTOM_COLUMNS))


register("E16_bottom_setups", E_COLUMNS, _bottoms)
_DB = (f"WITH {BARS}, h AS (SELECT *, {roll('max', 'adj_high', 250, 60)} AS h52, {roll('min', 'adj_low', 10, 5)} AS l10, count(*) OVER sw AS n11, min(adj_low) OVER sw AS m11 FROM bars "
       "WINDOW sw AS (PARTITION BY isin ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), lo AS (SELECT isin, r, adj_low FROM h WHERE n11 = 11 AND adj_low <= m11 + 1e-9 AND adj_low / h52 - 1 <= -0.25), "
       "g AS (SELECT DISTINCT h.isin, h.r FROM lo JOIN h ON h.isin = lo.isin AND h.r - lo.r BETWEEN 15 AND 60 WHERE abs(l10 / lo.adj_low - 1) <= 0.03 AND l10 / h52 - 1 <= -0.25 "
       "AND h.adj_close > (SELECT max(z.adj_high) FROM bars z WHERE z.isin = h.isin AND z.r > lo.r AND z.r < h.r))")
register("E12_double_bottom", KEY + "double_bottom:i",
         lambda s, d: setups.double_bottom(cut_lineage(build_features(panels.week_panel(s, d), ["high_52w", "low10_incl"]))).filter("double_bottom = 1"),
         _DB + " @@ SELECT h.isin, h.date, 1 AS double_bottom FROM h JOIN g USING (isin, r) WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.isin = h.isin AND x.r BETWEEN h.r - 5 AND h.r - 1)")
_W = "PARTITION BY isin ORDER BY date"
register("E13_failed_pushes", KEY + "pushes_30:n lower_high:i", lambda s, d: setups.failed_high(panels.week_panel(s, d)),
         f"WITH {BARS}, a AS (SELECT *, {roll('max', 'adj_high', 60, None, True)} AS h60 FROM bars), b AS (SELECT *, coalesce(adj_high >= 0.98 * h60 AND adj_close <= h60, false) AS nr FROM a), "
         f"c AS (SELECT *, CASE WHEN nr AND NOT coalesce(lag(nr) OVER ({_W}), false) THEN 1 ELSE 0 END AS ps FROM b), "
         f"e AS (SELECT *, {roll('sum', 'ps', 30, None, True)} AS p30, last_value(CASE WHEN ps = 1 THEN adj_high END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM c) "
         f"@@ SELECT isin, date, p30 AS pushes_30, CASE WHEN p30 >= 2 AND lp < lag(lp) OVER ({_W}) THEN 1 ELSE 0 END AS lower_high FROM e")
register("E14_gap_pattern", KEY + "kind:s entry_k:i entry:f4 exit:f4 why:s r_multiple:f4", lambda s, d: setups.gap_pattern(oc.with_position(build_features(panels.week_panel(s, d), ["atr_pct"])), 5, 10, buffer_pct=5.0))
register("E17_dip_definitions", E_COLUMNS, lambda s, d: setups.dip_setups(build_features(panels.week_panel(s, d), setups.DIP_COLUMNS)))
register("E18_level_retests", E_COLUMNS, lambda s, d: setups.level_retests(build_features(panels.week_panel(s, d), setups.RETEST_COLUMNS)))
register("E19_volume_setups", E_COLUMNS, lambda s, d: setups.volume_setups(build_features(panels.week_panel(s, d), setups.VOLUME_COLUMNS)))
register("E20_variant_ladders", "variant:s hits:i", lambda s, d: setups.ladder_hits(build_features(panels.week_panel(s, d), setups.LADDER_COLUMNS)))
