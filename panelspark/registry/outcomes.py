"""Rule, outcome and statistics queries."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.core import cap_band
from ..functions.windows import PANEL as S
from ..operators import cross, market, outcomes as oc, rules as ro, stats
from ..operators.features import build_features
from ..plans.screen import screen_panel
from ..session import cut_lineage
from ..sources import panels
from .base import BARS, W, register, roll
from .cross import FORWARD, GATE, RS, index_bars
from .windows import KEY, RECURSION, SMA, lag, pct_sql

# ------------------------------------------------------------------ rules
LOW = dict(min_turnover=0.0, min_price=0.0, min_history=60)
ALL = ro.floors(ro.load_rules(), **LOW)


def _panel(s, d, rules, **kw):
    bars = panels.stored_week_panel(s, d)
    return screen_panel(bars, rules, index_bars(s, d, bars), volatility="AFRICA", benchmark="ASIA", **kw)


def _pick(*names):
    return [r for r in ALL if r.name in names]


SIMPLE = _pick("momentum_leaders", "trend_stack", "volume_shocker", "double_seven")
SIMPLE_SQL = (RECURSION + f", q0 AS (SELECT b.*, {SMA[20].replace('isin', 'b.isin').replace('BY date', 'BY b.date')} AS s20, "
              f"{SMA[50].replace('isin', 'b.isin').replace('BY date', 'BY b.date')} AS s50, {SMA[200].replace('isin', 'b.isin').replace('BY date', 'BY b.date')} AS s200, "
              "CASE WHEN b.r <= 14 THEN NULL WHEN l14 = 0 AND g14 > 0 THEN 100.0 WHEN l14 = 0 THEN 50.0 ELSE 100 - 100 / (1 + g14 / l14) END AS rsi_14, "
              "CASE WHEN b.r > 14 THEN atr / b.adj_close * 100 END AS atr_pct, CASE WHEN b.r >= 21 THEN e21 END AS ema_21, CASE WHEN b.r >= 50 THEN e50 END AS ema_50 "
              "FROM bars b JOIN walk w ON w.isin = b.isin AND w.r = b.r), "
              f"q1 AS (SELECT *, {pct_sql('adj_close', lag('adj_close'))} AS ret_1d, {pct_sql('adj_close', lag('adj_close', 60))} AS ret_60d, "
              f"{pct_sql('adj_close', lag('adj_close', 120))} AS ret_120d, {pct_sql(lag('adj_close', 22), lag('adj_close', 252))} AS mom_12_1, "
              f"volume / ({roll('avg', 'volume', 20, 10)}) AS vol_ratio, {roll('min', 'adj_close', 7, None, True)} AS lo7, {roll('max', 'adj_close', 7, None, True)} AS hi7, "
              f"{roll('min', 'adj_low', 5, None, True)} AS low5, {roll('min', 'adj_low', 10, None, True)} AS low10, lead(ema_21) OVER ({W}) AS next_ema, "
              f"adj_close < ema_21 AND {lag('adj_close')} < {lag('ema_21')} AS below2, lead(adj_open) OVER ({W}) AS next_open FROM q0)")
RULE_SQL = {"momentum_leaders": ("mom_12_1 > 15 AND ret_60d > 12 AND ret_120d > 15 AND adj_close > s50 AND s50 > s200", "ret_60d"),
            "trend_stack": ("adj_close > s20 AND s20 > s50 AND s50 > s200 AND rsi_14 < 70", "ret_60d"),
            "volume_shocker": ("vol_ratio > 3 AND ret_1d > 2 AND adj_close > s20", "vol_ratio"),
            "double_seven": ("adj_close < lo7 AND adj_close > s200", "-rsi_2")}
HITS_SQL = " UNION ALL ".join(f"SELECT isin, date, r, '{n}' AS rule FROM q1 WHERE r >= 60 AND {e}" for n, (e, _) in RULE_SQL.items())

register("P1_rule_expression", KEY + "rule:s", lambda s, d: ro.hits(_panel(s, d, SIMPLE), SIMPLE, apply_floors=False, emit=False),
         SIMPLE_SQL + "@@ " + HITS_SQL.replace("r >= 60 AND ", ""))
register("P2_eligibility", KEY + "rule:s",
         lambda s, d: ro.hits(_panel(s, d, SIMPLE), ro.floors(SIMPLE, min_turnover=100_000.0, min_price=1500.0, min_history=210), emit=False),
         SIMPLE_SQL + f", q2 AS (SELECT *, {roll('median', 'turnover', 20, 10)} AS tm FROM q1) @@ "
         + " UNION ALL ".join(f"SELECT isin, date, '{n}' AS rule FROM q2 WHERE r >= 210 AND tm >= 100000 AND adj_close >= 1500 AND {e}" for n, (e, _) in RULE_SQL.items()))


def _rules_table(s, d):
    """The catalogue joined with the number of hits each rule has on the panel."""
    rules = ALL
    found = ro.hits(_panel(s, d, rules), rules, emit=False).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))
    return ro.rules_table(s, rules).join(found, "rule", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


register("R1_catalogue", "rule:s family:s hits:i", _rules_table)
SIDES = ro.floors([ro.Rule("above_20", "adj_close > sma_20", sort_by="vol_ratio"), ro.Rule("below_20", "adj_close < sma_20", sort_by="ret_5d", ascending=True)], **LOW)
register("R2_latest_screen", KEY + "rule:s score:f4", lambda s, d: ro.latest_hits(_panel(s, d, SIDES), SIDES),
         SIMPLE_SQL + f", q3 AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 5))} AS ret_5d FROM q1) @@ SELECT isin, date, 'above_20' AS rule, vol_ratio AS score FROM q3 WHERE date = (SELECT max(date) FROM bars) AND r >= 60 AND adj_close > s20 "
         "UNION ALL SELECT isin, date, 'below_20', -ret_5d FROM q3 WHERE date = (SELECT max(date) FROM bars) AND r >= 60 AND adj_close < s20")
register("R3_historical_hits", KEY + "rule:s", lambda s, d: ro.hits(_panel(s, d, SIMPLE), SIMPLE, emit=False), SIMPLE_SQL + "@@ " + HITS_SQL)
register("R3_all_rules", "rule:s hits:i names:i first_date:s last_date:s",
         lambda s, d: ro.hits(_panel(s, d, ALL), ALL, emit=False).groupBy("rule").agg(
             F.count(F.lit(1)).alias("hits"), F.countDistinct("isin").alias("names"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))
register("R4_emitted_values", KEY + "field:s value:f4",
         lambda s, d: ro.hits(_panel(s, d, _pick("trend_stack")), _pick("trend_stack")).select("isin", "date", F.explode("emit").alias("field", "value")),
         SIMPLE_SQL + f", h AS (SELECT * FROM q1 WHERE r >= 60 AND {RULE_SQL['trend_stack'][0]}) @@ "
         + " UNION ALL ".join(f"SELECT isin, date, '{n}' AS field, CAST({x} AS DOUBLE) AS value FROM h" for n, x in
                              (("adj_close", "adj_close"), ("sma_20", "s20"), ("sma_50", "s50"), ("sma_200", "s200"), ("rsi_14", "rsi_14"), ("ret_60d", "ret_60d"))))
TEMPLATES = {"dip": "adj_close < lo7_prior and adj_close > sma_{p} and ret_1d < {q}", "stretch": "adj_close > sma_20 * (1 + {p} / 100)"}


def _templates(s, d):
    rules = ro.floors(ro.expand_templates(TEMPLATES, [20, 50], [-5, -20]), **LOW)
    return ro.hits(_panel(s, d, rules), rules, emit=False).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))


register("R5_rule_templates", "rule:s hits:i", _templates,
         SIMPLE_SQL + "@@ " + " UNION ALL ".join(
             [f"SELECT 'dip|{p}|{q}' AS rule, count(*) AS hits FROM q1 WHERE r >= 60 AND adj_close < lo7 AND adj_close > s{p} AND ret_1d < {q} HAVING count(*) > 0" for p in (20, 50) for q in (-5, -20)]
             + [f"SELECT 'stretch|{p}' AS rule, count(*) AS hits FROM q1 WHERE r >= 60 AND adj_close > s20 * (1 + {p} / 100.0) HAVING count(*) > 0" for p in (20, 50)]))


def _variants(s, d):
    rules = ro.variants(_pick("trend_stack")[0], {"strong": "ret_120d > 0", "quiet": "vol_ratio < 1"})
    return ro.hits(_panel(s, d, rules), rules, emit=False).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))


register("R6_rule_variants", "rule:s hits:i", _variants,
         SIMPLE_SQL + "@@ " + " UNION ALL ".join(f"SELECT 'trend_stack|{n}' AS rule, count(*) AS hits FROM q1 WHERE r >= 60 AND {RULE_SQL['trend_stack'][0]}{c} HAVING count(*) > 0"
                                                 for n, c in (("base", ""), ("strong", " AND ret_120d > 0"), ("quiet", " AND vol_ratio < 1"))))
register("R7_rule_family", "family:s hits:i",
         lambda s, d: ro.hits(_panel(s, d, SIMPLE), SIMPLE, emit=False).join(ro.rules_table(s, SIMPLE).select("rule", "family"), "rule").groupBy("family").agg(F.count(F.lit(1)).alias("hits")),
         SIMPLE_SQL + f"@@ SELECT CASE WHEN rule = 'double_seven' THEN 'mean_reversion' ELSE 'trend_continuation' END AS family, count(*) AS hits FROM ({HITS_SQL}) GROUP BY 1")

# ------------------------------------------------------------------ outcomes: signals are new seven-session closing lows
COLUMNS = ["atr_pct", "ema_21", "hi7_prior", "new_lo7", "low5_prior", "sma_50", "ret_20d", "vol_ratio", "dist_sma_50", "rsi_14", "ret_5d"]


def positioned(s, d):
    """Positioned features, materialised: signals and their paths read the same rows."""
    return cut_lineage(oc.with_position(build_features(panels.week_panel(s, d), COLUMNS)))


def signals(panel, condition="new_lo7 = 1"):
    return panel.filter(condition).withColumn("sid", F.concat_ws("|", "isin", "r"))


WIDE = dict(risk_min=0.0, risk_max=1e9)
BRACKET = oc.Exit(("atr", 0.1), target=2.0, cap=20, **WIDE)


def outcome(exit, excursions=False):
    def run(s, d):
        panel = positioned(s, d)
        return oc.first_touch(panel, signals(panel), exit, excursions)
    return run


def touch_sql(stop="", stop_on="low", target="", trigger="", cap=20, on_last="ignore", cost=0.0, why="trigger", stop_from=0, peak=False,
              risk="NULL", price_stop="", signal="adj_close < lo7") -> str:
    """First touch as SQL: event rows by filtered minima over the path, prices read back from the bars."""
    run = "max(b.adj_high) OVER (PARTITION BY s.isin, s.r ORDER BY b.r) AS rh"
    path = (f"sg AS MATERIALIZED (SELECT *, next_open AS entry, {risk} AS risk FROM (SELECT *, next_open AS entry FROM q1 WHERE {signal} AND next_open IS NOT NULL)), "
            f"sk AS MATERIALIZED (SELECT * FROM sg WHERE {'risk > 0' if stop else 'true'}), "
            f"pa AS (SELECT s.isin, s.r AS t, s.date, s.entry, s.risk, s.atr_pct AS satr, b.r - s.r AS k, b.adj_open, b.adj_high, b.adj_low, b.adj_close, b.ema_21, b.ema_50, b.low10, b.below2, b.hi7, b.next_open AS no, "
            f"b.r = b.last_r AS is_last, {run} FROM sk s JOIN q1 b ON b.isin = s.isin AND b.r BETWEEN s.r + 1 AND s.r + {cap}), ")
    ls = " AND NOT is_last" if on_last == "ignore" else ""
    st = ("adj_low <= entry - risk" if stop_on == "low" else "adj_close < entry - risk" + ls) if stop else "false"
    tg = f"adj_high >= entry + risk * {target}" if target else "false"
    tr = f"({trigger}){ls}" if trigger else "false"
    path += (f"ev AS (SELECT isin, t, date, entry, risk, max(k) AS ke, coalesce(min(k) FILTER (k > {stop_from} AND {st}), 999999) AS ks, "
             f"coalesce(min(k) FILTER ({tg}), 999999) AS kt, coalesce(min(k) FILTER ({tr}), 999999) AS kx FROM pa GROUP BY 1, 2, 3, 4, 5), "
             "ew AS (SELECT *, least(ks, kt, kx) AS kf, CASE WHEN least(ks, kt, kx) = 999999 THEN 'time' WHEN ks <= least(kt, kx) THEN 'stop' WHEN kt <= kx THEN 'target' "
             f"ELSE '{why}' END AS why FROM ev), "
             "ex AS (SELECT ew.*, p.adj_open AS po, p.adj_close AS pc, p.no, p.is_last FROM ew JOIN pa p ON p.isin = ew.isin AND p.t = ew.t AND p.k = least(kf, ke)), ")
    late = "po" if on_last == "open" else "pc"
    nxt = f"CASE WHEN is_last THEN {late} ELSE no END"
    stop_px = nxt if stop_on == "close" else "least(po, entry - risk)"
    moved = "'" + why + "'" + (", 'stop'" if stop_on == "close" else "")
    tgt = f"greatest(po, entry + risk * {target})" if target else "NULL"
    path += (f"tx AS MATERIALIZED (SELECT isin, t, date, entry, risk, risk / entry * 100 AS risk_pct, why, CASE why WHEN 'time' THEN pc WHEN 'stop' THEN {stop_px} WHEN 'target' THEN {tgt} ELSE {nxt} END AS exit, "
             f"least(kf, ke) + CASE WHEN why IN ({moved}) AND NOT is_last THEN 1 ELSE 0 END AS bars, least(kf, ke) AS ki FROM ex), "
             f"tr AS MATERIALIZED (SELECT *, (exit / entry - 1) * 100 AS gross, (exit / entry - 1) * 100 - {cost} AS net, t + bars AS exit_r, (exit / entry - 1) * 100 / risk_pct AS r_multiple FROM tx)")
    return SIMPLE_SQL + ", " + path


OUT = KEY + "entry:f4 exit:f4 bars:i why:s net:f3 "
B_SQL = touch_sql(stop="atr", target="2.0", cap=20, risk="entry * atr_pct / 100 * 0.1")
register("T1_bracket", OUT + "risk_pct:f4 r_multiple:f4", outcome(BRACKET), B_SQL + "@@ SELECT * FROM tr")
REV_SQL = touch_sql(trigger="adj_close > hi7", cap=20, on_last="close", cost=0.30, why="reversal")
register("T2_reversal", OUT, outcome(oc.REVERSAL), REV_SQL + "@@ SELECT * FROM tr")
TREND = replace(oc.FAMILIES["trend_continuation"], stop=("atr", 0.2))
register("T3_family_exit", OUT, outcome(TREND),
         touch_sql(stop="atr", stop_on="close", trigger="adj_close < ema_21", cap=60, on_last="open", cost=0.5, risk="entry * atr_pct / 100 * 0.2") + "@@ SELECT * FROM tr")
TRAIL = oc.Exit(("atr", 0.5), trigger="adj_close < peak - atr_abs * 0.3", why="chandelier", cap=40, cost=0.3, **WIDE)
register("T4_trailing_exit", OUT, outcome(TRAIL),
         touch_sql(stop="atr", trigger="adj_close < greatest(entry, rh) - satr / 100 * entry * 0.3", why="chandelier", cap=40, cost=0.3, risk="entry * atr_pct / 100 * 0.5") + "@@ SELECT * FROM tr")


# What ends a trade beside its stop, and stops that act on closes; the fixture's stops are narrower than the studies'.
TRAILS = {"ema21": ("adj_close < ema_21", "ema_21"), "ema50": ("adj_close < ema_50", "ema_50"), "low10": ("adj_close < low10_prior", "low10_prior"), "chandelier": ("adj_close < peak - atr_abs * 3", None)}
TRAIL_CELLS = {n: oc.Exit(("atr", 0.5), trigger=t, why=n, cap=40, cost=0.3, extra=(x,) if x else (), **WIDE) for n, (t, x) in TRAILS.items()}
TRAIL_SQL = {"ema21": "adj_close < ema_21", "ema50": "adj_close < ema_50", "low10": "adj_close < low10", "chandelier": "adj_close < greatest(entry, rh) - satr / 100 * entry * 3"}
_CLOSE = dict(why="exit", cap=20, cost=0.3, stop_on="close", stop_from=1, **WIDE)
CLOSE_CELLS = {
    "wide": oc.Exit(("atr", 0.3), trigger="adj_close > hi7_prior", extra=("hi7_prior",), **_CLOSE),
    "narrow": oc.Exit(("atr", 0.25), trigger="adj_close > hi7_prior", extra=("hi7_prior",), **_CLOSE),
    "structure": oc.Exit(("price", "structure"), trigger="adj_close > hi7_prior", extra=("hi7_prior",), **_CLOSE),
    "fifth day": oc.Exit(("atr", 0.3), trigger="adj_close > hi7_prior or (k >= 6 and adj_close < entry)", extra=("hi7_prior",), **_CLOSE),
    "two closes": oc.Exit(("atr", 0.3), trigger="adj_close > hi7_prior or (k >= 3 and below2)", extra=("hi7_prior", "below2"), **(_CLOSE | {"stop_on": "low"})),
}
CLOSE_SQL = {
    "wide": dict(trigger="adj_close > hi7", risk="entry * atr_pct / 100 * 0.3"), "narrow": dict(trigger="adj_close > hi7", risk="entry * atr_pct / 100 * 0.25"),
    "structure": dict(trigger="adj_close > hi7", risk="entry - least(entry - entry * atr_pct / 100 * 0.3, coalesce(next_ema - entry * atr_pct / 100 * 0.1, entry))"),
    "fifth day": dict(trigger="adj_close > hi7 OR (k >= 6 AND adj_close < entry)", risk="entry * atr_pct / 100 * 0.3"),
    "two closes": dict(trigger="adj_close > hi7 OR (k >= 3 AND below2)", risk="entry * atr_pct / 100 * 0.3", stop_on="low"),
}


def _cells(cells):
    """Outcomes under several exits, one path for all."""
    def run(s, d):
        panel = cut_lineage(oc.with_position(build_features(panels.week_panel(s, d), [*COLUMNS, "ema_50", "low10_prior"])))
        panel = panel.withColumn("below2", F.coalesce((F.col("adj_close") < F.col("ema_21")) & (S.lag(F.col("adj_close")) < S.lag(F.col("ema_21"))), F.lit(False)))
        part = F.col("next_open") * F.col("atr_pct") / 100
        panel = cut_lineage(panel.withColumn("structure", F.least(F.col("next_open") - part * 0.3, F.coalesce(S.lead(F.col("ema_21")) - part * 0.1, F.col("next_open")))))
        return oc.many_touches(panel, signals(panel), cells)
    return run


def _cells_sql(exits, **shared):
    tags = {n: n.replace(" ", "_") for n in exits}
    return (SIMPLE_SQL + ", " + ", ".join(cell_sql(tags[n], False, stop="any", **(shared | x)) for n, x in exits.items()) + "@@ "
            + " UNION ALL ".join(f"SELECT isin, date, '{n}' AS cell, entry, exit, bars, why, net FROM tr_{t}" for n, t in tags.items()))


def _walk_sql(manage: str) -> str:
    """Stop management as a row-by-row recursion, an independent formulation of the raised stop."""
    arm = "(NOT w.armed AND b.adj_high >= w.entry + w.risk)"
    now = f"(w.armed OR {arm})"
    pk = "greatest(w.peak, b.adj_high)"
    start = f"greatest(w.sl, b.low5)" if manage == "low5" else "w.sl"
    live = f"CASE WHEN w.armed AND b.low5 IS NOT NULL THEN {start} ELSE w.sl END" if manage == "low5" else "w.sl"
    after = {"breakeven": f"CASE WHEN {arm} THEN greatest(w.sl, w.entry) ELSE w.sl END",
             "half": f"CASE WHEN {now} THEN greatest(w.sl, {pk} - 2 * w.aa) ELSE w.sl END", "low5": live}[manage]
    half = f"CASE WHEN {arm} THEN greatest(b.adj_open, w.entry + w.risk) ELSE w.hp END" if manage == "half" else "w.hp"
    return (SIMPLE_SQL + ", sg AS (SELECT isin, r, date, next_open AS entry, next_open * atr_pct / 100 * 0.2 AS risk, atr_pct / 100 * next_open AS aa, last_r FROM q1 "
            "WHERE adj_close < lo7 AND next_open IS NOT NULL AND atr_pct > 0), "
            "wk AS (SELECT isin, r AS t, date, entry, risk, aa, last_r, r AS k, entry - risk AS sl, entry AS peak, false AS armed, CAST(NULL AS DOUBLE) AS hp, CAST(NULL AS DOUBLE) AS out, CAST('' AS VARCHAR) AS why FROM sg "
            "UNION ALL SELECT w.isin, w.t, w.date, w.entry, w.risk, w.aa, w.last_r, b.r, "
            f"CASE WHEN b.adj_low <= {live} THEN {live} ELSE {after} END, {pk}, {now}, CASE WHEN b.adj_low <= {live} THEN w.hp ELSE {half} END, "
            f"CASE WHEN b.adj_low <= {live} THEN least(b.adj_open, {live}) WHEN b.r = least(w.last_r, w.t + 20) THEN b.adj_close END, "
            f"CASE WHEN b.adj_low <= {live} THEN CASE WHEN {live} <= w.entry - w.risk THEN 'stop' ELSE 'tstop' END ELSE 'time' END "
            "FROM wk w JOIN q1 b ON b.isin = w.isin AND b.r = w.k + 1 WHERE w.out IS NULL AND w.k < least(w.last_r, w.t + 20)) "
            "@@ SELECT isin, date, entry, out AS exit, k - t AS bars, why, CASE WHEN hp IS NULL THEN (out / entry - 1) * 100 ELSE 50 * (hp / entry - 1) + 50 * (out / entry - 1) END - 0.3 AS net FROM wk WHERE out IS NOT NULL")


for _m in ("breakeven", "half", "low5"):
    register(f"T5_managed_stop_{_m}", OUT, outcome(oc.Exit(("atr", 0.2), cap=20, cost=0.3, manage=_m, extra=("low5_prior",), **WIDE)), _walk_sql(_m))
register("T6_fixed_hold", OUT, lambda s, d: (lambda p: oc.fixed_hold(p, signals(p), 5))(positioned(s, d)),
         SIMPLE_SQL + "@@ SELECT a.isin, a.date, a.next_open AS entry, b.adj_close AS exit, b.r - a.r AS bars, 'time' AS why, (b.adj_close / a.next_open - 1) * 100 - 0.3 AS net "
         "FROM q1 a JOIN q1 b ON b.isin = a.isin AND b.r = least(a.r + 5, a.last_r) WHERE a.adj_close < a.lo7 AND a.next_open IS NOT NULL")


def _structural(s, d):
    panel = positioned(s, d)
    exit = oc.Exit(("price", "adj_low"), target=1.0, cap=10, risk_min=3.0, risk_max=60.0, inclusive=True)
    return oc.first_touch(panel, signals(panel), exit)


register("T7_structural_stop", OUT + "risk_pct:f4", _structural,
         touch_sql(stop="low", target="1.0", cap=10, risk="CASE WHEN (entry - adj_low) / entry * 100 BETWEEN 3 AND 60 THEN entry - adj_low ELSE -1 END") + "@@ SELECT * FROM tr")


def reversal_trades(s, d):
    """Non-overlapping reversal trades; outcomes are materialised because admission and the studies reread them."""
    panel = positioned(s, d)
    trades = oc.first_touch(panel, signals(panel), oc.REVERSAL, True)
    return panel, oc.one_open_per_key(cut_lineage(trades))


GREEDY = ("nx AS MATERIALIZED (SELECT *, (SELECT min(t) FROM tr z WHERE z.isin = tr.isin AND z.t > tr.exit_r) AS nt FROM tr), "
          "gr AS (SELECT isin, t, nt FROM nx WHERE t = (SELECT min(t) FROM tr z WHERE z.isin = nx.isin) UNION ALL SELECT n.isin, n.t, n.nt FROM gr g JOIN nx n ON n.isin = g.isin AND n.t = g.nt), "
          "tk AS MATERIALIZED (SELECT tr.* FROM tr JOIN gr ON gr.isin = tr.isin AND gr.t = tr.t)")
TK = REV_SQL + ", " + GREEDY
register("T8_one_open_per_key", OUT, lambda s, d: reversal_trades(s, d)[1], TK + "@@ SELECT * FROM tk")


def _limit_entry(s, d):
    from ..operators.setups import alternative_entry
    panel = positioned(s, d)
    return alternative_entry(panel, signals(panel), "limit", 3)


register("T9_limit_entry", KEY + "entry_k:n entry:f4", _limit_entry,
         SIMPLE_SQL + ", sg AS (SELECT * FROM q1 WHERE adj_close < lo7 AND r < last_r), pa AS (SELECT s.isin, s.r, s.date, b.r - s.r AS k, CASE WHEN b.adj_open <= s.adj_close * 0.98 THEN b.adj_open ELSE s.adj_close * 0.98 END AS px, "
         "b.adj_low <= s.adj_close * 0.98 AS hit FROM sg s JOIN q1 b ON b.isin = s.isin AND b.r BETWEEN s.r + 1 AND s.r + 3) "
         "@@ SELECT isin, date, min(k) FILTER (hit) AS entry_k, arg_min(px, k) FILTER (hit) AS entry FROM pa GROUP BY 1, 2")


def _confirm_entry(s, d):
    from ..operators.setups import alternative_entry
    panel = positioned(s, d)
    return alternative_entry(panel, signals(panel), "confirm", 3)


register("T9_confirm_entry", KEY + "entry_k:n entry:f4", _confirm_entry,
         SIMPLE_SQL + f", q2 AS (SELECT *, {lag('adj_high')} AS ph FROM q1), sg AS (SELECT * FROM q2 WHERE adj_close < lo7 AND r < last_r), "
         "pa AS (SELECT s.isin, s.date, b.r - s.r + 1 AS k, b.next_open AS px, b.adj_close > b.ph AND b.next_open IS NOT NULL AS hit FROM sg s JOIN q2 b ON b.isin = s.isin AND b.r BETWEEN s.r + 1 AND s.r + 3) "
         "@@ SELECT isin, date, min(k) FILTER (hit) AS entry_k, arg_min(px, k) FILTER (hit) AS entry FROM pa GROUP BY 1, 2")


def _patterns(kind, within):
    def run(s, d):
        from ..operators.setups import alternative_entry
        panel = positioned(s, d)
        return alternative_entry(panel, signals(panel), kind, within)
    return run


_WAIT = (SIMPLE_SQL + f", q2 AS (SELECT *, {lag('adj_low')} AS pl, {lag('adj_close')} AS pc FROM q1), sg AS (SELECT * FROM q2 WHERE adj_close < lo7 AND r < last_r), "
         "pa AS MATERIALIZED (SELECT s.isin, s.date, s.adj_close AS sc, s.adj_low AS sl, s.adj_high AS sh, b.r - s.r AS k, b.adj_open AS o, b.adj_low AS l, b.adj_high AS h, b.adj_close AS c, b.pl, b.pc, b.next_open AS no "
         "FROM sg s JOIN q2 b ON b.isin = s.isin AND b.r BETWEEN s.r + 1 AND s.r + {within}), ")
register("T9_shakeout_entry", KEY + "entry_k:n entry:f4", _patterns("shakeout", 5),
         _WAIT.format(within=5).removesuffix(", ") + "@@ SELECT isin, date, min(k + 1) FILTER (l < pl AND c > pc AND no IS NOT NULL) AS entry_k, arg_min(no, k) FILTER (l < pl AND c > pc AND no IS NOT NULL) AS entry FROM pa GROUP BY 1, 2")
register("T9_retest_entry", KEY + "entry_k:n entry:f4", _patterns("retest", 10),
         _WAIT.format(within=10) + "ft AS (SELECT isin, date, min(k) FILTER (l <= sc) AS f FROM pa GROUP BY 1, 2) @@ SELECT isin, date, max(k) FILTER (k = f AND c > sl AND least(sc, o) > sl) AS entry_k, "
         "max(least(sc, o)) FILTER (k = f AND c > sl AND least(sc, o) > sl) AS entry FROM pa JOIN ft USING (isin, date) GROUP BY 1, 2")
register("T9_hold_break_entry", KEY + "entry_k:n entry:f4", _patterns("hold_break", 10),
         _WAIT.format(within=10) + "bk AS (SELECT isin, date, coalesce(min(k) FILTER (l < sl), 999) AS f FROM pa GROUP BY 1, 2) @@ SELECT isin, date, min(k) FILTER (k >= 3 AND k < f AND h > sh) AS entry_k, "
         "arg_min(greatest(sh, o), k) FILTER (k >= 3 AND k < f AND h > sh) AS entry FROM pa JOIN bk USING (isin, date) GROUP BY 1, 2")
CLOSE_STOP = oc.Exit(("atr", 0.2), trigger="adj_close > hi7_prior", why="reversal", cap=20, cost=0.3, stop_on="close", stop_from=1, extra=("hi7_prior",), **WIDE)
register("T10_close_stop", OUT, outcome(CLOSE_STOP),
         touch_sql(stop="atr", stop_on="close", trigger="adj_close > hi7", why="reversal", cap=20, cost=0.3, stop_from=1, risk="entry * atr_pct / 100 * 0.2") + "@@ SELECT * FROM tr")


def _excursions(s, d):
    panel, trades = reversal_trades(s, d)
    return oc.excursion_timing(panel, trades, 21)


register("T11_excursions", KEY + "mae_hold:f3 mfe_hold:f3 bars_to_mae:i bars_to_mfe:i", _excursions,
         TK + ", px AS (SELECT k.isin, k.t, k.date, k.entry, b.r - k.t AS k, b.adj_low, b.adj_high FROM tk k JOIN bars b ON b.isin = k.isin AND b.r BETWEEN k.t + 1 AND k.exit_r) "
         "@@ SELECT isin, date, (min(adj_low) / min(entry) - 1) * 100 AS mae_hold, (max(adj_high) / min(entry) - 1) * 100 AS mfe_hold, first(k ORDER BY adj_low, k) AS bars_to_mae, first(k ORDER BY adj_high DESC, k) AS bars_to_mfe FROM px GROUP BY isin, date")


def sessions(s, d):
    panel, trades = reversal_trades(s, d)
    return panel, oc.with_sessions(trades, panel)


SESS = (TK + ", ss AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), "
        "te AS MATERIALIZED (SELECT tk.*, a.date AS entry_date, sa.i AS entry_i, b.date AS exit_date, sb.i AS exit_i FROM tk JOIN bars a ON a.isin = tk.isin AND a.r = tk.t + 1 "
        "JOIN bars b ON b.isin = tk.isin AND b.r = tk.exit_r JOIN ss sa ON sa.date = a.date JOIN ss sb ON sb.date = b.date)")
register("J10_position_lookup", KEY + "entry_date:d entry_i:i exit_date:d exit_i:i", lambda s, d: sessions(s, d)[1], SESS + "@@ SELECT * FROM te")


def _bench(s, d):
    panel, trades = sessions(s, d)
    level = cross.equal_weight_level(panels.week_panel(s, d)).select("date", (F.col("log_level") / 50).alias("log_level"))
    return oc.benchmark_return(trades, level)


register("T12_benchmark_window", KEY + "bench:f4", _bench,
         SESS + f", bl0 AS (SELECT *, adj_close / {lag('adj_close')} - 1 AS ret FROM bars), bl1 AS (SELECT date, avg(ret) AS m FROM bl0 GROUP BY 1), bl AS (SELECT date, sum(ln(1 + coalesce(m, 0))) OVER (ORDER BY date) / 50 AS lg FROM bl1) "
         "@@ SELECT te.isin, te.date, (exp(b.lg - a.lg) - 1) * 100 AS bench FROM te JOIN bl a ON a.date = entry_date JOIN bl b ON b.date = exit_date")


def tagged(s, d):
    """Reversal trades with signal-day features, relative strength and half."""
    bars = panels.stored_week_panel(s, d)
    panel, trades = sessions(s, d)
    rank = cross.add_relative_strength(build_features(bars, list(cross.RS_WEIGHTS))).select("isin", "date", "rs_rank")
    state = market.gate_series(market.advance_decline(build_features(bars, ["sma_50"]))).select("date", "mkt_breadth_50", "mkt_gate_on")
    out = market.attach_market(trades.join(rank, ["isin", "date"], "left"), state)
    split = F.lit("1998-06-01").cast("date")
    return out.withColumns({"half": F.when(F.col("date") < split, "H1").otherwise("H2"), "strategy": F.lit("double_seven")})


register("T13_tagged_trades", KEY + "net:f3 rs_rank:n atr_pct:f4 vol_ratio:f4 mkt_gate_on:i half:s", tagged,
         SESS + f", {RS}, {GATE} @@ SELECT te.isin, te.date, te.net, rs.rs_rank, q1.atr_pct, q1.vol_ratio, gate.mkt_gate_on, CASE WHEN te.date < DATE '1998-06-01' THEN 'H1' ELSE 'H2' END AS half "
         "FROM te JOIN q1 ON q1.isin = te.isin AND q1.r = te.t LEFT JOIN rs ON rs.isin = te.isin AND rs.date = te.date LEFT JOIN gate ON gate.date = te.date")


def _regret(s, d):
    """Stopped trades that the unstopped baseline closed with a gain."""
    panel = positioned(s, d)
    tight = oc.Exit(("pct", 10.0), trigger="adj_close > hi7_prior", why="reversal", cap=20, cost=0.3, on_last="close", extra=("hi7_prior",))
    both = oc.many_touches(panel, signals(panel), {"base": oc.REVERSAL, "tight": tight})
    paired = both.groupBy("sid").agg(*[F.max(F.when(F.col("cell") == c, F.col(x))).alias(n) for n, c, x in (("why", "tight", "why"), ("base_net", "base", "net"))])
    return paired.filter("why IS NOT NULL AND base_net IS NOT NULL").groupBy("why").agg(F.count(F.lit(1)).alias("n"), stats.share(F.col("base_net") > 0).alias("would_have_won"))


register("T14_regret", "why:s n:i would_have_won:f4", _regret,
         touch_sql(stop="pct", trigger="adj_close > hi7", cap=20, on_last="close", cost=0.30, why="reversal", risk="entry * 0.1")
         + ", " + REV_SQL.split(SIMPLE_SQL + ", ")[1].replace("sg AS", "sg2 AS").replace("FROM sg ", "FROM sg2 ").replace("sk AS", "sk2 AS").replace("sk s", "sk2 s").replace("pa AS", "pa2 AS").replace("FROM pa ", "FROM pa2 ")
         .replace("JOIN pa p", "JOIN pa2 p").replace("ev AS", "ev2 AS").replace("FROM ev)", "FROM ev2)").replace("ew AS", "ew2 AS").replace("FROM ew JOIN", "FROM ew2 ew JOIN").replace("ex AS", "ex2 AS").replace("FROM ex)", "FROM ex2)")
         .replace("tx AS", "tx2 AS").replace("tr AS MATERIALIZED", "base AS MATERIALIZED").replace("FROM tx)", "FROM tx2)")
         + "@@ SELECT tr.why, count(*) AS n, avg(CASE WHEN base.net > 0 THEN 100.0 ELSE 0 END) AS would_have_won FROM tr JOIN base ON base.isin = tr.isin AND base.t = tr.t GROUP BY 1")


def _rotation(s, d):
    from ..operators.setups import monthly_rotation
    return monthly_rotation(build_features(panels.week_panel(s, d), ["ret_60d"]), "ret_60d", 5)


register("T15_monthly_rotation", "month:d names:i ret:f4 bench:f4", _rotation,
         f"WITH {BARS}, f AS (SELECT *, {pct_sql('adj_close', lag('adj_close', 60))} AS sc, date_trunc('month', date) AS mo FROM bars), "
         "m AS (SELECT isin, mo, max(date) AS date, arg_max(adj_close, date) AS c, arg_max(coalesce(sc, -1e300), date) AS sc FROM f GROUP BY 1, 2), "
         "n AS (SELECT *, lead(c) OVER w / c - 1 AS fw FROM m WINDOW w AS (PARTITION BY isin ORDER BY mo)), "
         "k AS (SELECT *, row_number() OVER (PARTITION BY mo ORDER BY sc DESC, isin) AS p FROM n WHERE sc > -1e300), b AS (SELECT mo, avg(fw) AS bench FROM n GROUP BY 1) "
         "@@ SELECT CAST(k.mo AS DATE) AS month, count(fw) AS names, avg(fw) * 100 AS ret, max(bench) * 100 AS bench FROM k JOIN b USING (mo) WHERE p <= 5 GROUP BY 1 HAVING count(fw) > 0")
CELLS = {"tight": oc.Exit(("atr", 0.1), target=1.0, cap=10, **WIDE), "wide": oc.Exit(("atr", 0.4), target=1.0, cap=20, **WIDE)}


def _grid(s, d):
    panel = positioned(s, d)
    return stats.lab_stats(cut_lineage(oc.grid(panel, signals(panel), CELLS)), ["cell"])


def cell_sql(tag: str, greedy: bool, **exit) -> str:
    """The CTEs of one exit with names of their own, to stand beside those of other exits after ``SIMPLE_SQL``."""
    body = touch_sql(**exit).removeprefix(SIMPLE_SQL + ", ") + (", " + GREEDY if greedy else "")
    return re.sub(r"\b(sg|sk|pa|ev|ew|ex|tx|tr|nx|gr|tk)\b", rf"\1_{tag}", body)


register("T4_exit_variants", KEY + "cell:s entry:f4 exit:f4 bars:i why:s net:f3", _cells(TRAIL_CELLS),
         _cells_sql({n: dict(trigger=t, why=n) for n, t in TRAIL_SQL.items()}, cap=40, cost=0.3, risk="entry * atr_pct / 100 * 0.5"))
register("T10_close_stops", KEY + "cell:s entry:f4 exit:f4 bars:i why:s net:f3", _cells(CLOSE_CELLS), _cells_sql(CLOSE_SQL, why="exit", cap=20, cost=0.3, stop_on="close", stop_from=1))

LAB_SQL = ("count(*) AS n, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS win, avg(net) AS net, quantile_cont(net, 0.5) AS median, "
           "avg(net) FILTER (net > 0) / -avg(net) FILTER (net <= 0) AS payoff, sum(net) FILTER (net > 0) / -sum(net) FILTER (net <= 0) AS pf, "
           "avg(CASE WHEN why = 'stop' THEN 100.0 ELSE 0 END) AS stopped, avg(bars) AS bars, avg(net / risk_pct) AS exp_r, count(DISTINCT date) AS days, "
           "count(*) / greatest(date_diff('day', min(date), max(date)) / 30.44, 1.0) AS per_month")
CELL_SQL = {"tight": dict(target="1.0", cap=10, risk="entry * atr_pct / 100 * 0.1"), "wide": dict(target="1.0", cap=20, risk="entry * atr_pct / 100 * 0.4")}
register("T16_cell_grid", "cell:s n:i win:f4 net:f3 median:f3 payoff:f4 pf:f4 stopped:f4 bars:f4 exp_r:f4 days:i per_month:f4", _grid,
         SIMPLE_SQL + ", " + ", ".join(cell_sql(c, True, stop="atr", **x) for c, x in CELL_SQL.items()) + "@@ "
         + " UNION ALL ".join(f"SELECT '{c}' AS cell, {LAB_SQL} FROM tk_{c}" for c in CELL_SQL))

# ------------------------------------------------------------------ aggregations
register("A9_trade_stats", "isin:s n:i target_pct:f4 stop_pct:f4 time_pct:f4 win:f4 avg:f3 avg_win:f3 avg_loss:f3 expectancy_r:f4 profit_factor:f4 avg_bars:f4 avg_risk:f4",
         lambda s, d: stats.bracket_stats(outcome(BRACKET)(s, d), ["isin"]),
         B_SQL + "@@ SELECT isin, count(*) AS n, avg(CASE WHEN why = 'target' THEN 100.0 ELSE 0 END) AS target_pct, avg(CASE WHEN why = 'stop' THEN 100.0 ELSE 0 END) AS stop_pct, "
         "avg(CASE WHEN why = 'time' THEN 100.0 ELSE 0 END) AS time_pct, avg(CASE WHEN gross > 0 THEN 100.0 ELSE 0 END) AS win, avg(gross) AS avg, coalesce(avg(gross) FILTER (gross > 0), 0) AS avg_win, "
         "coalesce(avg(gross) FILTER (gross <= 0), 0) AS avg_loss, avg(r_multiple) AS expectancy_r, sum(gross) FILTER (gross > 0) / -(sum(gross) FILTER (gross <= 0)) AS profit_factor, avg(bars) AS avg_bars, avg(risk_pct) AS avg_risk FROM tr GROUP BY 1")
register("A10_reversal_stats", "isin:s n:i net:f3 win:f4 avg_win:f3 avg_loss:f3 payoff:f4 profit_factor:f4 avg_bars:f4 on_reversal:f4 big_loss:f4 months_up:f4 worst_month:f3",
         lambda s, d: stats.reversal_stats(reversal_trades(s, d)[1], ["isin"]),
         TK + ", mm AS (SELECT isin, date_trunc('month', date) AS mo, avg(net) AS m FROM tk GROUP BY 1, 2), mu AS (SELECT isin, avg(CASE WHEN m > 0 THEN 100.0 ELSE 0 END) AS months_up, min(m) AS worst_month FROM mm GROUP BY 1), "
         "hd AS (SELECT isin, count(*) AS n, avg(net) AS net, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS win, coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net <= 0), 0) AS avg_loss, "
         "coalesce(sum(net) FILTER (net > 0) / -(sum(net) FILTER (net <= 0)), 0) AS profit_factor, avg(bars) AS avg_bars, avg(CASE WHEN why = 'reversal' THEN 100.0 ELSE 0 END) AS on_reversal, avg(CASE WHEN net < -8 THEN 100.0 ELSE 0 END) AS big_loss FROM tk GROUP BY 1) "
         "@@ SELECT hd.*, CASE WHEN avg_loss < 0 THEN avg_win / -avg_loss ELSE 0 END AS payoff, months_up, worst_month FROM hd JOIN mu USING (isin)")


def hits_with_returns(s, d):
    panel = cross.add_forward_returns(cut_lineage(_panel(s, d, SIMPLE)))
    return cut_lineage(ro.hits(panel, SIMPLE, ["isin", "date", *[f"{x}_{k}d" for x in ("exc", "fwd") for k in cross.HORIZONS]], emit=False))


HX = SIMPLE_SQL + f", {FORWARD}, hx AS MATERIALIZED (SELECT h.rule, fx.* FROM ({HITS_SQL}) h JOIN fx ON fx.isin = h.isin AND fx.date = h.date)"
_HS = ("count({e}) AS n, CASE WHEN count({e}) >= 5 THEN avg(CASE WHEN {e} > 0 THEN 100.0 WHEN {e} IS NOT NULL THEN 0 END) END AS win, CASE WHEN count({e}) >= 5 THEN avg({e}) END AS mean, "
       "CASE WHEN count({e}) >= 5 THEN quantile_cont({e}, 0.5) END AS median, CASE WHEN count({e}) >= 5 THEN quantile_cont({e}, 0.25) END AS p25, CASE WHEN count({e}) >= 5 THEN quantile_cont({e}, 0.75) END AS p75, "
       "CASE WHEN count({e}) >= 5 THEN stddev_samp({e}) END AS std, CASE WHEN count({e}) >= 5 THEN avg({f}) END AS raw_mean, CASE WHEN count({e}) >= 5 THEN avg(CASE WHEN {f} > 0 THEN 100.0 WHEN {f} IS NOT NULL THEN 0 END) END AS raw_win")
STAT_COLUMNS = "n:i win:f4 mean:f3 median:f3 p25:f3 p75:f3 std:f2 raw_mean:f3 raw_win:f4"


def _hs(group: str, k: int) -> str:
    return f"SELECT {group}, '{k}' AS horizon, {_HS.format(e=f'exc_{k}d', f=f'fwd_{k}d')} FROM hx GROUP BY ALL"


register("A5_horizon_stats", "rule:s horizon:s " + STAT_COLUMNS,
         lambda s, d: stats.horizon_stats(stats.long_horizons(hits_with_returns(s, d), cross.HORIZONS, ["rule"]), ["rule", "horizon"], "exc", "fwd"),
         HX + "@@ " + " UNION ALL ".join(_hs("rule", k) for k in (1, 5, 20)))
register("A6_histogram", "rule:s bin:i n:i", lambda s, d: stats.histogram(hits_with_returns(s, d), ["rule"], "exc_20d"),
         HX + "@@ SELECT rule, " + " + ".join(f"CASE WHEN exc_20d >= {e} THEN 1 ELSE 0 END" for e in stats.EXCESS_EDGES) + " AS bin, count(*) AS n FROM hx WHERE exc_20d IS NOT NULL GROUP BY 1, 2")
register("A6_equal_width", "bin:i n:i",
         lambda s, d: stats.equal_width_histogram(build_features(panels.week_panel(s, d), ["rsi_14"]), [], "rsi_14", 0, 100, 10),
         SIMPLE_SQL + "@@ SELECT least(floor(rsi_14 / 10), 9) AS bin, count(*) AS n FROM q1 WHERE rsi_14 BETWEEN 0 AND 100 GROUP BY 1")
register("A7_concentration", "rule:s n:i names:i winners:i top10_share:f4 median:f3",
         lambda s, d: stats.concentration(hits_with_returns(s, d), ["rule"], "exc_20d"),
         HX + ", nm AS (SELECT rule, isin, sum(exc_20d) AS s, count(exc_20d) AS c FROM hx WHERE exc_20d IS NOT NULL GROUP BY 1, 2), nr AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY s DESC) AS p FROM nm) "
         "@@ SELECT rule, sum(c) AS n, count(*) AS names, count(*) FILTER (s > 0) AS winners, CASE WHEN sum(greatest(s, 0)) > 0 THEN sum(CASE WHEN p <= 10 THEN greatest(s, 0) ELSE 0 END) / sum(greatest(s, 0)) * 100 END AS top10_share, "
         "(SELECT median(exc_20d) FROM hx z WHERE z.rule = nr.rule) AS median FROM nr GROUP BY rule HAVING sum(c) >= 20")
# Fixed values of the fixture: traded value times 0.03 stands for a size in crore, so that all three bands have members.
def banded():
    return {"cap_band": cap_band(F.col("size")), "year": F.year("date")}


def sized_hits(s, d):
    panel = cross.add_forward_returns(cut_lineage(_panel(s, d, SIMPLE).withColumn("size", F.col("volume") * F.col("adj_close") * 0.03)))
    return cut_lineage(ro.hits(panel, SIMPLE, ["isin", "date", "size", *[f"{x}_{k}d" for x in ("exc", "fwd") for k in cross.HORIZONS]], emit=False))


def _breakdowns(s, d):
    hits = sized_hits(s, d)
    keys = ["rule", "dimension", "group", "horizon"]
    return stats.breakdowns(hits, banded(), cross.HORIZONS).join(stats.breakdown_quartiles(hits, banded(), cross.HORIZONS), keys, "left").withColumnRenamed("group", "part")


_PARTS = {"all": "'all'", "cap_band": "CASE WHEN volume * adj_close * 0.03 >= 100000 THEN 'Mega' WHEN volume * adj_close * 0.03 >= 20000 THEN 'Large' ELSE 'Mid' END", "year": "CAST(year(date) AS VARCHAR)"}
register("A8_breakdowns", "rule:s dimension:s part:s horizon:s " + STAT_COLUMNS, _breakdowns,
         HX + "@@ " + " UNION ALL ".join(_hs(f"rule, '{n}' AS dimension, {x} AS part", k) for n, x in _PARTS.items() for k in (1, 5, 20)))
register("A8_by_year", "rule:s year:s horizon:s " + STAT_COLUMNS,
         lambda s, d: stats.breakdown(hits_with_returns(s, d), F.year("date").cast("string"), cross.HORIZONS).withColumnRenamed("group", "year"),
         HX + "@@ " + " UNION ALL ".join(_hs("rule, CAST(year(date) AS VARCHAR) AS year", k) for k in (1, 5, 20)))
register("A8_years_positive", "rule:s years_positive:i years_total:i",
         lambda s, d: stats.years_positive(stats.breakdown(hits_with_returns(s, d), F.year("date").cast("string"), [20])),
         HX + ", yy AS (SELECT rule, year(date) AS y, CASE WHEN count(exc_20d) >= 5 THEN avg(exc_20d) END AS m FROM hx GROUP BY 1, 2) @@ SELECT rule, count(*) FILTER (m > 0) AS years_positive, count(*) AS years_total FROM yy WHERE m IS NOT NULL GROUP BY 1")
register("A11_consistency", "months:i months_up:f4 worst_month:f3 losing_run:i sharpe:f4 per_slot_month:f4",
         lambda s, d: stats.consistency(reversal_trades(s, d)[1], [], "net"),
         TK + ", mm AS (SELECT date_trunc('month', date) AS mo, avg(net) AS m, count(*) AS k FROM tk GROUP BY 1), mf AS (SELECT *, row_number() OVER (ORDER BY mo) AS p FROM mm WHERE k >= 5), "
         "ms AS (SELECT *, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER (ORDER BY mo) AS g FROM mf), rl AS (SELECT g, count(*) FILTER (m <= 0) AS l FROM ms GROUP BY 1) "
         "@@ SELECT count(*) AS months, avg(CASE WHEN m > 0 THEN 100.0 ELSE 0 END) AS months_up, min(m) AS worst_month, (SELECT max(l) FROM rl) AS losing_run, avg(m) / stddev_samp(m) * sqrt(12) AS sharpe, "
         "(SELECT avg(net) * 21 / greatest(avg(bars), 1) FROM tk) AS per_slot_month FROM mf")
register("A12_quarters", "isin:s quarters_tested:i quarters_positive:i worst_quarter:f3 quarter_pass:i",
         lambda s, d: stats.quarter_verdict(stats.quarter_table(reversal_trades(s, d)[1], ["isin"]), ["isin"]),
         TK + ", qt AS (SELECT isin, date_trunc('quarter', date) AS q, avg(net) AS m FROM tk GROUP BY 1, 2) @@ SELECT isin, count(*) AS quarters_tested, count(*) FILTER (m > 0) AS quarters_positive, min(m) AS worst_quarter, "
         "CASE WHEN count(*) FILTER (m > 0) * 1.0 / count(*) >= 0.6 AND min(m) > -8 THEN 1 ELSE 0 END AS quarter_pass FROM qt GROUP BY 1")
EXC = TK + (", pm AS (SELECT k.isin, k.t, min(b.adj_low) AS lo, max(b.adj_high) AS hi FROM tk k JOIN bars b ON b.isin = k.isin AND b.r BETWEEN k.t + 1 AND k.t + k.ki GROUP BY 1, 2), "
            "te AS MATERIALIZED (SELECT tk.*, (least(lo, exit) / entry - 1) * 100 AS mae, (greatest(hi, exit) / entry - 1) * 100 AS mfe FROM tk JOIN pm ON pm.isin = tk.isin AND pm.t = tk.t)")
register("A13_excursion_report", "side:s n:i mae_p25:f3 mae_med:f3 mae_p75:f3 mae_p90:f3 mfe_med:f3",
         lambda s, d: stats.excursion_report(reversal_trades(s, d)[1], []),
         EXC + "@@ SELECT CASE WHEN net > 0 THEN 'winners' ELSE 'losers' END AS side, count(*) AS n, quantile_cont(mae, 0.25) AS mae_p25, quantile_cont(mae, 0.5) AS mae_med, quantile_cont(mae, 0.75) AS mae_p75, "
         "quantile_cont(mae, 0.9) AS mae_p90, quantile_cont(mfe, 0.5) AS mfe_med FROM te GROUP BY 1")
register("A13_breach_shares", "width:f1 breached:f4",
         lambda s, d: stats.breach_shares(reversal_trades(s, d)[1], [], [3, 5, 8, 10, 15]),
         EXC + "@@ SELECT w AS width, avg(CASE WHEN mae <= -w THEN 100.0 ELSE 0 END) AS breached FROM te, (VALUES (3.0), (5.0), (8.0), (10.0), (15.0)) v(w) WHERE net > 0 GROUP BY 1")
register("A14_modes", "isin:s mode:s nunique:i n:i", lambda s, d: stats.modes(reversal_trades(s, d)[1], ["isin"], "why"),
         TK + ", c AS (SELECT isin, why, count(*) AS k FROM tk GROUP BY 1, 2) @@ SELECT isin, first(why ORDER BY k DESC, why) AS mode, count(*) AS nunique, max(k) AS n FROM c GROUP BY 1")
register("A15_survivorship", "size_group:s n:i win:f4 net:f3",
         lambda s, d: stats.survivorship(reversal_trades(s, d)[1].withColumn("size", F.col("volume") * F.col("adj_close")), [], "size", 300_000.0),
         TK + "@@ SELECT CASE WHEN b.volume * b.adj_close >= 300000 THEN 'above' ELSE 'below' END AS size_group, count(*) AS n, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0 END) AS win, avg(net) AS net FROM tk JOIN bars b ON b.isin = tk.isin AND b.r = tk.t GROUP BY 1")
register("A17_crowding", KEY + "same_day:i", lambda s, d: stats.crowding(reversal_trades(s, d)[1], []),
         TK + "@@ SELECT isin, date, count(*) OVER (PARTITION BY date) AS same_day FROM tk")
register("J9_future_path", KEY + "k:i adj_close:f4",
         lambda s, d: (lambda p: oc.future_path(p, signals(p).select("isin", "r", "date", "sid"), 3))(positioned(s, d)),
         SIMPLE_SQL + "@@ SELECT a.isin, a.date, b.r - a.r AS k, b.adj_close FROM q1 a JOIN q1 b ON b.isin = a.isin AND b.r BETWEEN a.r + 1 AND a.r + 3 WHERE a.adj_close < a.lo7")
