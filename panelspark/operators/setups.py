"""Named setups and entry variants built from windows, events and the future path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import flag, holds, pct, ratio
from ..functions.events import last_value_at, rows_since, run_length
from ..functions.windows import PANEL as S
from .calendar import previous_year_levels
from .outcomes import future_path
from .rules import Rule, hits


def alternative_entry(panel: DataFrame, signals: DataFrame, kind: str, within: int) -> DataFrame:
    """When and at what price a signal is filled under another entry; unfilled signals keep null.

    limit      buy 2 % under the signal close (or the open if lower) on a row that trades there
    confirm    next open after the first close above the previous row's high
    shakeout   next open after the first row with a lower low and a higher close
    retest     back to the signal close without closing under the signal low first
    hold_break above the signal high once three rows have held the signal low
    """
    base = signals.filter(F.col("r") < F.col("last_r")).select(
        "sid", "isin", "date", "r", F.col("adj_close").alias("s_close"), F.col("adj_low").alias("s_low"), F.col("adj_high").alias("s_high"))
    look = panel.withColumns({"prev_high": S.lag(F.col("adj_high")), "prev_low": S.lag(F.col("adj_low")), "prev_close": S.lag(F.col("adj_close"))})
    path = future_path(look, base, within, ["prev_high", "prev_low", "prev_close"])
    k, o, low, high, close = (F.col(c) for c in ("k", "adj_open", "adj_low", "adj_high", "adj_close"))
    if kind == "limit":
        level = F.col("s_close") * 0.98
        hit, price, at = low <= level, F.when(o <= level, o).otherwise(level), k
    elif kind == "confirm":
        hit, price, at = (close > F.col("prev_high")) & F.col("next_open").isNotNull(), F.col("next_open"), k + 1
    elif kind == "shakeout":
        hit = (low < F.col("prev_low")) & (close > F.col("prev_close")) & F.col("next_open").isNotNull()
        price, at = F.col("next_open"), k + 1
    elif kind in ("retest", "hold_break"):
        walk = Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        if kind == "retest":
            touched = low <= F.col("s_close")
            path = path.withColumn("__first", F.min(F.when(touched, k)).over(walk))
            price, at = F.least(F.col("s_close"), o), k
            hit = (F.col("__first") == k) & (close > F.col("s_low")) & (price > F.col("s_low"))
        else:
            path = path.withColumn("__broken", F.max((low < F.col("s_low")).cast("int")).over(walk))
            hit = (F.col("__broken") == 0) & (k >= 3) & (high > F.col("s_high"))
            price, at = F.greatest(F.col("s_high"), o), k
    else:
        raise ValueError(f"unknown entry {kind}")
    first = F.min(F.when(holds(hit), F.struct(at.alias("k"), price.alias("p"))))
    found = path.groupBy("sid", "isin", "date", "r").agg(first.alias("__e"))
    return found.select("sid", "isin", "date", "r", F.col("__e.k").alias("entry_k"), F.col("__e.p").alias("entry"))


def monthly_rotation(panel: DataFrame, score: str, n: int) -> DataFrame:
    """Hold the ``n`` best names by month-end score to the next month end, beside the mean of all names."""
    month = F.trunc("date", "month")
    ends = panel.groupBy("isin", month.alias("month")).agg(F.max_by("adj_close", "date").alias("c"), F.max_by(score, "date").alias("sc"))
    w = Window.partitionBy("isin").orderBy("month")
    ends = ends.withColumn("fwd", ratio(F.lead("c").over(w), F.col("c")) - 1)
    bench = ends.groupBy("month").agg((F.avg("fwd") * 100).alias("bench"))
    rank = Window.partitionBy("month").orderBy(F.col("sc").desc(), "isin")
    held = ends.filter(F.col("sc").isNotNull()).withColumn("__p", F.row_number().over(rank)).filter(F.col("__p") <= n)
    out = held.groupBy("month").agg(F.count("fwd").alias("names"), (F.avg("fwd") * 100).alias("ret"))
    return out.filter(F.col("names") > 0).join(bench, "month")


def fired(panel: DataFrame, setups: dict[str, Column], base: Column | None = None, name: str = "setup") -> DataFrame:
    """(isin, date, r, setup) of every setup that holds, all in one scan."""
    entries = [F.when(holds(x if base is None else x & base), F.lit(n)) for n, x in setups.items()]
    return panel.select("isin", "date", "r", F.explode(F.array_compact(F.array(*entries))).alias(name))


# ------------------------------------------------------------------ bottoms
BOTTOM_COLUMNS = ["pct_from_52w_high", "pct_from_52w_low", "vol_ratio", "close_pos", "ret_1d", "rsi_2", "rsi_14", "bb_lower", "sma_50",
                  "sma_200", "sma_200_slope", "lo_20_prior", "high_52w", "low10_incl", "dist_sma_200"]


def double_bottom(panel: DataFrame, least: int = 15, most: int = 60, depth: float = -0.25, tolerance: float = 0.03) -> DataFrame:
    """``double_bottom``: a deep swing low 15..60 rows ago, a second low within 3 % of it, and a close above every high between.

    Swing lows are sparse, so each one is followed along its own future; hits within five rows of an
    earlier hit are dropped. The swing test looks five rows ahead, which is past by the time it is used.
    """
    low, high, close = F.col("adj_low"), F.col("adj_high"), F.col("adj_close")
    around = S.spec.rowsBetween(-5, 5)
    swing = (F.count(low).over(around) == 11) & (low <= F.min(low).over(around) + 1e-9)
    looked = panel.withColumns({
        "__swing": holds(swing) & holds(low / F.col("high_52w") - 1 <= depth), "last_r": F.max("r").over(Window.partitionBy("isin")),
        "next_open": S.lead(F.col("adj_open"))})
    lows = looked.filter("__swing").select("isin", "r", low.alias("first_low"), F.concat_ws("|", "isin", "r").alias("sid"))
    path = future_path(looked, lows, most, ["low10_incl", "high_52w"])
    between = F.max(high).over(Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    path = path.withColumn("__peak", between).filter(F.col("k") >= least)
    second = F.col("low10_incl")
    match = (F.abs(second / F.col("first_low") - 1) <= tolerance) & (second / F.col("high_52w") - 1 <= depth) & (close > F.col("__peak"))
    found = path.filter(holds(match)).select("isin", (F.col("r") + F.col("k")).alias("r")).distinct().withColumn("__g", F.lit(1))
    out = panel.join(found, ["isin", "r"], "left").withColumn("__g", F.coalesce("__g", F.lit(0)))
    recent = F.coalesce(F.sum("__g").over(S.frame(5, prior=True)), F.lit(0))
    return out.withColumn("double_bottom", ((F.col("__g") == 1) & (recent == 0)).cast("int")).drop("__g")


def bottom_setups(panel: DataFrame, week_end: Column | None = None) -> DataFrame:
    """The ten bottom patterns A..J (E2 adds a rising average to E), one row per (row, setup)."""
    close, low, prev = F.col("adj_close"), F.col("adj_low"), S.lag(F.col("adj_close"))
    df = double_bottom(panel).withColumns({
        "__down": run_length(F.col("ret_1d") < 0), "__below": run_length(close < F.col("sma_200")),
        "week_end": (F.coalesce(F.trunc(S.lead(F.col("date")), "week") != F.trunc("date", "week"), F.lit(True)) if week_end is None else week_end),
        "__pc": prev, "__rsi2p": S.lag(F.col("rsi_2")), "__rsi14p": S.lag(F.col("rsi_14")), "__rsi14p3": S.lag(F.col("rsi_14"), 3),
        "__bbp": S.lag(F.col("bb_lower")), "__lowp": S.lag(F.col("pct_from_52w_low"))})
    df = df.withColumns({"__downp": S.lag(F.col("__down")), "__belowp": S.lag(F.col("__below"))})
    # Weekly closes under the 50-row average: runs counted over week-end rows only.
    weeks = Window.partitionBy("isin").orderBy("date")
    ends = df.filter("week_end").select("isin", "date", holds(close < F.col("sma_50")).cast("int").alias("__b"))
    ends = ends.withColumn("__p", F.row_number().over(weeks))
    last_up = F.max(F.when(F.col("__b") == 0, F.col("__p"))).over(weeks.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("__run", F.col("__p") - F.coalesce(last_up, F.lit(0)))
    ends = ends.select("isin", "date", F.lag("__run").over(weeks).alias("__weeks"))
    df = df.join(ends, ["isin", "date"], "left")
    e = (F.col("__belowp") >= 40) & (close > F.col("sma_200"))
    setups = {
        "A": (F.col("pct_from_52w_high") <= -30) & (F.col("vol_ratio") >= 3) & (F.col("close_pos") >= 0.7) & (close > F.col("__pc")),
        "B": (F.col("__downp") >= 5) & (F.col("__rsi2p") < 5) & (close > F.col("__pc")),
        "C": (F.col("__rsi14p") < 30) & (F.col("rsi_14") >= 30),
        "D": (F.col("__pc") < F.col("__bbp")) & (close >= F.col("bb_lower")),
        "E": e, "E2": e & (F.col("sma_200_slope") >= 0),
        "F": (low < F.col("lo_20_prior")) & (close > F.col("lo_20_prior")),
        "G": F.col("double_bottom") == 1,
        "H": (F.col("dist_sma_200") <= -25) & (F.col("rsi_14") > F.col("__rsi14p3")),
        "I": F.col("week_end") & (F.col("__weeks") >= 8) & (close > F.col("sma_50")),
        "J": (F.col("__lowp") <= 5) & (F.col("ret_1d") >= 4) & (F.col("vol_ratio") >= 2),
    }
    return fired(df, setups)


def with_twists(found: DataFrame, panel: DataFrame) -> DataFrame:
    """Each setup again as ``_ldr`` (relative strength at least 60) and ``_wash`` (washed-out market)."""
    state = panel.select("isin", "date", "rs_rank", "mkt_washout")
    joined = found.join(state, ["isin", "date"])
    names = F.array_compact(F.array(F.col("setup"), F.when(F.col("rs_rank") >= 60, F.concat("setup", F.lit("_ldr"))), F.when(F.col("mkt_washout") < 30, F.concat("setup", F.lit("_wash")))))
    return joined.select("isin", "date", "r", F.explode(names).alias("setup"))


# ------------------------------------------------------------------ failed highs and gaps
def failed_high(bars: DataFrame) -> DataFrame:
    """Pushes into the 60-row high that do not close through it: starts in the prior 30 rows and a lower second push."""
    high, close = F.col("adj_high"), F.col("adj_close")
    df = bars.withColumn("hi60", S.highest(high, 60, prior=True))
    df = df.withColumn("__near", holds((high >= F.col("hi60") * 0.98) & (close <= F.col("hi60"))))
    df = df.withColumn("push_start", F.col("__near") & ~F.coalesce(S.lag(F.col("__near")), F.lit(False)))
    df = df.withColumns({"pushes_30": S.total(F.col("push_start").cast("int"), 30, prior=True),
                         "last_push": last_value_at(high, F.col("push_start"), before=True)})
    lower = (F.col("pushes_30") >= 2) & (F.col("last_push") < S.lag(F.col("last_push")))
    return df.withColumns({"lower_high": flag(lower), "below_high": (F.lit(1) - ratio(close, F.col("hi60"))) * 100}).drop("__near")


def gap_pattern(panel: DataFrame, valid: int, cap: int, buffer_pct: float, rr: float = 2.0, min_gap_pct: float | None = None) -> DataFrame:
    """Three-row gaps traded on the first retrace into the gap.

    fvg: an up gap (low above the high two rows back) behind an up row; ifvg: a down gap later closed
    above. The zone dies when a row closes below it or opens below it; the stop sits under the zone, the
    target at ``rr`` times the risk, risk at most a fifth of the entry. One open trade per key and kind.
    """
    o, h, low, c, k = (F.col(n) for n in ("adj_open", "adj_high", "adj_low", "adj_close", "k"))
    df = panel.withColumns({"__h2": S.lag(h, 2), "__l2": S.lag(low, 2), "__c1": S.lag(c), "__o1": S.lag(o)})
    up, down = holds((low > F.col("__h2")) & (F.col("__c1") > F.col("__o1"))), holds(h < F.col("__l2"))
    zones = df.filter(up | down).select(
        "isin", "date", "r", "last_r", F.when(up, "fvg").otherwise("ifvg").alias("kind"),
        F.when(up, F.col("__h2")).otherwise(h).alias("bottom"), F.when(up, low).otherwise(F.col("__l2")).alias("top"), c.alias("s_close"))
    if min_gap_pct is not None:
        zones = zones.filter((F.col("top") - F.col("bottom")) / F.col("s_close") * 100 >= min_gap_pct)
    zones = zones.withColumns({"sid": F.concat_ws("|", "kind", "isin", "r"), "stop": F.col("bottom") - F.col("top") * (buffer_pct / 100)})
    path = future_path(panel, zones, 2 * valid + cap + 1)
    whole = Window.partitionBy("sid")
    path = path.withColumn("__inv", F.min(F.when((c > F.col("top")) & (k <= valid), k)).over(whole))
    path = path.withColumn("start_k", F.when(F.col("kind") == "fvg", F.lit(1)).otherwise(F.col("__inv") + 1)).filter("start_k is not null")
    inside = (k >= F.col("start_k")) & (k < F.col("start_k") + valid)
    path = path.withColumns({"__dead": F.min(F.when(inside & (c < F.col("bottom")), k)).over(whole), "entry_k": F.min(F.when(inside & (low <= F.col("top")), k)).over(whole)})
    path = path.filter(F.col("entry_k").isNotNull() & (F.col("entry_k") < F.coalesce("__dead", F.lit(10**9))))
    first = F.when(k == F.col("entry_k"), F.struct(o.alias("o"), F.least(o, F.col("top")).alias("e")))
    path = path.withColumn("__f", F.max(first).over(whole)).filter(F.col("__f.o") >= F.col("bottom"))
    path = path.withColumn("entry", F.col("__f.e")).withColumn("risk", F.col("entry") - F.col("stop"))
    path = path.filter((F.col("risk") > 0) & (F.col("risk") / F.col("entry") <= 0.2) & k.between(F.col("entry_k"), F.col("entry_k") + cap))
    goal, on_entry = F.col("entry") + F.col("risk") * rr, k == F.col("entry_k")
    stopped = low <= F.col("stop")
    won = (h >= goal) & (~on_entry | (c >= goal))
    stop_price = F.when(on_entry, F.least(o, F.col("stop"))).otherwise(F.col("stop"))
    event = F.when(stopped, F.struct(k.alias("k"), stop_price.alias("p"), F.lit("stop").alias("why"))).when(
        won, F.struct(k.alias("k"), goal.alias("p"), F.lit("target").alias("why")))
    out = path.groupBy("sid", "isin", "date", "r", "kind", "start_k", "entry_k", "entry", "risk").agg(
        F.min(event).alias("__e"), F.max(F.struct(k.alias("k"), c.alias("p"), F.lit("time").alias("why"))).alias("__t"))
    end = F.coalesce("__e", "__t")
    out = out.withColumns({"exit": end["p"], "why": end["why"], "exit_r": F.col("r") + end["k"], "start_r": F.col("r") + F.col("start_k")})
    out = out.withColumn("r_multiple", (F.col("exit") - F.col("entry")) / F.col("risk")).drop("__e", "__t")
    from .outcomes import one_open_per_key
    return one_open_per_key(out, ["isin", "kind"], "start_r", "exit_r")


# ------------------------------------------------------------------ dips, retests, volume, ladders
DIP_COLUMNS = ["new_lo7", "rsi_2", "ema_9", "ema_21", "ema_50", "m_cpr_tc", "m_cpr_bc", "hi_20_prior", "sma_50", "sma_200", "bb_pct_b"]


def dip_setups(panel: DataFrame) -> DataFrame:
    """Nine dips inside an uptrend (close above the 200-row average)."""
    c, low, high = F.col("adj_close"), F.col("adj_low"), F.col("adj_high")

    df = panel.withColumns({"__c1": S.lag(c), "__c2": S.lag(c, 2), "__c3": S.lag(c, 3), "__c5": S.lag(c, 5),
                            **{f"__over_{e}": S.total(flag(c > F.col(e)), n, prior=True) == n for e, n in (("ema_9", 3), ("ema_21", 5), ("ema_50", 5))}})
    crosses = lambda e: (low <= F.col(e)) & (high >= F.col(e)) & F.col(f"__over_{e}")
    off = pct(c, F.col("hi_20_prior"))
    return fired(df, {
        "d7": F.col("new_lo7") == 1, "rsi2": F.col("rsi_2") < 10, "ema9": (c < F.col("ema_9")) & F.col("__over_ema_9"),
        "ema21": crosses("ema_21"), "ema50": crosses("ema_50"),
        "cpr": (low <= F.col("m_cpr_tc")) & (c >= F.col("m_cpr_bc")) & (F.col("__c5") > F.col("m_cpr_tc")),
        "down3": (c < F.col("__c1")) & (F.col("__c1") < F.col("__c2")) & (F.col("__c2") < F.col("__c3")),
        "off20": off.between(-12, -5) & (c > F.col("sma_50")), "bb": F.col("bb_pct_b") < 0.1}, c > F.col("sma_200"))


def first_trigger(panel: DataFrame, signals: DataFrame, within: int = 5) -> DataFrame:
    """Move each signal to the first later row that closes above the previous row's high; others are dropped."""
    from .outcomes import with_position
    found = alternative_entry(with_position(panel), signals, "confirm", within)
    return found.filter(F.col("entry_k").isNotNull()).select("sid", "isin", (F.col("r") + F.col("entry_k") - 1).alias("trigger_r"))


RETEST_COLUMNS = ["sma_50", "ema_50", "sma_200", "sma_200_slope", "dist_sma_50"]


def level_retests(panel: DataFrame) -> DataFrame:
    """Retests of rising averages and of the previous year's pivots."""
    c, low = F.col("adj_close"), F.col("adj_low")
    df = previous_year_levels(panel).withColumns({"__pc": S.lag(c), "__low3": S.lowest(low, 3), "__ext": S.highest(F.col("dist_sma_50"), 20, prior=True),
                                                  "__d50": pct(c, F.col("ema_50")), "__over": flag(c > F.col("sma_200"))})
    df = df.withColumns({"__ext_e": S.highest(F.col("__d50"), 20, prior=True), "__over60": S.lowest(F.col("__over"), 60, prior=True),
                         "py_r1": F.col("py_pivot") * 2 - F.col("py_low"), "py_s1": F.col("py_pivot") * 2 - F.col("py_high")})
    df = df.withColumn("__since", rows_since(flag(c > F.col("py_r1")) > F.coalesce(S.lag(flag(c > F.col("py_r1"))), F.lit(1))))
    near = lambda x: (F.col("__low3") <= F.col(x) * 1.02) & (F.col("__low3") >= F.col(x) * 0.98)
    up, rising = c > F.col("__pc"), F.col("sma_200_slope") > 0
    s50, e50, s200 = F.col("sma_50"), F.col("ema_50"), F.col("sma_200")
    return fired(df, {
        "sma50_retest": (s50 > s200) & rising & (F.col("__ext") >= 8) & (low <= s50 * 1.01) & (c > s50) & up,
        "ema50_retest": (e50 > s200) & rising & (F.col("__ext_e") >= 8) & (low <= e50 * 1.01) & (c > e50) & up,
        "sma200_retest": rising & (F.col("__over60") == 1) & (low <= s200 * 1.02) & (c > s200) & up,
        "yr_p_retest": (c > F.col("py_pivot")) & near("py_pivot") & up, "yr_s1_retest": (c > F.col("py_s1")) & near("py_s1") & up,
        "yr_r1_retest": (c > F.col("py_r1")) & F.col("__since").between(2, 30) & near("py_r1") & up})


VOLUME_COLUMNS = ["vol_ratio", "close_hi_20", "sma_50", "sma_200", "dist_ema_21", "lo_20_prior", "ret_5d"]


def volume_setups(panel: DataFrame) -> DataFrame:
    """Eight volume patterns: dry-up and spike breakouts, pocket pivot, accumulation, spring, climax, support, money-flow cross."""
    c, h, low, v = (F.col(n) for n in ("adj_close", "adj_high", "adj_low", "volume"))
    prev = S.lag(c)
    place = (c - low) / (h - low + 1e-9)
    df = panel.withColumns({"__pc": prev, "__place": place, "__mfv": v * (place * 2 - 1), "__hi60": S.highest(c, 60, prior=True),
                            "__signed": F.when(c > prev, v).when(c < prev, -v).otherwise(F.lit(0)), "__dv": F.when(c < prev, v).otherwise(F.lit(0)),
                            "__v3": S.highest(F.col("vol_ratio"), 3, prior=True), "__dry": S.median(F.col("vol_ratio"), 20)})
    df = df.withColumns({"__obv": F.sum("__signed").over(S.so_far()), "__cmf": ratio(S.total(F.col("__mfv"), 20), S.total(v, 20)), "__dv10": S.highest(F.col("__dv"), 10, prior=True)})
    df = df.withColumns({"__obv60": S.highest(F.col("__obv"), 60, prior=True), "__cmfp": S.lag(F.col("__cmf"))})
    up, trend, ratio_v = c > F.col("__pc"), c > F.col("sma_200"), F.col("vol_ratio")
    return fired(df, {
        "dry-up breakout": (F.col("__dry") < 0.9) & (c > F.col("close_hi_20")) & (ratio_v >= 2) & trend,
        "volume spike breakout": (c > F.col("close_hi_20")) & (ratio_v >= 3) & trend,
        "pocket pivot": up & (v > F.col("__dv10")) & (c > F.col("sma_50")) & (F.col("dist_ema_21") <= 15) & trend,
        "accumulation before price": (F.col("__obv") > F.col("__obv60")) & (c < F.col("__hi60")) & trend,
        "spring": (low < F.col("lo_20_prior")) & (c > F.col("lo_20_prior")) & (ratio_v >= 2) & trend,
        "selling climax": (F.col("ret_5d") <= -8) & (ratio_v >= 3) & (F.col("__place") >= 0.7) & up,
        "dry-up at support": c.between(F.col("sma_50") * 0.98, F.col("sma_50") * 1.02) & (F.col("__v3") < 0.7) & (ratio_v >= 1.5) & up & trend,
        "money flow cross": (F.col("__cmf") > 0) & (F.col("__cmfp") <= 0) & trend})


LADDER_COLUMNS = ["ema_9", "ema_21", "ema_50", "sma_50", "sma_150", "sma_200", "sma_200_slope", "vol_vs_ema21", "vol_ema_21", "close_pos", "base_range_60",
                  "m_cpr_tc", "m_cpr_bc", "m_p", "m_cpr_width_rank", "ret_1d"]

# Variant ladders; each step adds a clause to its base.
LADDERS: dict[str, tuple[str, dict[str, str]]] = {
    "ema_reclaim": ("adj_close > sma_200 and sma_200_slope > 0 and below21_prev and adj_close > ema_9 and adj_close > ema_21 and adj_close > ema_50", {
        "A": "true", "B": "vol_vs_ema21 >= 1.0", "C": "vol_vs_ema21 >= 1.5", "D": "vol_vs_ema21 >= 2.0", "E": "vol_vs_ema21 >= 1.5 and close_pos >= 0.6",
        "F": "vol_vs_ema21 >= 1.5 and close_pos >= 0.6 and below21_5 >= 3", "G": "vol_vs_ema21 >= 1.5 and close_pos >= 0.6 and below21_5 >= 3 and ema_21 > ema_50"}),
    "dry_pullback": ("adj_close > sma_200 and below9_3 and adj_close > ema_9 and adj_close > prev_high", {
        "pullback": "true", "held": "low10 > ema_50", "dry": "low10 > ema_50 and vol5_prev <= 0.7 * vol_ema_21",
        "anchored": "low10 > ema_50 and vol5_prev <= 0.7 * vol_ema_21 and since_power between 5 and 60 and adj_close > power_low"}),
    "base_turn": ("adj_close < sma_200 and base_range_60 <= 20", {"base": "true", "cross50": "cross50", "cross150": "cross150"}),
    "cpr_pullback": ("adj_close > sma_200 and sma_200_slope > 0 and close_5 > m_cpr_tc and adj_low <= m_cpr_tc and adj_close >= m_cpr_bc", {
        "A": "true", "B": "adj_low <= m_p", "C": "adj_low <= m_p and adj_close >= m_p", "E": "adj_low <= m_p and adj_close >= m_p and adj_close > adj_open and close_pos >= 0.5",
        "G": "adj_low <= m_p and adj_close >= m_p and m_cpr_width_rank <= 0.3", "H": "adj_low <= m_p and adj_close >= m_p and m_cpr_width_rank >= 0.7",
        "I": "adj_low <= m_p and adj_close >= m_p and vol_vs_ema21 < 0.8", "J": "adj_low <= m_p and adj_close >= m_p and adj_close > ema_50"}),
}


def ladder_columns(panel: DataFrame) -> DataFrame:
    c, low = F.col("adj_close"), F.col("adj_low")
    power = holds((F.col("ret_1d") >= 8) & (F.col("vol_vs_ema21") >= 3))
    df = panel.withColumns({"__b21": flag(c < F.col("ema_21")), "__b9": flag(c < F.col("ema_9")), "__power": power})
    return df.withColumns({
        "below21_prev": S.lag(F.col("__b21")) == 1, "below21_5": S.total(F.col("__b21"), 5, 1, prior=True), "below9_3": S.total(F.col("__b9"), 3, prior=True) == 3,
        "low10": S.lowest(low, 10), "vol5_prev": S.mean(F.col("volume"), 5, prior=True), "prev_high": S.lag(F.col("adj_high")), "close_5": S.lag(c, 5),
        "power_low": last_value_at(low, F.col("__power")), "since_power": rows_since(F.col("__power")),
        **{f"cross{n}": holds((c > F.col(f"sma_{n}")) & (S.lag(c) <= S.lag(F.col(f"sma_{n}")))) for n in (50, 150)}})


def ladder_rules() -> list[Rule]:
    return [Rule(f"{ladder}|{step}", f"({base}) and ({clause})") for ladder, (base, steps) in LADDERS.items() for step, clause in steps.items()]


def ladder_hits(panel: DataFrame) -> DataFrame:
    """How often each variant of each ladder fires."""
    found = hits(ladder_columns(panel), ladder_rules(), ["isin", "date"], apply_floors=False, emit=False)
    return found.groupBy(F.col("rule").alias("variant")).agg(F.count(F.lit(1)).alias("hits"))
