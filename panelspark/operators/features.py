"""The per-key feature panel: about 130 rolling, recursive, event and calendar-level columns.

Every window shares ``partitionBy(isin).orderBy(date)``, so the whole panel costs one exchange and
one sort plus a local sort per recursion decay. Columns are added in stages because a window cannot
nest inside another; Catalyst prunes the stages a query does not ask for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import clip, flag, holds, month_start, nonzero, pct, pivot_levels, ratio, week_friday, week_monday
from ..functions.events import crossed_above, last_value_at, rows_since, segment
from ..functions.ewm import Spec, blank_head, ewm_scan, span_alpha
from ..functions.windows import BLOCK, PANEL as S, by_key


def prices() -> list[Column]:
    """Close, high, low, open and volume (columns exist only inside a session)."""
    return [F.col(n) for n in ("adj_close", "adj_high", "adj_low", "adj_open", "volume")]


Thunks = dict[str, Callable[[], Column]]

# Column parameters of the panel.
SMA_SPANS = (10, 20, 50, 150, 200)
EMA_SPANS = (9, 21, 50, 200)
RETURN_SPANS = (1, 5, 20, 60, 120, 250)
CROSS_LEVELS = ("m_cpr_tc", "w_cpr_tc", "m_p", "m_r1")
DISTANCE_LEVELS = ("m_cpr_tc", "m_p", "m_r1", "m_r2", "w_cpr_tc")


def c(name: str) -> Column:
    return F.col(name)


def _inputs() -> Thunks:
    """Lags and short extremes that later stages read."""
    C, H, L, O, V = prices()
    return {
        "r": lambda: S.row(),
        "__v": lambda: V.cast("double"),
        "__pc": lambda: S.lag(C), "__ppc": lambda: S.lag(C, 2), "__ph": lambda: S.lag(H), "__pl": lambda: S.lag(L), "__po": lambda: S.lag(O),
        "__hb": lambda: S.highest(H, BLOCK, 1), "__lb": lambda: S.lowest(L, BLOCK, 1),
        "__cbx": lambda: S.highest(C, BLOCK, 1), "__cbn": lambda: S.lowest(C, BLOCK, 1),
    }


def _changes() -> Thunks:
    """Inputs of the recursions, and the breakout events that cut a key into stretches."""
    C, H, L, O, V = prices()
    pc = c("__pc")
    change = C - pc
    return {
        "__d": lambda: change,
        "__gain": lambda: F.when(change > 0, change).when(change.isNotNull(), 0.0),
        "__loss": lambda: F.when(change < 0, -change).when(change.isNotNull(), 0.0),
        "__tr": lambda: F.greatest(H - L, F.abs(H - pc), F.abs(L - pc)),
        "hi_60_prior": lambda: S.wide(F.greatest, H, c("__hb"), 60, 30, prior=True),
    }


def _breakouts() -> Thunks:
    C, H, L, O, V = prices()
    return {"__brk": lambda: crossed_above(C, c("hi_60_prior"))}


def _stretches() -> Thunks:
    brk = c("__brk")
    return {
        "brk_level": lambda: last_value_at(c("hi_60_prior"), brk), "__seg": lambda: segment(brk),
        "since_brk_60": lambda: rows_since(brk),
    }


def _inside_stretches() -> Thunks:
    """Windows that start at each breakout; they need a sort of their own, so they come while rows are narrow."""
    C, H, L, O, V = prices()
    seg = Window.partitionBy("isin", "__seg").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return {
        "low_since_brk": lambda: F.min(L).over(seg),
        "closes_above_brk": lambda: F.sum(flag(C > c("brk_level"))).over(seg),
    }


def _base() -> Thunks:
    """Rolling extremes and averages: everything one window deep."""
    C, H, L, O, V = prices()
    volume = c("__v")
    columns = {f"sma_{n}": (lambda n=n: S.mean(C, n)) for n in SMA_SPANS}
    columns |= {f"ret_{n}d": (lambda n=n: pct(C, S.lag(C, n))) for n in RETURN_SPANS}
    columns |= {
        "__std20": lambda: S.std(C, 20, population=True),
        "mom_12_1": lambda: pct(S.lag(C, 22), S.lag(C, 252)),
        "high_52w": lambda: S.wide(F.greatest, H, c("__hb"), 250, 60),
        "low_52w": lambda: S.wide(F.least, L, c("__lb"), 250, 60),
        "off_high_10": lambda: pct(C, S.highest(H, 10, 5)),
        "hi_20_prior": lambda: S.highest(H, 20, 10, prior=True),
        "hi_250_prior": lambda: S.wide(F.greatest, H, c("__hb"), 250, 60, prior=True),
        "lo_20_prior": lambda: S.lowest(L, 20, 10, prior=True),
        "base_hi_60": lambda: S.wide(F.greatest, H, c("__hb"), 60, 40, prior=True),
        "__base_lo": lambda: S.wide(F.least, L, c("__lb"), 60, 40, prior=True),
        "lo7_prior": lambda: S.lowest(C, 7, prior=True),
        "hi7_prior": lambda: S.highest(C, 7, prior=True),
        "close_hi_20": lambda: S.highest(C, 20, prior=True),
        "close_hi_500": lambda: S.wide(F.greatest, C, c("__cbx"), 500, prior=True),
        "close_pos": lambda: clip(ratio(C - L, nonzero(H - L)), 0, 1),
        "gap_pct": lambda: pct(O, S.lag(C)),
        "__span10": lambda: S.highest(H, 10) - S.lowest(L, 10),
        "__hi10": lambda: S.highest(H, 10),
        "__sma10v": lambda: S.mean(V, 10), "__sma40v": lambda: S.mean(V, 40), "__sma10vf": lambda: S.mean(volume, 10),
        "base_depth": lambda: pct(C, S.wide(F.greatest, H, c("__hb"), 40, 20)),
        "turnover_est": lambda: F.coalesce(c("turnover"), C * V),
        "vol_sma_20": lambda: S.mean(V, 20, 10),
        "__low3": lambda: S.lowest(L, 3, 1),
        "__low20p": lambda: S.lowest(L, 20, prior=True),
        "__v3": lambda: S.mean(volume, 3),
        "low5_prior": lambda: S.lowest(L, 5, prior=True),
        "low10_prior": lambda: S.lowest(L, 10, prior=True),
        "low10_incl": lambda: S.lowest(L, 10, 5),
    }
    return columns


def _second() -> Thunks:
    """Arithmetic on the first stage, and windows over it."""
    C, H, L, O, V = prices()
    pc, ph, pl, po = c("__pc"), c("__ph"), c("__pl"), c("__po")
    rng = nonzero(H - L)
    mid, sd = c("sma_20"), c("__std20")
    down_volume = F.when(C < pc, c("__v"))
    up = holds(C > pc)
    spring = holds((L < c("lo_20_prior")) & (C > c("lo_20_prior")) & (c("close_pos") > 0.5))
    change = C - pc
    body = F.abs(C - O)
    columns = {
        "bb_mid": lambda: mid, "bb_upper": lambda: mid + sd * 2, "bb_lower": lambda: mid - sd * 2,
        "bb_bandwidth": lambda: ratio((mid + sd * 2) - (mid - sd * 2), mid) * 100,
        "bb_pct_b": lambda: ratio(C - (mid - sd * 2), (mid + sd * 2) - (mid - sd * 2)),
        "sma_200_slope": lambda: pct(c("sma_200"), S.lag(c("sma_200"), 20)),
        "sma_150_slope": lambda: pct(c("sma_150"), S.lag(c("sma_150"), 20)),
        "sma_50_slope": lambda: pct(c("sma_50"), S.lag(c("sma_50"), 10)),
        "dist_sma_10": lambda: pct(C, c("sma_10")), "dist_sma_50": lambda: pct(C, c("sma_50")), "dist_sma_200": lambda: pct(C, c("sma_200")),
        "pct_from_52w_high": lambda: pct(C, c("high_52w")), "pct_from_52w_low": lambda: pct(C, c("low_52w")),
        "down_vol_max_10": lambda: S.highest(down_volume, 10, 3, prior=True),
        "range_ratio": lambda: ratio(c("__span10"), S.lag(c("__span10"), 10)),
        "__width": lambda: ratio(c("__span10"), c("sma_10")) * 100,
        "vol_dryup": lambda: ratio(c("__sma10v"), c("__sma40v")),
        "vol_ratio": lambda: ratio(V.cast("double"), c("vol_sma_20")),
        "inside_bar": lambda: flag((H <= ph) & (L >= pl)),
        "turnover_median_20d": lambda: S.median(c("turnover_est"), 20, 10),
        "base_range_60": lambda: ratio(c("base_hi_60") - c("__base_lo"), C) * 100,
        "time_in_upper_half": lambda: S.mean(flag(C > (c("base_hi_60") + c("__base_lo")) / 2), 60, 40) * 100,
        "__spring": lambda: spring, "spring": lambda: flag(spring),
        "ud_vol_20": lambda: ratio(S.total(F.when(up, c("__v")).otherwise(0.0), 20, 15),
                           nonzero(S.total(F.when(~up, c("__v")).otherwise(0.0), 20, 15))),
        "close_pos_3": lambda: S.mean(c("close_pos"), 3, 2),
        "new_lo7": lambda: flag(C < c("lo7_prior")), "new_hi7": lambda: flag(C > c("hi7_prior")),
        "smooth_60": lambda: S.mean(flag(change > 0), 60, 40) * 100,
        "lower_wick": lambda: ratio(F.least(O, C) - L, rng),
        "body_pct": lambda: ratio(body, rng),
        "bull_engulf": lambda: flag((pc < po) & (C > O) & (O <= pc) & (C >= po)),
        "close_above_prev_high": lambda: flag(C > ph),
        "confirm_low_pct": lambda: pct(L, C), "low3_pct": lambda: pct(c("__low3"), C),
        "higher_low": lambda: flag(L > c("__low20p")),
        "two_up": lambda: flag((C > pc) & (pc > c("__ppc"))),
        "pb_days": lambda: rows_since(H >= c("__hi10")),
        "pb_vol_dry": lambda: ratio(c("__v3"), S.lag(c("__sma10vf"), 3)),
        "range_500_pct": lambda: pct(c("close_hi_500"), S.wide(F.least, C, c("__cbn"), 500, prior=True)),
    }
    return columns


def _scans() -> dict[str, Spec]:
    """Exponential recursions: output -> (input column, decay)."""
    specs = {f"__ema_{n}": ("adj_close", span_alpha(n)) for n in EMA_SPANS}
    return specs | {
        "__gain14": ("__gain", 1 / 14, "__d"), "__loss14": ("__loss", 1 / 14, "__d"),
        "__gain2": ("__gain", 1 / 2, "__d"), "__loss2": ("__loss", 1 / 2, "__d"),
        "__atr": ("__tr", 1 / 14), "__vema": ("__v", span_alpha(21)),
    }


def _recursive() -> Thunks:
    """Exponential averages, Wilder ranges and oscillators, with their unstable heads blanked."""
    C, H, L, O, V = prices()

    def strength(n: int) -> Column:
        gain, loss = c(f"__gain{n}"), c(f"__loss{n}")
        value = (F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0)
                 .otherwise(F.lit(100.0) - F.try_divide(F.lit(100.0), 1 + ratio(gain, loss))))
        return blank_head(value, C, n + 1)

    columns = {f"ema_{n}": (lambda n=n: blank_head(c(f"__ema_{n}"), C, n)) for n in EMA_SPANS}
    return columns | {
        "rsi_14": lambda: strength(14), "rsi_2": lambda: strength(2),
        "atr_14": lambda: blank_head(c("__atr"), C, 15),
        "vol_ema_21": lambda: blank_head(c("__vema"), c("__v"), 21),
    }


def period_levels(df: DataFrame, period: Column, prefix: str, keys: tuple[str, ...] = ("isin",)) -> DataFrame:
    """Levels of the last fully closed period, on every row of the next one.

    The frame is already ordered by (key, date), so a finished period's range is read from its last row
    by a second window instead of an aggregate-and-join: first the running range inside the period,
    then the latest completed period carried forward. Empty periods do not exist, so they are skipped.
    """
    C, H, L, O, V = prices()
    k, h, low, cl = (f"__{prefix}_{x}" for x in ("per", "hi", "lo", "cl"))
    df = df.withColumn(k, period)
    inside = (Window.partitionBy(*keys, k).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({h: F.max(H).over(inside), low: F.min(L).over(inside)})
    done = F.struct(F.col(h).alias("h"), F.col(low).alias("l"), C.alias("c"))
    turn = F.lag(k).over(S.spec) != F.col(k)
    df = df.withColumn(f"__{prefix}_prev", F.when(turn, F.lag(done).over(S.spec)))
    df = df.withColumn(f"__{prefix}_prev", F.last(f"__{prefix}_prev", ignorenulls=True).over(S.so_far()))
    prev = F.col(f"__{prefix}_prev")
    levels = pivot_levels(prev["h"], prev["l"], prev["c"])
    return df.withColumns({f"{prefix}_{n}": x for n, x in levels.items()})


def _three_weeks(df: DataFrame) -> DataFrame:
    """Spread of the last three completed Friday-ending weekly closes."""
    C, H, L, O, V = prices()
    df = df.withColumn("__wf", week_friday(c("date")))
    turn = F.lag("__wf").over(S.spec) != c("__wf")
    df = df.withColumn("__wclose", F.when(turn, S.lag(C)))
    recent = F.collect_list("__wclose").over(S.frame(28))  # three finished weeks lie within 28 rows
    last3 = F.slice(recent, -3, 3)
    df = df.withColumn("__w3", F.when(F.size(recent) >= 3, last3))
    top, bottom = F.array_max("__w3"), F.array_min("__w3")
    return df.withColumn("tight_3w_pct", ratio(top - bottom, top) * 100)


def _width_rank(df: DataFrame) -> DataFrame:
    """Share of the previous 11 months whose central-range width was below this month's.

    One value per month (its first known width); at least 6 known in the 12-month window; an unknown
    earlier month counts in the denominator.
    """
    month = c("__m_per")
    turn = F.coalesce(F.lag(month).over(S.spec) != month, F.lit(True))
    # The width is constant inside a month, so the month's first row carries it. The frame is the last 12 months by their
    # number: it changes once a month, so its 12 values are gathered once a month and not for every row.
    df = df.withColumns({"__turn": turn, "__width_of": F.when(turn, F.struct(c("m_cpr_width").alias("w")))})
    df = df.withColumn("__month_no", F.sum(F.col("__turn").cast("int")).over(S.so_far()))
    last12 = Window.partitionBy("isin").orderBy("__month_no").rangeBetween(-11, 0)
    df = df.withColumn("__widths", F.sort_array(F.collect_list(F.when(c("__turn"), F.struct(c("__month_no").alias("k"), c("__width_of.w").alias("w")))).over(last12)))
    earlier = F.slice(c("__widths"), 1, F.size("__widths") - 1)
    smaller = F.size(F.filter(earlier, lambda x: x["w"] < c("m_cpr_width")))  # by month, this one last
    known = F.size(F.filter(c("__widths"), lambda x: x["w"].isNotNull()))
    rank = F.when((known >= 6) & (F.size(earlier) > 0), smaller / F.size(earlier))
    return df.withColumn("m_cpr_width_rank", rank)


def _derived() -> Thunks:
    """Columns that read the recursive, level and second-stage columns."""
    C, H, L, O, V = prices()
    brk, spring = c("__brk"), c("__spring")
    vol_vs = ratio(c("__v"), c("vol_ema_21"))
    previous = pivot_levels(c("__ph"), c("__pl"), c("__pc"))
    columns = {
        "vol_vs_ema21": lambda: vol_vs,
        "atr_pct": lambda: ratio(c("atr_14"), C) * 100,
        "dist_ema_21": lambda: pct(C, c("ema_21")), "dist_ema_9": lambda: pct(C, c("ema_9")),
        "low3_dist_ema_9": lambda: pct(c("__low3"), c("ema_9")),
        "pocket_pivot": lambda: flag((C > c("__pc")) & (c("__v") > c("down_vol_max_10"))),
        "atr_ratio_60": lambda: ratio(c("atr_14"), S.lag(c("atr_14"), 60)),
        "contract_a": lambda: S.lag(c("__width"), 20), "contract_b": lambda: S.lag(c("__width"), 10),
        "contract_c": lambda: c("__width"), "tightness": lambda: c("__width"),
        "hammer": lambda: flag((c("lower_wick") >= 0.5) & (c("close_pos") >= 0.6)),
        "doji": lambda: flag(c("body_pct") <= 0.1),
        "rsi_turn_up": lambda: flag(c("rsi_14") > S.lag(c("rsi_14"))),
        "since_spring": lambda: rows_since(spring), "spring_low": lambda: last_value_at(L, spring),
        "brk_vol": lambda: last_value_at(vol_vs, brk),
        "above_m_p": lambda: flag(C > c("m_p")),
        "__r1vol": lambda: crossed_above(C, c("m_r1")) & holds(c("__v") > c("vol_ema_21")),
        "levels_basis": lambda: F.lit("adjusted"),
    }
    columns |= {f"__x_{n}": (lambda n=n: crossed_above(C, c(n))) for n in CROSS_LEVELS}
    columns |= {f"dist_{n}": (lambda n=n: pct(C, c(n))) for n in DISTANCE_LEVELS}
    columns |= {f"low3_dist_{n}": (lambda n=n: pct(c("__low3"), c(n))) for n in DISTANCE_LEVELS}
    columns |= {f"d_{n}": (lambda x=x: x) for n, x in previous.items() if n.startswith("cpr")}
    return columns


def _last() -> Thunks:
    """Event segments and everything that reads a derived column."""
    C, H, L, O, V = prices()
    prior15 = S.highest(c("dist_ema_21"), 15, 5, prior=True)
    columns = {
        "ext_ema21_15": lambda: prior15,
        "stop_3atr": lambda: C * (1 - c("atr_pct") * 3 / 100), "stop_4atr": lambda: C * (1 - c("atr_pct") * 4 / 100),
        "tgt_3r_4atr": lambda: C * (1 + c("atr_pct") * 12 / 100),
        "contract_seq": lambda: flag((c("contract_c") < c("contract_b")) & (c("contract_b") < c("contract_a"))),
        "contract_ratio": lambda: ratio(c("contract_c"), c("contract_a")),
        "any_reversal": lambda: flag((c("bull_engulf") == 1) | (c("hammer") == 1) | (c("close_above_prev_high") == 1)),
        "dist_spring_low": lambda: pct(C, c("spring_low")), "atr_to_spring": lambda: ratio(C - c("spring_low"), c("atr_14")),
        "since_r1_vol_breakout": lambda: rows_since(c("__r1vol")),
    }
    columns |= {f"since_{n}_cross": (lambda n=n: rows_since(c(f"__x_{n}"))) for n in CROSS_LEVELS}
    return columns


def _cushion() -> Thunks:
    return {"brk_cushion": lambda: pct(c("low_since_brk"), c("brk_level"))}


def _names(expressions: Iterable[Column]) -> set[str]:
    """Every identifier an expression mentions (a superset of the columns it reads)."""
    return set(re.findall(r"\w+", " ".join(str(x) for x in expressions)))


def build_features(bars: DataFrame, wanted: Iterable[str] | None = None, min_bars: int = 2) -> DataFrame:
    """The feature panel of ``bars`` (isin, date, adj_* block, volume, turnover).

    Keys with fewer than ``min_bars`` bars are dropped. ``wanted`` limits the panel to some feature
    columns: stages are resolved backwards, so only what those columns read is planned.
    """
    stages = [_inputs(), _changes(), _breakouts(), _stretches(), _inside_stretches(), _recursive(), _base(), _second(), _derived(), _last(), _cushion()]
    scanned, levelled = 5, 6  # the recursions come before stage 5, period levels before stage 6: sorts of their own, on narrow rows
    scans = _scans()
    everything = wanted is None
    need = set() if everything else set(wanted) | {"r"}
    chosen: list[dict[str, Column]] = []
    for i, stage in reversed(list(enumerate(stages))):
        made = {n: thunk() for n, thunk in stage.items() if everything or n in need}
        need |= _names(made.values())
        if i == scanned:
            scans = {o: spec for o, spec in scans.items() if everything or o in need}
            need |= {x for spec in scans.values() for x in (spec[0], spec[-1]) if isinstance(x, str)}
        if i == levelled:
            weekly = everything or any(n.startswith("w_") for n in need)
            ranked = everything or "m_cpr_width_rank" in need
            monthly = everything or ranked or any(n.startswith("m_") for n in need)
            tight = everything or "tight_3w_pct" in need
        chosen.insert(0, made)

    df = by_key(bars)
    for i, made in enumerate(chosen):
        if i == scanned:
            df = ewm_scan(df, scans)
        if i == levelled:
            df = period_levels(df, week_monday(c("date")), "w") if weekly else df
            df = period_levels(df, month_start(c("date")), "m") if monthly else df
            df = _three_weeks(df) if tight else df
            df = _width_rank(df) if ranked else df
        df = df.withColumns(made) if made else df
    if min_bars > 1:
        size = F.count(F.lit(1)).over(Window.partitionBy("isin"))
        df = df.withColumn("__n", size).filter(c("__n") >= min_bars)
    df = df.withColumn("bars_available", c("r"))
    if everything:
        return df.select(*[n for n in df.columns if not n.startswith("__")])
    extra = [n for n in dict.fromkeys(wanted) if n not in bars.columns]
    return df.select(*bars.columns, *dict.fromkeys(["r", "bars_available", *extra]))
