"""Signal to outcome: follow every signal along its own future rows to the first exit.

``future_path`` turns signals into (signal, offset) rows with an equi join on (key, position), never a
range join; all exits are then minima over that path, so one pass serves any number of exit kinds.
Signals are independent, so the work is spread by signal; only ``one_open_per_key`` looks at several
signals of a key together, and a key has at most one signal per session.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import holds, ratio
from ..functions.windows import PANEL as S
from ..session import cut_lineage

PATH = ["adj_open", "adj_high", "adj_low", "adj_close"]


@dataclass(frozen=True)
class Exit:
    """How a trade ends. One open position is entered at the next open after the signal.

    stop      ("atr", k): k x ATR% of entry | ("pct", p) | ("price", column): a structural level | None
    risk_min, risk_max, inclusive: accepted stop distance in per cent of entry
    stop_on   "low": touched intrabar, fills at the worse of stop and open | "close": next open after a close below
    stop_from rows after entry on which the stop becomes live (0 = on the entry row)
    target    reward multiple of the stop distance, filled at the better of target and open
    trigger   SQL over the path row (adj_close, ema_21, hi7_prior, peak, atr_abs, ...): exit next open after it holds
    on_last   trigger on a key's last row: "close" exits there, "ignore" falls to the time exit, "open" uses that row's open
    cap       time exit at the close of row signal+cap (or the key's last row)
    manage    None | "breakeven" | "half" | "low5": raised stops once +1R has traded
    """

    stop: tuple | None = None
    target: float | None = None
    trigger: str | None = None
    why: str = "trigger"
    cap: int = 20
    cost: float = 0.0
    stop_on: str = "low"
    stop_from: int = 0
    on_last: str = "ignore"
    manage: str | None = None
    risk_min: float = 0.2
    risk_max: float = 20.0
    inclusive: bool = False
    extra: tuple[str, ...] = ()


# Exit families of the audit (stop multiple, session cap, trigger).
AUDIT_COST = 0.50
FAMILIES = {
    "mean_reversion": Exit(("atr", 4.0), trigger="adj_close > hi7_prior", cap=20, cost=AUDIT_COST,
                           stop_on="close", on_last="open", risk_min=0.0, risk_max=1e9, extra=("hi7_prior",)),
    "trend_continuation": Exit(("atr", 3.0), trigger="adj_close < ema_21", cap=60, cost=AUDIT_COST,
                               stop_on="close", on_last="open", risk_min=0.0, risk_max=1e9, extra=("ema_21",)),
    "momentum_leader": Exit(("atr", 4.0), trigger="adj_close < ema_21", cap=60, cost=AUDIT_COST,
                            stop_on="close", on_last="open", risk_min=0.0, risk_max=1e9, extra=("ema_21",)),
}
REVERSAL = Exit(trigger="adj_close > hi7_prior", why="reversal", cap=20, cost=0.30, on_last="close", extra=("hi7_prior",))


def with_position(panel: DataFrame) -> DataFrame:
    """Row position ``r``, the key's last position and the next open, all on the key ordering."""
    if "r" not in panel.columns:
        panel = panel.withColumn("r", S.row())
    return panel.withColumns({
        "last_r": F.max("r").over(Window.partitionBy("isin")),
        "next_open": S.lead(F.col("adj_open"))})


def future_path(panel: DataFrame, signals: DataFrame, horizon: int, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (signal, k), k = 1..horizon, with that row's prices. ``signals`` keeps all its columns.

    ``panel`` must carry positions (``with_position``); ``signals`` needs isin, r (signal position) and ``sid``.
    """
    steps = signals.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("__at", F.col("r") + F.col("k")).withColumnRenamed("isin", "__key")
    rows = panel.select(F.col("isin").alias("__k2"), F.col("r").alias("__r2"), F.col("date").alias("path_date"),
                        *PATH, "last_r", "next_open", *[e for e in extra])
    drop = [x for x in [*PATH, "last_r", "next_open", *extra] if x in signals.columns]
    joined = steps.drop(*drop).join(rows, (F.col("__key") == F.col("__k2")) & (F.col("__at") == F.col("__r2")))
    return joined.drop("__k2", "__r2", "__at").withColumnRenamed("__key", "isin")


def _stop_distance(exit: Exit, entry: Column) -> Column:
    """Initial risk per unit, in price."""
    kind, amount = exit.stop
    if kind == "atr":
        return entry * F.col("atr_pct") / 100 * float(amount)
    if kind == "pct":
        return entry * float(amount) / 100
    return entry - F.col(amount)


def open_trades(panel: DataFrame, signals: DataFrame, exit: Exit) -> DataFrame:
    """Signals that can be entered: next row exists, the stop distance is acceptable.

    ``signals`` are rows of ``with_position(panel)``; a missing or unusable entry drops the signal.
    """
    entry = F.col("next_open")
    df = signals.withColumn("entry", entry).filter((F.col("r") < F.col("last_r")) & holds(entry > 0))
    if exit.stop is None:
        return df.withColumns({"risk": F.lit(None).cast("double"), "risk_pct": F.lit(None).cast("double")})
    df = df.withColumn("risk", _stop_distance(exit, F.col("entry")))
    df = df.withColumn("risk_pct", F.col("risk") / F.col("entry") * 100)
    return df.filter(_accepted(exit, F.col("risk_pct")))


def _accepted(exit: Exit, x: Column) -> Column:
    low = (x >= exit.risk_min) if exit.inclusive else (x > exit.risk_min)
    high = (x <= exit.risk_max) if exit.inclusive else (x < exit.risk_max)
    return holds(low & high)


def first_touch(panel: DataFrame, signals: DataFrame, exit: Exit, excursions: bool = False) -> DataFrame:
    """Outcome of every signal under ``exit``: entry, exit position and price, why, net, bars, risk_pct (mae, mfe).

    ``signals`` are rows of the positioned panel and carry ``sid``, a unique id.
    """
    trades = open_trades(panel, signals, exit)
    asked = _asked(exit)
    steps = ["sid", "isin", "r", "entry", "risk"]
    # Only what the exit reads is multiplied by the horizon and shuffled; the signal's other columns meet the outcome by sid.
    narrow = trades.select(*steps, *[c for c in trades.columns if c in asked and c not in steps])
    path = _walked(future_path(panel, narrow, exit.cap, exit.extra), [exit], excursions)
    path, events = _events(path, exit, excursions)
    made = ("entry", "risk", "risk_pct")
    kept = trades.select("sid", *[c for c in signals.columns if c not in ("sid", *made)], *made)
    out = kept.join(path.groupBy("sid").agg(*[e.alias(n) for n, e in events.items()]), "sid")
    found = _outcome(exit, excursions, {n: F.col(n) for n in events})
    first = {n: found.pop(n) for n in ("scaled", "exit", "bars", "why", "gross") if n in found}
    return out.withColumns(first).filter(holds(F.col("exit") > 0)).withColumns(found).drop(*events)


def many_touches(panel: DataFrame, signals: DataFrame, cells: dict[str, Exit], excursions: bool = False,
                 only: dict[str, Column] | None = None) -> DataFrame:
    """``first_touch`` of the same signals under several exits, stacked with a ``cell`` column: one path for all of them.

    The path is as long as the longest cap and carries the risk of every cell; one aggregate takes the first events of all
    cells, and a row per cell leaves it. ``only`` limits a cell to the signals that meet a condition.
    """
    only = only or {}
    entry = F.col("next_open")
    trades = signals.withColumn("entry", entry).filter((F.col("r") < F.col("last_r")) & holds(entry > 0))
    marks = {}
    for i, (name, exit) in enumerate(cells.items()):
        risk = F.lit(None).cast("double") if exit.stop is None else _stop_distance(exit, F.col("entry"))
        marks |= {f"risk_{i}": risk, f"ok_{i}": holds(only.get(name, F.lit(True))) & (F.lit(True) if exit.stop is None else _accepted(exit, risk / F.col("entry") * 100))}
    trades = trades.withColumns(marks).filter(" OR ".join(f"ok_{i}" for i in range(len(cells))))
    asked, extra = set().union(*map(_asked, cells.values())), list(dict.fromkeys(e for x in cells.values() for e in x.extra))
    steps = ["sid", "isin", "r", "entry", *marks]
    narrow = trades.select(*steps, *[c for c in trades.columns if c in asked - set(extra) and c not in steps])
    path = _walked(future_path(panel, narrow, max(x.cap for x in cells.values()), extra), list(cells.values()), excursions)
    events: dict[str, Column] = {}
    for i, exit in enumerate(cells.values()):
        path, own = _events(path, exit, excursions, f"_{i}")
        inside = F.col(f"ok_{i}") & (F.col("k") <= exit.cap)
        events |= {n: (F.max if n.startswith("__end") else F.min)(F.when(inside, e)) for n, e in own.items()}
    kept = trades.select("sid", *[c for c in signals.columns if c not in ("sid", "entry", "risk", "risk_pct")], "entry", *marks)
    out = kept.join(path.groupBy("sid").agg(*[e.alias(n) for n, e in events.items()]), "sid")
    rows = []
    for i, (name, exit) in enumerate(cells.items()):
        risk = F.col(f"risk_{i}")
        found = _outcome(exit, excursions, {n.removesuffix(f"_{i}"): F.col(n) for n in events if n.endswith(f"_{i}")}, risk, risk / F.col("entry") * 100)
        columns = {"cell": F.lit(name), "risk": risk, "risk_pct": risk / F.col("entry") * 100, "scaled": F.lit(None).cast("boolean"), **found}
        rows.append(F.when(F.col(f"ok_{i}") & holds(found["exit"] > 0), F.struct(*[x.alias(n) for n, x in columns.items()])))
    names = [c for c in kept.columns if c not in marks]
    return out.select(*names, F.explode(F.array_compact(F.array(*rows))).alias("__o")).select(*names, "__o.*")


def _asked(exit: Exit) -> set[str]:
    """The signal's columns that an exit reads on its path."""
    return {"atr_pct", "low5_prior", *re.findall(r"\w+", exit.trigger or "")} - {*PATH, "last_r", "next_open", *exit.extra}


def _walked(path: DataFrame, exits: Sequence[Exit], excursions: bool) -> DataFrame:
    """The path with what several exits read: range in price, running low and high, peak."""
    low, high, entry = F.col("adj_low"), F.col("adj_high"), F.col("entry")
    path = path.withColumn("atr_abs", F.col("atr_pct") / 100 * entry if "atr_pct" in path.columns else F.lit(None).cast("double"))
    if excursions or any(x.manage or (x.trigger and "peak" in x.trigger) for x in exits):
        so_far = Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        path = path.withColumns({"run_low": F.min(low).over(so_far), "run_high": F.max(high).over(so_far)})
        path = path.withColumn("peak", F.greatest(entry, F.col("run_high")))
    return path


def _events(path: DataFrame, exit: Exit, excursions: bool, tag: str = "") -> tuple[DataFrame, dict[str, Column]]:
    """The path with the exit's stop level, and its events: the first row of each kind and the last row (min and max with a tag: their arguments)."""
    high, low, close, opn = (F.col(n) for n in ("adj_high", "adj_low", "adj_close", "adj_open"))
    entry, risk, k = F.col("entry"), F.col("risk" + tag), F.col("k")
    is_last = (F.col("r") + k) >= F.col("last_r")
    walk = Window.partitionBy("sid").orderBy("k")
    so_far, before = walk.rowsBetween(Window.unboundedPreceding, 0), walk.rowsBetween(Window.unboundedPreceding, -1)
    level = stop = entry - risk
    if exit.manage:
        one_r = entry + risk
        traded = F.when(high >= one_r, k)
        # +1R must have traded on an earlier row before a raised stop is live.
        path = path.withColumns({f"__armed{tag}": F.min(traded).over(so_far).isNotNull(),
                                 f"__armed_before{tag}": F.min(traded).over(before).isNotNull(),
                                 f"__half_px{tag}": F.when(high >= one_r, F.greatest(opn, one_r))})
        if exit.manage == "breakeven":
            raised = F.when(F.col(f"__armed_before{tag}"), entry)
        elif exit.manage == "half":
            raised = F.max(F.when(F.col(f"__armed{tag}"), F.col("peak") - F.col("atr_abs") * 2)).over(before)
        else:
            raised = F.max(F.when(F.col(f"__armed_before{tag}"), F.col("low5_prior"))).over(so_far)
        level = F.greatest(stop, raised)
    path = path.withColumn(f"__stop{tag}", level)

    live = k > exit.stop_from
    row = F.struct(k.alias("k"), opn.alias("o"), close.alias("c"), F.col("next_open").alias("no"), is_last.alias("last"),
                   F.col(f"__stop{tag}").alias("s"), *([F.col("run_low").alias("lo"), F.col("run_high").alias("hi")] if excursions else []))
    events = {"__end": row}
    if exit.stop is not None:
        touched = (low <= F.col(f"__stop{tag}")) if exit.stop_on == "low" else (close < F.col(f"__stop{tag}"))
        if exit.stop_on == "close" and exit.on_last == "ignore":
            live = live & ~is_last
        events["__s"] = F.when(holds(touched & live), row)
    if exit.target is not None:
        events["__t"] = F.when(holds(high >= entry + risk * exit.target), row)
    if exit.trigger is not None:
        fires = holds(F.expr(exit.trigger))
        if exit.on_last == "ignore":
            fires = fires & ~is_last
        events["__x"] = F.when(fires, row)
    if exit.manage == "half":
        events["__h"] = F.when(F.col(f"__half_px{tag}").isNotNull(), F.struct(k.alias("k"), F.col(f"__half_px{tag}").alias("p")))
    if tag:
        return path, {n + tag: e for n, e in events.items()}
    return path, {n: (F.max if n == "__end" else F.min)(e) for n, e in events.items()}


def _outcome(exit: Exit, excursions: bool, event: dict[str, Column], risk: Column | None = None, risk_pct: Column | None = None) -> dict[str, Column]:
    """Exit price, bars, reason and returns from the first events of a trade."""
    far = F.lit(10**9)
    entry, end = F.col("entry"), event["__end"]
    risk, pct_at_risk = (F.col("risk"), F.col("risk_pct")) if risk is None else (risk, risk_pct)

    def at(name: str) -> Column:
        return F.coalesce(event[name]["k"], far) if name in event else far

    ks, kt, kx = at("__s"), at("__t"), at("__x")
    first = F.least(ks, kt, kx)
    stopped, won = (ks == first) & (ks < far), (kt == first) & (kt < far) & (ks != first)
    fired = (kx == first) & (kx < far) & ~stopped & ~won

    def next_open(x: Column) -> tuple[Column, Column]:
        """Fill at the next open; on a key's last row there is none."""
        last_fill = x["o"] if exit.on_last == "open" else x["c"]
        return F.when(x["last"], last_fill).otherwise(x["no"]), F.when(x["last"], x["k"]).otherwise(x["k"] + 1)

    price, steps, why = end["c"], end["k"], F.lit("time")
    incl = end
    if exit.trigger is not None:
        p, n = next_open(event["__x"])
        price, steps, why = F.when(fired, p).otherwise(price), F.when(fired, n).otherwise(steps), F.when(fired, exit.why).otherwise(why)
        incl = F.when(fired, event["__x"]).otherwise(incl)
    if exit.target is not None:
        goal = entry + risk * exit.target
        price = F.when(won, F.greatest(event["__t"]["o"], goal)).otherwise(price)
        steps, why = F.when(won, kt).otherwise(steps), F.when(won, "target").otherwise(why)
        incl = F.when(won, event["__t"]).otherwise(incl)
    if exit.stop is not None:
        x = event["__s"]
        p, n = next_open(x) if exit.stop_on == "close" else (F.least(x["o"], x["s"]), x["k"])
        label = F.when(x["s"] > entry - risk, "tstop").otherwise("stop") if exit.manage else F.lit("stop")
        price, steps, why = F.when(stopped, p).otherwise(price), F.when(stopped, n).otherwise(steps), F.when(stopped, label).otherwise(why)
        incl = F.when(stopped, x).otherwise(incl)
    gross = (price / entry - 1) * 100
    found = {}
    if exit.manage == "half":
        half = event["__h"]
        same_row = (stopped | won) & (F.least(ks, kt) == half["k"])
        found["scaled"] = holds(half["k"] <= F.least(first, end["k"])) & ~holds(same_row)
        gross = F.when(found["scaled"], gross / 2 + (half["p"] / entry - 1) * 50).otherwise(gross)
    found |= {"exit": price, "bars": steps, "why": why, "gross": gross, "net": gross - exit.cost, "exit_r": F.col("r") + steps,
              "r_multiple": ratio(gross, pct_at_risk)}
    if excursions:
        found["mae"] = (F.least(incl["lo"], price) / entry - 1) * 100
        found["mfe"] = (F.greatest(incl["hi"], price) / entry - 1) * 100
    return found


def one_open_per_key(trades: DataFrame, by: Sequence[str] = ("isin",), start: str = "r", stop: str = "exit_r",
                     order: str = "r") -> DataFrame:
    """Greedy admission: a signal is skipped while the key's previous accepted trade is still open.

    A key has at most one signal per session, so its list is bounded by the calendar. The fold keeps
    accepted positions only; the trades are joined back by (key, ``order``). Reads ``trades`` twice.
    """
    item = F.struct(*[F.col(c).cast("long").alias(n) for n, c in (("o", order), ("a", start), ("b", stop))])
    fold = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.struct(F.lit(-1).cast("long").alias("busy"), F.array().cast("array<bigint>").alias("taken")),
        lambda acc, x: F.when(acc["busy"] < x["a"], F.struct(x["b"].alias("busy"), F.concat(acc["taken"], F.array(x["o"])).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"])
    taken = trades.groupBy(*by).agg(fold.alias("__t")).select(*by, F.explode("__t").alias("__a"))
    taken = taken.select(*[F.col(b).alias(f"__k_{b}") for b in by], "__a")
    on = F.col(order).cast("long") == F.col("__a")
    for b in by:
        on = on & (F.col(b) == F.col(f"__k_{b}"))
    return trades.join(taken, on, "left_semi")


def excursion_timing(panel: DataFrame, trades: DataFrame, horizon: int) -> DataFrame:
    """Lowest and highest price on the way and the bars it took to reach them (first occurrence)."""
    path = future_path(panel, trades.select("sid", "isin", "r", "entry", "bars"), horizon).filter(F.col("k") <= F.col("bars"))
    low = F.min(F.struct(F.col("adj_low").alias("p"), F.col("k").alias("k")))
    high = F.max(F.struct(F.col("adj_high").alias("p"), (-F.col("k")).alias("k")))
    found = path.groupBy("sid").agg(low.alias("__l"), high.alias("__h"))
    return trades.join(found, "sid").withColumns({
        "mae_hold": (F.col("__l.p") / F.col("entry") - 1) * 100, "mfe_hold": (F.col("__h.p") / F.col("entry") - 1) * 100,
        "bars_to_mae": F.col("__l.k"), "bars_to_mfe": -F.col("__h.k")}).drop("__l", "__h")


def fixed_hold(panel: DataFrame, signals: DataFrame, sessions: int, cost: float = 0.30) -> DataFrame:
    """Enter at the next open, leave at the close ``sessions`` rows after the signal or at the key's last row."""
    trades = open_trades(panel, signals, Exit())
    trades = trades.withColumn("exit_r", F.least(F.col("r") + sessions, F.col("last_r")))
    exits = panel.select(F.col("isin").alias("__i"), F.col("r").alias("__r"), F.col("adj_close").alias("exit"))
    joined = trades.join(exits, (F.col("isin") == F.col("__i")) & (F.col("exit_r") == F.col("__r"))).drop("__i", "__r")
    return joined.withColumns({"net": (F.col("exit") / F.col("entry") - 1) * 100 - cost, "bars": F.col("exit_r") - F.col("r"), "why": F.lit("time")})


def benchmark_return(trades: DataFrame, calendar_level: DataFrame) -> DataFrame:
    """Return of a date-level index over each trade's own window (entry_date .. exit_date)."""
    level = calendar_level.select("date", "log_level")
    a = level.select(F.col("date").alias("entry_date"), F.col("log_level").alias("__a"))
    b = level.select(F.col("date").alias("exit_date"), F.col("log_level").alias("__b"))
    return (trades.join(F.broadcast(a), "entry_date", "left").join(F.broadcast(b), "exit_date", "left")
            .withColumn("bench", (F.exp(F.col("__b") - F.col("__a")) - 1) * 100).drop("__a", "__b"))


def session_index(calendar: DataFrame) -> DataFrame:
    """Zero-based position of every session date. The calendar is one row per session."""
    return calendar.select("date").distinct().withColumn(
        "session_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def with_sessions(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """Entry and exit dates and their session numbers (positions r+1 and exit_r of the key)."""
    places = panel.select(F.col("isin").alias("__i"), F.col("r").alias("__r"), F.col("date").alias("__d"))
    calendar = F.broadcast(session_index(panel).withColumnRenamed("date", "__cd"))
    for name, position in (("entry", F.col("r") + 1), ("exit", F.col("exit_r"))):
        trades = trades.withColumn("__p", position)
        trades = trades.join(places, (F.col("isin") == F.col("__i")) & (F.col("__p") == F.col("__r"))).drop("__i", "__r", "__p")
        trades = trades.join(calendar, F.col("__d") == F.col("__cd")).drop("__cd")
        trades = trades.withColumnRenamed("__d", f"{name}_date").withColumnRenamed("session_i", f"{name}_i")
    return trades


def grid(panel: DataFrame, signals: DataFrame, cells: dict[str, Exit], non_overlapping: bool = True) -> DataFrame:
    """Outcomes of the same signals under several exits, stacked with a ``cell`` column; one path serves all cells."""
    trades = many_touches(panel, signals, cells, excursions=True).select(
        "sid", "isin", "date", "r", "entry", "exit", "exit_r", "bars", "why", "net", "risk_pct", "r_multiple", "mae", "mfe", "cell")
    return one_open_per_key(cut_lineage(trades), ("isin", "cell")) if non_overlapping else trades
