"""Position lifecycle on a stream of bars: pending -> open -> closed, one state per instrument.

The batch twin is ``first_touch`` with a close-based stop plus ``one_open_per_key``; both give the same
trades on the same bars, but for trades that the data's end cuts short in the batch and leaves open here.
Bars wait in a sorted buffer until their key has seen one ``delay`` days newer, so a bar late by less takes its place in order. Bars
later than that come out as rows with ``why = 'late'`` and no prices. State is a handful of numbers and the bars of ``delay`` days
per key, so it does not grow with history.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "late"
OUTPUT = "isin string, entry_date date, exit_date date, entry double, exit double, bars int, why string"
BAR = "date date, adj_open double, adj_close double, hi7_prior double, atr_pct double, signal int"
STATE = "phase string, position int, signal_at int, entry_date date, entry double, stop double, fill string, last_date date, cooldown_to int"


class Positions(StatefulProcessor):
    """Follows one instrument: signal on a close, entry at the next open, stop or reversal on a close, exit at the next open."""

    def __init__(self, stop_multiple: float, cap: int, cooldown: int = 0, delay: int = 0):
        self.stop_multiple, self.cap, self.cooldown, self.delay = stop_multiple, cap, cooldown, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", STATE)
        self.waiting = handle.getListState("waiting", BAR) if self.delay else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            phase, position, signal_at, entry_date, entry, stop, fill, last_date, cooldown_to = self.state.get()
        else:
            phase, position, signal_at, entry_date, entry, stop, fill, last_date, cooldown_to = "flat", 0, 0, None, 0.0, 0.0, "", None, -1
        closed = []
        bars = self._due(pd.concat(list(rows)))
        for bar in bars.itertuples(index=False):
            if last_date is not None and bar.date <= last_date:
                # A replayed or late bar does not move a position; it is reported, so none is lost unseen.
                closed.append((key[0], bar.date, bar.date, None, None, 0, LATE))
                continue
            position, last_date = position + 1, bar.date
            if phase == "exiting":
                closed.append((key[0], entry_date, bar.date, entry, bar.adj_open, position - signal_at, fill))
                phase, cooldown_to = "flat", position + self.cooldown
            elif phase == "pending":
                phase, entry, entry_date = "open", bar.adj_open, bar.date
                stop = entry * (1 - self.stop_multiple * stop / 100)
            if phase == "open":
                # A stop beats every other exit of the same bar.
                if bar.adj_close < stop:
                    phase, fill = "exiting", "stop"
                elif pd.notna(bar.hi7_prior) and bar.adj_close > bar.hi7_prior:
                    phase, fill = "exiting", "reversal"
                elif position - signal_at >= self.cap:
                    closed.append((key[0], entry_date, bar.date, entry, bar.adj_close, position - signal_at, "time"))
                    phase, cooldown_to = "flat", position + self.cooldown
                    continue  # the name was held on this bar, so its signal is not taken
            elif phase == "flat" and bar.signal == 1 and position > cooldown_to and pd.notna(bar.atr_pct):
                # Until entry the stop slot carries the volatility of the signal bar.
                phase, signal_at, stop = "pending", position, float(bar.atr_pct)
        self.state.update((phase, position, signal_at, entry_date, entry, stop, fill, last_date, cooldown_to))
        if closed:
            yield pd.DataFrame(closed, columns=["isin", "entry_date", "exit_date", "entry", "exit", "bars", "why"])

    def _due(self, bars: pd.DataFrame) -> pd.DataFrame:
        """The bars whose time has come, in order; the others go back to the buffer."""
        if not self.delay:
            return bars.sort_values("date", kind="stable")
        names = [f.split()[0] for f in BAR.split(", ")]
        held = pd.DataFrame(list(self.waiting.get()), columns=names) if self.waiting.exists() else bars[names].iloc[:0]
        bars = pd.DataFrame([*held.itertuples(index=False, name=None), *bars[names].itertuples(index=False, name=None)], columns=names).sort_values("date", kind="stable")
        due = bars["date"] <= bars["date"].max() - datetime.timedelta(days=self.delay)
        rest = [tuple(None if pd.isna(v) else v for v in row) for row in bars[~due].astype(object).itertuples(index=False)]
        self.waiting.put(rest) if rest else self.waiting.clear()
        return bars[due]

    def close(self) -> None:
        pass


def stream_positions(bars: DataFrame, stop_multiple: float, cap: int, cooldown: int = 0, delay: int = 0) -> DataFrame:
    """Closed trades of a bar stream carrying isin, date, adj_open, adj_close, hi7_prior, atr_pct and signal.

    With a ``delay`` the last ``delay`` days of every key wait for newer bars.
    """
    return bars.groupBy("isin").transformWithStateInPandas(
        statefulProcessor=Positions(stop_multiple, cap, cooldown, delay), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
