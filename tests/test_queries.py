"""Registered queries against their SQL twins on the smallest tables (check.py runs all of them)."""

import duckdb
import pytest

from check import TABLES, compare
from panelspark.registry import ORACLES, QUERIES

SAMPLE = ["W1_sma", "W3_rsi", "L3_period_levels", "E4_event_segments", "X1_relative_strength", "X14_hysteresis_gate", "T1_bracket", "T5_managed_stop_half",
          "T8_one_open_per_key", "A7_concentration", "A9_trade_stats", "M1_column_upsert", "J4_suffix_factor", "V2_clustered_slope", "V10_filter_search", "ST3_keep_last"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


def test_position_stream_equals_the_batch_twin(spark, sf):
    """The state machine and the batch outcome give the same trades on the same bars."""
    from panelspark.operators import outcomes as oc
    from panelspark.registry.outcomes import positioned, signals
    panel = positioned(spark, sf)
    exit = oc.Exit(("atr", 0.2), trigger="adj_close > hi7_prior", why="reversal", cap=20, stop_on="close", on_last="ignore", risk_min=0.0, risk_max=1e9, extra=("hi7_prior",))
    trades = oc.one_open_per_key(oc.first_touch(panel, signals(panel), exit))
    # The end of the data closes open trades in the batch; the stream leaves them open.
    batch = trades.filter("NOT (why = 'time' AND bars < 20)").select("isin", "entry", "exit", "bars", "why").orderBy("isin", "r").collect()
    stream = QUERIES["ST5_position_lifecycle"](spark, sf).orderBy("isin", "entry_date").collect()
    assert len(stream) > 20
    assert [(r.isin, r.bars, r.why) for r in stream] == [(r.isin, r.bars, r.why) for r in batch]
    assert [x for r in stream for x in (r.entry, r.exit)] == pytest.approx([x for r in batch for x in (r.entry, r.exit)], abs=1e-3)


def test_late_bars_of_a_position_stream_are_reported():
    import datetime as dt
    import pandas as pd
    from panelspark.streaming.positions import Positions

    class Held:
        def __init__(self):
            self.value = None
        def exists(self):
            return self.value is not None
        def get(self):
            return self.value
        def update(self, value):
            self.value = value

    def bars(*days):
        return pd.DataFrame([(dt.date(2024, 1, x), 10.0, 10.0, 9.0, 1.0, 0) for x in days], columns=["date", "adj_open", "adj_close", "hi7_prior", "atr_pct", "signal"])

    follow = Positions(1.0, 20)
    follow.state = Held()
    assert list(follow.handleInputRows(("A",), iter([bars(1), bars(3)]), None)) == []
    (late,) = follow.handleInputRows(("A",), iter([bars(2, 4)]), None)
    assert [(r.entry_date.day, r.why) for r in late.itertuples()] == [(2, "late")] and follow.state.value[1] == 3
