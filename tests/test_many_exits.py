"""Several exits on one path give what each gives alone, from one path join."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelspark.operators import outcomes as oc
from panelspark.registry import outcomes as ro

CELLS = {
    "bracket": ro.BRACKET, "reversal": oc.REVERSAL, "close stop": ro.CLOSE_STOP, "family": ro.TREND,
    "breakeven": replace(ro.BRACKET, manage="breakeven"), "half": replace(ro.BRACKET, manage="half", cap=40), "low5": replace(ro.BRACKET, manage="low5"),
    "chandelier": oc.Exit(("pct", 10.0), trigger="adj_close < peak - atr_abs * 3", why="trail", cap=60, risk_max=50.0), "nothing": oc.Exit(cap=5),
}
COLUMNS = ["sid", "entry", "exit", "bars", "why", "gross", "net", "exit_r", "r_multiple", "mae", "mfe", "risk_pct"]


@pytest.fixture(scope="module")
def panel(spark, sf):
    return ro.positioned(spark, sf)


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def test_every_cell_equals_its_own_run(panel):
    signals = ro.signals(panel)
    both = oc.many_touches(panel, signals, CELLS, excursions=True).persist()
    for name, exit in CELLS.items():
        assert rows(both.filter(F.col("cell") == name)) == rows(oc.first_touch(panel, signals, exit, excursions=True)), name


def test_a_cell_can_be_limited_to_some_signals(panel):
    signals = ro.signals(panel)
    even = F.col("r") % 2 == 0
    got = oc.many_touches(panel, signals, {"a": ro.BRACKET, "b": oc.REVERSAL}, excursions=True, only={"a": even})
    assert rows(got.filter("cell = 'a'")) == rows(oc.first_touch(panel, signals.filter(even), ro.BRACKET, excursions=True))
    assert rows(got.filter("cell = 'b'")) == rows(oc.first_touch(panel, signals, oc.REVERSAL, excursions=True))


def test_one_path_join_for_any_number_of_exits(panel):
    def joins(n):
        cells = {f"{k}": oc.Exit(("pct", float(k)), target=2.0) for k in range(2, 2 + n)}
        plan = oc.many_touches(panel, ro.signals(panel), cells)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"\bJoin ", plan))

    assert joins(1) == joins(3) == joins(8) == 2  # the path, and the signals' own columns


def test_no_signals(panel):
    assert oc.many_touches(panel, ro.signals(panel).limit(0), CELLS).count() == 0
