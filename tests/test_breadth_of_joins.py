"""Interval joins with hot keys, places without a window over all, grouping sets in one exchange."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.order_stats import row_numbers
from panelspark.operators import dims, stats

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=int(n))


@pytest.fixture(scope="module")
def history(spark):
    """One symbol shared by very many keys, keys with many short intervals, open and empty intervals."""
    rng = np.random.default_rng(4)
    rows = [(f"K{k}", "HOT", day(rng.integers(0, 3000)), None if k % 3 else day(3000 + rng.integers(0, 2000))) for k in range(700)]
    for k in range(30):
        cuts = np.sort(rng.choice(5000, 12, replace=False))
        rows += [(f"N{k}", f"S{k % 5}{i}", day(a), day(b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows += [("N1", "EMPTY", day(10), day(10)), ("Z", "LATE", day(90_000), None)]
    return rows, spark.createDataFrame(rows, "isin string, symbol string, from_date date, to_date date")


def live(row, when):
    return row[2] <= when and (row[3] is None or row[3] > when)


@pytest.mark.parametrize("part_rows", [50, 200_000])
def test_isins_for_symbol(spark, history, part_rows):
    rows, frame = history
    asked = [(s, day(n)) for s in ("HOT", "S03", "S47", "EMPTY", "LATE", "NONE") for n in (0, 10, 1500, 3500, 4999)]
    got = dims.isins_for_symbol(spark.createDataFrame([*asked, asked[0]], "symbol string, date date"), frame, part_rows).collect()
    want = set()
    for s, when in asked:
        found = {r[0] for r in rows if r[1] == s and live(r, when)}
        want |= {(s, when, i) for i in found} or {(s, when, None)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("part_rows", [5, 200_000])
def test_symbol_on(spark, history, part_rows):
    rows, frame = history
    asked = [(i, day(n)) for i in ("N1", "N7", "K3", "Z", "?") for n in (-50, 5, 10, 2500, 4998, 9000)]
    got = {(r.isin, r.date): r.symbol for r in dims.symbol_on(spark.createDataFrame(asked, "isin string, date date"), frame, part_rows).collect()}
    for i, when in asked:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[2])
        now = [r for r in own if live(r, when)]
        assert got[(i, when)] == (now[-1][1] if now else own[0][1] if own else None), (i, when)


def test_no_set_is_collected(spark, history):
    probes = spark.createDataFrame([("HOT", day(1))], "symbol string, date date")
    plan = dims.isins_for_symbol(probes, history[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_row_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", None if rng.random() < 0.1 else float(rng.integers(0, 40))) for k in range(500)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.place for r in row_numbers(frame, ["k"], "v", "place").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i for i, (k, _) in enumerate(order, 1)}


def test_breakdowns_are_one_exchange(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{k % 2}", day(rng.integers(0, 900)), [None, "Mid", "Large"][int(rng.integers(3))], *(None if rng.random() < 0.1 else float(rng.normal()) for _ in range(4))) for k in range(800)]
    hits = spark.createDataFrame(rows, "rule string, date date, band string, exc_1d double, exc_5d double, fwd_1d double, fwd_5d double")
    dimensions = {"cap_band": F.col("band"), "year": F.year("date")}
    made = stats.breakdowns(hits, dimensions, [1, 5])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    got = {(r.rule, r.dimension, r.group, r.horizon): r for r in made.collect()}
    for (rule, dimension, group, horizon), r in got.items():
        mine = [x for x in rows if x[0] == rule and (dimension == "all" or group == (x[2] if dimension == "cap_band" else str(x[1].year)))]
        values = [x[3 if horizon == "1" else 4] for x in mine]
        values = [v for v in values if v is not None]
        assert r.n == len(values) and r.mean == pytest.approx(np.mean(values))
    assert len(got) == 2 * 2 * (1 + 2 + 3)
    mids = {(r.rule, r.dimension, r.group, r.horizon): r.median for r in stats.breakdown_quartiles(hits, dimensions, [1, 5]).collect()}
    every = [x[3] for x in rows if x[0] == "r0" and x[3] is not None]
    assert set(mids) == set(got) and mids[("r0", "all", "all", "1")] == pytest.approx(np.median(every))
