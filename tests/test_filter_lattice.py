"""Combinations of filters from masks against a loop over trades; a planted combination leads the board."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import filter_lattice as fl

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(9)
    n = 4000
    flags = rng.random((n, 4)) < [0.6, 0.6, 0.5, 0.3]
    net = rng.normal(-0.5, 4, n) + 3 * (flags[:, 0] & flags[:, 1])
    days = pd.to_datetime("2023-01-02") + pd.to_timedelta(rng.integers(0, 700, n), "D")
    frame = pd.DataFrame({"sid": [f"t{k}" for k in range(n)], "date": days, "net": net, "half": np.where(days < "2024-01-01", "H1", "H2"), "bad": net < -5, "good": net > 3})
    trades = spark.createDataFrame([(r.sid, r.date.date(), float(r.net), r.half, bool(r.bad), bool(r.good)) for r in frame.itertuples()], "sid string, date date, net double, half string, bad boolean, good boolean")
    kept = spark.createDataFrame([(NAMES[j], f"t{i}") for i, j in zip(*np.nonzero(flags))], "candidate string, sid string")
    leaders = fl.numbered(spark.createDataFrame([(c,) for c in NAMES], "candidate string"), ["candidate"])
    return frame, flags, fl.combinations(fl.masked(trades, kept, leaders), leaders)


def test_every_combination_against_a_loop(made):
    frame, flags, results = made
    got = {(r["filter"], r.half): r for r in results.collect()}
    combos = [c for k in (1, 2, 3) for c in itertools.combinations(range(4), k)]
    assert len(got) == 2 * len(combos)
    for combo in combos:
        keep = flags[:, combo].all(axis=1)
        for half in ("H1", "H2"):
            part = (frame.half == half).to_numpy()
            k, r = frame[keep & part], frame[~keep & part]
            row = got[(" AND ".join(NAMES[i] for i in combo), half)]
            assert (row.n_all, row.n_kept, row.k) == (part.sum(), len(k), len(combo))
            assert row.mean_kept == pytest.approx(k.net.mean()) and row.win_removed == pytest.approx((r.net > 0).mean())
            assert row.cost == pytest.approx(r.good.sum() / r.bad.sum()) and row.bad_removed_share == pytest.approx(r.bad.sum() / frame.bad[part].sum())
            months = (frame.date[part].max() - frame.date[part].min()).days / 30.44
            assert row.kept_per_month == pytest.approx(len(k) / months)


def test_the_planted_pair_leads(made):
    board = fl.leaderboard(made[2]).orderBy("place").collect()
    assert {"a", "b"} <= set(board[0]["filter"].split(" AND ")) and "a AND b" in {r["filter"] for r in board}
    assert [r.place for r in board] == list(range(1, len(board) + 1))


def test_no_trade_meets_a_combination(made):
    """The combinations are unfolded on one side of a join whose other side is an aggregate."""
    plan = made[2]._jdf.queryExecution().optimizedPlan().toString()
    at = next(i for i, line in enumerate(plan.splitlines()) if re.search(r"Join (Cross|Inner)\s*$", line) or "Join Cross" in line)
    below = [line for line in plan.splitlines()[at + 1:] if "Aggregate" in line or "Join" in line or "LogicalRDD" in line]
    assert "Aggregate" in below[0]


def test_no_leaders(spark, made):
    leaders = fl.numbered(spark.createDataFrame([], "candidate string"), ["candidate"])
    trades = spark.createDataFrame([("x", "H1", 1.0, False, True)], "sid string, half string, net double, bad boolean, good boolean").withColumn("date", F.lit("2024-01-01").cast("date"))
    kept = spark.createDataFrame([], "candidate string, sid string")
    assert fl.combinations(fl.masked(trades, kept, leaders), leaders).count() == 0
