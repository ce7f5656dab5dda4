"""The gate study on random trades against a plain loop over trades, and the shape of its plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import gate_study as gs

NAMES = ["a", "b", "c"]
WANTED = gs.singles(NAMES) + gs.pairs(NAMES) + [gs.Combination("a AND NOT b", "a", "b", "AND_NOT")]
MAIN = ["x", "y"]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=200)
    gates = pd.DataFrame([(g, d, None if rng.random() < 0.1 else int(rng.random() < 0.6)) for g in NAMES for d in days], columns=["gate", "date", "on"]).astype({"on": "Int64"})
    trades = pd.DataFrame([(str(rng.choice(["x", "y", "z"])), days[int(rng.integers(200))], float(rng.normal(0.5, 3))) for _ in range(3000)], columns=["strategy", "date", "net"])
    rows = [(r.gate, r.date.date(), None if pd.isna(r.on) else int(r.on)) for r in gates.itertuples()]
    return (trades, gates, spark.createDataFrame([(r.strategy, r.date.date(), r.net) for r in trades.itertuples()], "strategy string, date date, net double"),
            gs.date_masks(spark.createDataFrame(rows, "gate string, date date, on int"), NAMES))


def slope_t(y, x, cluster):
    """The clustered t of the slope by its matrix formula."""
    design = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    scores = pd.DataFrame(design * (y - design @ beta)[:, None]).groupby(cluster).sum().to_numpy()
    return beta[1] / np.sqrt((inverse @ scores.T @ scores @ inverse)[1, 1])


def test_cells_against_a_loop(study):
    trades, gates, df, masks = study
    split = pd.Timestamp("2024-04-10")
    got = gs.gate_cells(df, masks, NAMES, WANTED, MAIN, F.lit("2024-04-10").cast("date")).toPandas().set_index(["gate", "strategy", "half"])
    state = gates.pivot(index="date", columns="gate", values="on")
    seen = 0
    for w in WANTED:
        known = state[w.a].notna() & state[w.b].notna()
        a, b = state[w.a][known] == 1, state[w.b][known] == 1
        on = {"AND": a & b, "OR": a | b, "AND_NOT": a & ~b}[w.mode]
        met = trades.merge(on.rename("on").reset_index(), on="date")
        for strategy in ("x", "y", "z", gs.POOLED):
            some = met[met.strategy.isin(MAIN)] if strategy == gs.POOLED else met[met.strategy == strategy]
            for half, part in (("H1", some[some.date < split]), ("H2", some[some.date >= split])):
                row, x = got.loc[(w.name, strategy, half)], part.on.to_numpy(bool)
                assert (row.n_on, row.n_off, row.n_all) == (x.sum(), (~x).sum(), len(x))
                assert row["diff"] == pytest.approx(part.net[x].mean() - part.net[~x].mean())
                assert row.win_on == pytest.approx((part.net[x] > 0).mean() * 100)
                assert row.t_cluster == pytest.approx(slope_t(part.net.to_numpy(), x.astype(float), part.date.to_numpy()))
                seen += 1
    assert seen == len(got) == 8 * len(WANTED)


def test_no_trade_meets_a_gate(study):
    """Gates are unfolded above the sums by date and mask."""
    _, _, df, masks = study
    plan = gs.gate_verdicts(df, masks, NAMES, WANTED, MAIN, F.lit("2024-04-10").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("Generate explode(")[1:]:
        lines = part.splitlines()
        depth = len(lines[0]) - len(lines[0].lstrip(" :+-"))
        below = [line for line in lines[1:] if "Aggregate" in line or "Join" in line]
        assert below and "Aggregate" in below[0], below[:1]
        assert depth >= 0


def test_more_gates_than_bits():
    with pytest.raises(ValueError):
        gs.date_masks(None, [str(i) for i in range(65)])
