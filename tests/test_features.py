import math

import numpy as np
import pandas as pd
import pytest
from frames import bars, path, walk
from pyspark.sql import functions as F

from panelspark.functions import ewm, events as ev, order_stats as os_
from panelspark.functions.windows import Series
from panelspark.operators.features import build_features
from panelspark.operators.quality import causality_audit
from panelspark.operators.validation import erfc


def one(spark, rows, *wanted):
    return build_features(bars(spark, rows), wanted or None).orderBy("date").toPandas()


def test_recursions_match_a_plain_loop(spark):
    rows = walk(600, seed=3)
    got = one(spark, rows, "ema_9", "ema_200", "rsi_14", "rsi_2", "atr_14")
    c = pd.Series([r[5] for r in rows])
    for span in (9, 200):
        want = c.ewm(span=span, adjust=False).mean().where(np.arange(1, 601) >= span)
        np.testing.assert_allclose(got[f"ema_{span}"], want, rtol=1e-12)
    gain = loss = None
    rsi = []
    for d in c.diff():
        if np.isnan(d):
            rsi.append(np.nan)
            continue
        up, down = max(d, 0), max(-d, 0)
        gain, loss = (up, down) if gain is None else (gain / 2 + up / 2, loss / 2 + down / 2)
        rsi.append(100 - 100 / (1 + gain / loss) if loss else (100 if gain else 50))
    np.testing.assert_allclose(got["rsi_2"][2:], rsi[2:], rtol=1e-9)
    assert got["rsi_14"].dropna().between(0, 100).all()
    assert got["atr_14"].isna().sum() == 14


def test_recursion_over_many_blocks(spark):
    """A fast decay cuts a long series into several blocks; the carry keeps them exact."""
    x = np.random.default_rng(5).uniform(1, 1000, 3000)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "isin string, i int, x double")
    s = Series(("isin",), ("i",))
    got = ewm.ewm_scan(df, {"y": ("x", 0.5), "z": ("x", 0.2)}, s).orderBy("i").toPandas()
    for name, a in (("y", 0.5), ("z", 0.2)):
        np.testing.assert_allclose(got[name], pd.Series(x).ewm(alpha=a, adjust=False).mean(), rtol=1e-12)
    adjusted = ewm.ewm_mean_adjusted(df, "x", "m", 10, s).orderBy("i").toPandas()
    np.testing.assert_allclose(adjusted["m"], pd.Series(x).ewm(span=10).mean(), rtol=1e-9)


def test_leading_nulls_are_skipped(spark):
    df = spark.createDataFrame([("A", 0, None), ("A", 1, 4.0), ("A", 2, 8.0)], "isin string, i int, x double")
    got = ewm.ewm_scan(df, {"y": ("x", 0.5)}, Series(("isin",), ("i",))).orderBy("i").toPandas()["y"].tolist()
    assert math.isnan(got[0]) and got[1:] == [4.0, 6.0]


def test_flat_series_strength_is_neutral(spark):
    got = one(spark, path([100.0] * 30), "rsi_14")
    assert got["rsi_14"].iloc[-1] == 50.0
    rising = one(spark, path([100.0 + i for i in range(30)]), "rsi_14")
    assert rising["rsi_14"].iloc[-1] == 100.0


def test_levels_come_from_the_finished_period(spark):
    got = one(spark, walk(120, seed=4), "m_p", "w_p", "m_cpr_tc", "m_cpr_bc")
    month = pd.to_datetime(got["date"]).dt.to_period("M")
    assert (got.groupby(month)["m_p"].nunique(dropna=False) == 1).all()
    assert got.loc[month == month.iloc[0], "m_p"].isna().all()
    prior = got[month == month.iloc[0]]
    want = (prior["adj_high"].max() + prior["adj_low"].min() + prior["adj_close"].iloc[-1]) / 3
    second = sorted(month.unique())[1]
    assert got.loc[month == second, "m_p"].iloc[0] == pytest.approx(want)
    assert (got["m_cpr_tc"].dropna() >= got["m_cpr_bc"].dropna()).all()


def test_no_column_sees_the_future(spark):
    rows = bars(spark, walk(420, seed=9))
    columns = [n for n in build_features(rows).columns if n not in rows.columns and n != "levels_basis"]
    cut = walk(420, seed=9)[390][1]
    bad = causality_audit(rows, build_features, str(cut), columns).filter("mismatches > 0").collect()
    assert bad == []


def test_demand_driven_build_equals_the_full_panel(spark):
    rows = bars(spark, walk(300, "A", 1), walk(280, "B", 2))
    wanted = ["brk_cushion", "since_r1_vol_breakout", "contract_seq", "tight_3w_pct", "m_cpr_width_rank"]
    full = build_features(rows).select("isin", "date", *wanted).orderBy("isin", "date").toPandas()
    part = build_features(rows, wanted).select("isin", "date", *wanted).orderBy("isin", "date").toPandas()
    pd.testing.assert_frame_equal(full, part)


def test_events(spark):
    flags = [0, 1, 1, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([("A", i + 1, bool(f)) for i, f in enumerate(flags)], "isin string, r int, e boolean")
    s = Series(("isin",), ("r",))
    e = F.col("e")
    got = df.select("r", ev.rows_since(e, s).alias("since"), ev.run_length(e, s).alias("run"),
                    ev.fresh_after_quiet(e, 2, s).alias("fa"), ev.fresh_or_first(e, 2, s).alias("fb")).orderBy("r").toPandas()
    assert got["since"].fillna(-1).tolist() == [-1, 0, 0, 1, 2, 3, 0, 1]
    assert got["run"].tolist() == [0, 1, 2, 0, 0, 0, 1, 0]
    assert got["fa"].tolist() == [False] * 6 + [True, False]
    assert got["fb"].tolist() == [False, True] + [False] * 4 + [True, False]


def test_two_threshold_gate_equals_the_loop(spark):
    rng = np.random.default_rng(0)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.uniform(20, 80, 300)]
    state, want = None, []
    for v in x:
        if v is None:
            want.append(None)
            continue
        state = (1 if v > 50 else 0) if state is None else 0 if state and v < 40 else 1 if not state and v > 50 else state
        want.append(state)
    df = spark.createDataFrame(list(enumerate(x)), "date int, x double")
    got = [r[0] for r in df.select(ev.schmitt(F.col("x")).alias("g"), "date").orderBy("date").select("g").collect()]
    assert got == want


def test_ranks_and_quantiles_match_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.choice([0.0, -1.5, 3.25, np.nan], 400, p=[0.4, 0.2, 0.2, 0.2]) + np.where(rng.random(400) < 0.5, rng.normal(0, 5, 400).round(2), 0)
    g = rng.choice(["u", "v"], 400)
    pdf = pd.DataFrame({"i": range(400), "g": g, "x": x})
    df = spark.createDataFrame([(int(i), a, None if np.isnan(b) else float(b)) for i, a, b in pdf.itertuples(index=False)], "i int, g string, x double")
    got = os_.with_ranks(df, ["i"], ["g"], {"p": "x"}).orderBy("i").toPandas()["p"]
    np.testing.assert_allclose(got, pdf.groupby("g")["x"].rank(pct=True), rtol=1e-12)
    q = os_.quantiles(df, ["g"], "x", {"a": 0.1, "m": 0.5, "z": 1.0}).toPandas().set_index("g")
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 1.0)):
        np.testing.assert_allclose(q[name].sort_index(), pdf.groupby("g")["x"].quantile(p).sort_index(), rtol=1e-12)


def test_erfc(spark):
    xs = [0.0, 0.3, 1.0, 2.4, 2.6, 4.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in xs], "x double").select(erfc(F.col("x"))).collect()]
    np.testing.assert_allclose(got, [math.erfc(v) for v in xs], rtol=1e-7)
