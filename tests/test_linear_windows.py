"""Wide frames from running sums and lagged blocks: values against pandas, plans and time that do not grow with the frame."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.ewm import ewm_scan
from panelspark.functions.windows import BLOCK, LINEAR, PANEL as S
from panelspark.operators.features import build_features


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, None if rng.random() < 0.05 else float(100 + rng.normal(0, 1) * 5 + i / 10), float(rng.normal() / 50)) for k in ("a", "b") for i in range(700 if k == "a" else 90)]
    return pd.DataFrame(rows, columns=["isin", "date", "x", "y"]).astype({"x": float}), spark.createDataFrame(rows, "isin string, date int, x double, y double")


def rolled(frame, n, least, how, prior):
    return frame.groupby("isin")["x"].transform(lambda v: getattr((v.shift() if prior else v).rolling(n, min_periods=least), how)())


@pytest.mark.parametrize("prior", [False, True])
@pytest.mark.parametrize("n", [LINEAR, 60, 61, 250, 500])
def test_values(series, n, prior):
    frame, df = series
    least = n // 2
    x = F.col("x")
    df = df.withColumns({"top": S.highest(x, BLOCK, 1), "low": S.lowest(x, BLOCK, 1)})
    got = df.select("isin", "date", S.mean(x, n, least, prior).alias("mean"), S.total(x, n, least, prior).alias("sum"),
                    S.wide(F.greatest, x, F.col("top"), n, least, prior).alias("max"), S.wide(F.least, x, F.col("low"), n, least, prior).alias("min")).toPandas()
    got = got.sort_values(["isin", "date"]).reset_index(drop=True)
    for how in ("mean", "sum", "max", "min"):
        want = rolled(frame, n, least, how, prior)
        assert (got[how].isna() == want.isna()).all() and np.allclose(got[how].dropna(), want.dropna(), rtol=1e-11), how


def test_beta(series):
    frame, df = series
    got = df.select("isin", "date", S.beta(F.col("x"), F.col("y"), 120, 60).alias("b")).toPandas().sort_values(["isin", "date"])["b"].to_numpy()
    for start, size in ((0, 700), (700, 90)):
        part = frame.iloc[start:start + size]
        for i in range(size):
            w = part.iloc[max(0, i - 119):i + 1].dropna()
            assert np.isnan(got[start + i]) if len(w) < 60 else np.isclose(got[start + i], np.cov(w.x, w.y)[0, 1] / w.y.var(), rtol=1e-7)


def test_no_wide_moving_frame_in_the_panel(spark):
    """Beyond ``LINEAR`` rows every frame of the feature panel is a running one."""
    bars = spark.createDataFrame([], "isin string, date date, adj_open double, adj_high double, adj_low double, adj_close double, volume bigint, turnover double")
    plan = build_features(bars)._jdf.queryExecution().optimizedPlan().toString()
    widths = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), (?:-1|currentrow)", plan)]
    assert widths and max(widths) < LINEAR, max(widths)


def test_twice_the_frame_not_twice_the_time(spark):
    df = spark.range(0, 120_000, numPartitions=1).select(F.lit("a").alias("isin"), F.col("id").alias("date"), F.rand(1).alias("x")).cache()
    df.count()

    def seconds(n):
        start = time.time()
        df.select(S.mean(F.col("x"), n).alias("m")).write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds(500)
    assert min(seconds(8000) for _ in range(2)) < 3 * min(seconds(500) for _ in range(2)) + 1  # 16 times the frame


def test_recursions_that_share_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, *((None, None) if i == 0 else (max(d, 0.0), max(-d, 0.0)))) for i, d in enumerate(rng.normal(size=2000).tolist())]
    df = spark.createDataFrame(rows, "isin string, date int, up double, down double")
    specs = {"u": ("up", 0.5, "up"), "d": ("down", 0.5, "up"), "v": ("down", 0.1)}
    got = ewm_scan(df, specs).toPandas().sort_values("date")
    for out, spec in specs.items():
        want = pd.Series([r[2] if spec[0] == "up" else r[3] for r in rows], dtype=float).ewm(alpha=spec[1], adjust=False, ignore_na=True).mean()
        assert np.allclose(got[out].to_numpy()[1:], want.to_numpy()[1:], rtol=1e-9)
    plan = ewm_scan(df, specs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[", plan)) <= 4
