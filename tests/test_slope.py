"""The clustered slope on groups that are hard for sums of squares."""

import numpy as np
import pytest

from panelspark.operators.validation import clustered_slope


def test_slope_keeps_small_spreads_and_flat_groups(spark):
    draw = np.random.default_rng(7)
    far = [("far", float(1e6 + x), float(3 * x + e), i % 12) for i, (x, e) in enumerate(zip(draw.uniform(-10, 10, 60), draw.normal(size=60)))]
    rows = far + [("flat", 0.1, float(i), i % 4) for i in range(30)] + [("few", float(i), float(i), i) for i in range(5)]
    got = {r["g"]: r for r in clustered_slope(spark.createDataFrame(rows, "g string, x double, y double, c int"), ["g"], "y", "x", "c").collect()}
    assert set(got) == {"far", "flat", "few"}
    x, y, c = (np.array([r[i] for r in far]) for i in (1, 2, 3))
    z = x - x.mean()
    slope = (z @ y) / (z @ z)
    e = y - y.mean() - slope * z
    t = slope / np.sqrt(sum((z[c == k] @ e[c == k]) ** 2 for k in set(c))) * (z @ z)
    assert got["far"]["slope"] == pytest.approx(slope, rel=1e-9) and got["far"]["t_cluster"] == pytest.approx(t, rel=1e-6)
    for g, n in (("flat", 30), ("few", 5)):
        assert (got[g]["n"], got[g]["slope"], got[g]["t_cluster"]) == (n, None, None)
