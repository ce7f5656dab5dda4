"""Literal and seeded frames."""

import datetime as dt

import numpy as np
import pandas as pd

BARS = ("isin string, date date, adj_open double, adj_high double, adj_low double, adj_close double, volume bigint, "
        "turnover double, symbol string, close double")


def days(n, start="2020-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def path(closes, isin="A", volume=1000, start="2020-01-01"):
    """Bars from closes: open is the previous close, high and low one per cent beyond both."""
    rows, prev = [], closes[0]
    for d, c in zip(days(len(closes), start), closes):
        o = prev
        rows.append((isin, d, float(o), max(o, c) * 1.01, min(o, c) * 0.99, float(c), volume, None, isin, None))
        prev = c
    return rows


def walk(n, isin="A", seed=1, start="2020-01-01"):
    rng = np.random.default_rng(seed)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    rows = []
    prev = closes[0]
    for i, d in enumerate(days(n, start)):
        o = prev * (1 + rng.normal(0, 0.004))
        h, low = max(o, closes[i]) * (1 + rng.uniform(0.001, 0.02)), min(o, closes[i]) * (1 - rng.uniform(0.001, 0.02))
        rows.append((isin, d, float(o), float(h), float(low), float(closes[i]), int(rng.integers(1000, 9000)), None, isin, None))
        prev = closes[i]
    return rows


def bars(spark, *blocks):
    return spark.createDataFrame([r for b in blocks for r in b], BARS)


def date(text):
    return dt.date.fromisoformat(text)
