"""Plans and edge cases that small results do not show."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.functions import order_stats
from panelspark.operators import outcomes as oc
from panelspark.registry import QUERIES
from panelspark.registry.outcomes import positioned, signals
from panelspark.sources import panels


def plan(df, mode="executedPlan"):
    return getattr(df._jdf.queryExecution(), mode)().toString()


@pytest.mark.parametrize("panel", [panels.week_panel, panels.day_panel])
def test_bars_do_not_sort_raw_rows(spark, sf, panel):
    text = plan(panel(spark, sf))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_packed_orders_like_the_tuple(spark):
    rows = [(0, 1, 5), (0, 1, 4), (6, 0, 0), (0, 10**12, 1), (3, 2, 10**10), (3, 2, None)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    order = panels.packed([(F.col("a"), 1), (F.col("b"), 13), (F.col("c"), 11)])
    got = [(r.a, r.b, r.c) for r in df.filter("c IS NOT NULL").orderBy(order).collect()]
    assert got == sorted(r for r in rows if r[2] is not None)
    assert df.filter("c IS NULL").select(order.alias("o")).first().o is None
    for bad in (10, -1):
        with pytest.raises(PySparkException, match="more than 1 digits"):
            spark.createDataFrame([(bad, 0, 0)], "a long, b long, c long").select(order).collect()


def test_only_what_the_exit_reads_follows_the_path(spark, sf):
    panel = positioned(spark, sf)
    exit = oc.Exit(("atr", 0.2), trigger="adj_close > hi7_prior", extra=("hi7_prior",))
    wide = signals(panel).withColumn("ballast", F.lit("x"))
    text = plan(oc.first_touch(panel, wide, exit), "optimizedPlan")
    line = next(x for x in text.splitlines() if "Generate explode" in x)
    assert "ballast" not in line
    above = [x for x in text.splitlines() if "ballast" in x and "sequence" in x]
    assert not above


def test_nan_takes_no_part_in_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None)], "g string, x double")
    assert order_stats.quantiles(df, ["g"], "x", {"q": 0.5}).first().q == 2.0


def test_grid_has_no_nested_loop(spark, sf):
    text = plan(QUERIES["S11_series_grid"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_last_rows_and_hour_bars_hash_and_do_not_sort(spark):
    from panelspark.operators.upsert import keep_last
    from panelspark.sources.bars import hour_bars
    rows = spark.createDataFrame([("A", 1, 1.0, 5), ("A", 2, None, 6), ("B", 1, 2.0, 7)], "isin string, seq bigint, close double, volume bigint")
    last = keep_last(rows, ["isin"], F.col("seq"))
    assert {tuple(r) for r in last.collect()} == {("A", 2, None, 6), ("B", 1, 2.0, 7)}
    minutes = spark.sql("SELECT 'A' isin, timestamp_ntz'2024-01-01 09:20:00' ts, 1.0D open, 2.0D high, 0.5D low, 1.5D close, 3L volume, 9L event_id "
                        "UNION ALL SELECT 'A', timestamp_ntz'2024-01-01 09:20:00', 7.0D, 8.0D, 6.0D, 7.5D, 3L, 4L")
    bars = hour_bars(minutes)
    assert [(r.open, r.close, r.volume) for r in bars.collect()] == [(7.0, 1.5, 6)]
    for df in (last, bars):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan
