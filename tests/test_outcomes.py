import pytest
from frames import BARS, days
from pyspark.sql import functions as F

from panelspark.operators import outcomes as oc
from panelspark.operators.setups import alternative_entry


def panel(spark, ohlc, isin="A", **extra):
    """Rows (open, high, low, close) on consecutive sessions, with constant extra columns."""
    rows = [(isin, d, float(o), float(h), float(l), float(c), 1, None, isin, None) for d, (o, h, l, c) in zip(days(len(ohlc)), ohlc)]
    df = spark.createDataFrame(rows, BARS)
    for name, value in {"atr_pct": 10.0, "hi7_prior": 1e9, "ema_21": 0.0, "low5_prior": 0.0, **extra}.items():
        df = df.withColumn(name, F.lit(value))
    return oc.with_position(df)


def run(p, exit, at=1, **kw):
    sig = p.filter(F.col("r") == at).withColumn("sid", F.concat_ws("|", "isin", "r"))
    return [r.asDict() for r in oc.first_touch(p, sig, exit, **kw).collect()]


FLAT = [(100, 101, 99, 100)]
BRACKET = oc.Exit(("pct", 10.0), target=2.0, cap=5)


def test_stop_wins_a_tie(spark):
    got = run(panel(spark, FLAT + [(100, 121, 89, 100)] + FLAT), BRACKET)[0]
    assert (got["why"], got["exit"], got["bars"]) == ("stop", pytest.approx(90), 1)


def test_gaps_fill_at_the_open(spark):
    down = run(panel(spark, FLAT * 2 + [(80, 82, 79, 81)]), BRACKET)[0]
    up = run(panel(spark, FLAT * 2 + [(130, 131, 128, 129)]), BRACKET)[0]
    assert (down["why"], down["exit"]) == ("stop", 80) and (up["why"], up["exit"]) == ("target", 130)


def test_untouched_trade_ends_at_the_cap_close_and_is_not_a_stop(spark):
    got = run(panel(spark, FLAT * 10), BRACKET)[0]
    assert (got["why"], got["exit"], got["bars"]) == ("time", 100, 5)


def test_short_history_ends_on_the_last_row(spark):
    got = run(panel(spark, FLAT * 4), BRACKET)[0]
    assert (got["why"], got["bars"]) == ("time", 3)


def test_signal_on_the_last_row_is_dropped(spark):
    assert run(panel(spark, FLAT * 3), BRACKET, at=3) == []


def test_risk_bounds_drop_signals(spark):
    assert run(panel(spark, FLAT * 4), oc.Exit(("pct", 25.0), target=1.0)) == []


def test_signal_values_are_kept(spark):
    got = run(panel(spark, [(50, 60, 40, 55)] + FLAT * 3), oc.Exit(("pct", 10.0), target=1.0, cap=2))[0]
    assert got["adj_close"] == 55 and got["entry"] == 100


def test_reversal_exits_at_the_next_open_or_the_last_close(spark):
    rows = FLAT * 2 + [(100, 111, 99, 110), (107, 108, 106, 107)]
    got = run(panel(spark, rows, hi7_prior=105.0), oc.REVERSAL)[0]
    assert (got["why"], got["exit"], got["bars"]) == ("reversal", 107, 3)
    assert got["net"] == pytest.approx(7 - 0.30)
    last = run(panel(spark, rows[:3], hi7_prior=105.0), oc.REVERSAL)[0]
    assert (last["why"], last["exit"], last["bars"]) == ("reversal", 110, 2)


def test_trigger_on_the_last_row_can_be_ignored(spark):
    exit = oc.Exit(("pct", 10.0), trigger="adj_close > hi7_prior", cap=20, on_last="ignore", extra=("hi7_prior",))
    got = run(panel(spark, FLAT * 2 + [(100, 111, 99, 110)], hi7_prior=105.0), exit)[0]
    assert (got["why"], got["exit"]) == ("time", 110)


def test_close_based_stop_waits_for_the_close(spark):
    exit = oc.Exit(("pct", 10.0), cap=5, stop_on="close", on_last="open")
    touched = run(panel(spark, FLAT * 2 + [(100, 101, 80, 95)] + FLAT * 4), exit)[0]
    closed = run(panel(spark, FLAT * 2 + [(100, 101, 80, 85), (84, 90, 83, 88)] + FLAT), exit)[0]
    assert touched["why"] == "time" and (closed["why"], closed["exit"]) == ("stop", 84)


def test_breakeven_stop_is_live_only_after_the_arming_row(spark):
    exit = oc.Exit(("pct", 10.0), cap=6, manage="breakeven")
    rows = FLAT + [(100, 112, 99, 111), (111, 111, 95, 99)] + FLAT * 4
    got = run(panel(spark, rows), exit)[0]
    assert (got["why"], got["exit"], got["bars"]) == ("tstop", 100, 2)


def test_half_position_books_half_at_one_r(spark):
    exit = oc.Exit(("pct", 10.0), cap=2, manage="half")
    got = run(panel(spark, FLAT + [(100, 115, 99, 112), (112, 113, 111, 112)], atr_pct=50.0), exit)[0]
    assert got["gross"] == pytest.approx(0.5 * 10 + 0.5 * 12)


def test_excursions_cover_the_holding_path(spark):
    got = run(panel(spark, FLAT + [(100, 103, 95, 101), (101, 108, 97, 104)]), oc.Exit(("pct", 10.0), cap=2), excursions=True)[0]
    assert got["mae"] == pytest.approx(-5) and got["mfe"] == pytest.approx(8)


def test_one_open_position_per_key(spark):
    rows = [("A", 1, 5), ("A", 5, 9), ("A", 6, 7), ("A", 8, 12), ("B", 5, 6)]
    df = spark.createDataFrame(rows, "isin string, r int, exit_r int")
    got = sorted((r.isin, r.r) for r in oc.one_open_per_key(df).collect())
    assert got == [("A", 1), ("A", 6), ("A", 8), ("B", 5)]


def test_keys_never_mix(spark):
    both = panel(spark, FLAT * 2).unionByName(panel(spark, [(10, 10.5, 9.5, 10)] * 8, "B"))
    sig = both.filter("r = 1").withColumn("sid", F.concat_ws("|", "isin", "r"))
    got = {r.isin: (r.bars, r.exit) for r in oc.first_touch(both, sig, BRACKET).collect()}
    assert got == {"A": (1, 100), "B": (5, 10)}


def test_limit_entry(spark):
    p = panel(spark, FLAT + [(100, 101, 99, 100), (97, 99, 96, 98)] + FLAT)
    sig = p.filter("r = 1").withColumn("sid", F.lit("x"))
    got = alternative_entry(p, sig, "limit", 3).first()
    assert (got.entry_k, got.entry) == (2, 97)
    assert alternative_entry(p, sig, "limit", 1).first().entry is None


def test_setup_verdicts_and_best_cells(spark):
    from panelspark.operators import validation as va
    rows = [("a", 1.0, 1.0, 70.0, 1), ("b", 1.0, 1.0, 70.0, 0), ("c", 1.0, 1.0, 60.0, 1), ("d", -1.0, 1.0, 90.0, 1)]
    table = spark.createDataFrame(rows, "cell string, h1_net double, h2_net double, win double, quarter_pass int")
    assert {r.cell: r.verdict for r in va.verdict(table).collect()} == {"a": "TRADE", "b": "MAYBE", "c": "DROP", "d": "DROP"}
    cells = spark.createDataFrame([("s", "a", 1.0, 10.0), ("s", "b", 1.0, 20.0), ("s", "c", 1.0, 30.0), ("s", "d", 0.0, 30.0)], "setup string, cell string, worse_net double, worse_win double")
    assert {r.cell for r in va.best_cells(cells).collect()} == {"b", "c"}
    assert abs(va.null_probability() - 2 * (5 / 120) ** 2) < 1e-12
