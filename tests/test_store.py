import datetime as dt
import tempfile

import pytest
from frames import bars, date, path, walk
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import actions as ac, calendar as cal, dims, quality as q, upsert as up
from panelspark.schema import coerce, struct
from panelspark.sources import bars as io, sinks, vendor


def rows(df):
    return [tuple(r) for r in df.collect()]


BLOCK = "isin string, date date, close double, adj_close double"


def test_column_merge_keeps_what_the_new_block_lacks(spark):
    old = spark.createDataFrame([("A", date("2024-08-01"), 10.0, None), ("B", date("2024-08-01"), 5.0, 5.0)], BLOCK)
    new = spark.createDataFrame([("A", date("2024-08-01"), None, 9.0), ("C", date("2024-08-01"), 1.0, None)], BLOCK)
    got = {r.isin: (r.close, r.adj_close, r.change) for r in up.upsert_columns(old, new, ["isin", "date"]).collect()}
    assert got == {"A": (10.0, 9.0, "updated"), "B": (5.0, 5.0, "kept"), "C": (1.0, None, "inserted")}
    merged = up.upsert_columns(old, new, ["isin", "date"]).drop("change")
    again = {r.change for r in up.upsert_columns(merged, new, ["isin", "date"]).collect()}
    assert again == {"same", "kept"}


def test_round_trip_prunes_and_rewrites_only_touched_years(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/bars"
    data = bars(spark, walk(300, start="2020-06-01"))
    io.write_partitions(data, root)
    changed = data.filter(F.year("date") == 2021).withColumn("volume", F.lit(7).cast("bigint"))
    io.write_partitions(changed, root)
    back = io.read_bars(spark, root)
    assert back.count() == 300 and "year" not in back.columns
    assert back.filter("volume = 7").count() == changed.count()
    plan = io.read_bars(spark, root, "2021-02-01", "2021-03-01", columns=["isin", "date"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "adj_close" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_coercion(spark):
    df = spark.createDataFrame([("A", "2024-01-02", "x", 2.5, float("nan"))], "isin string, date string, adj_close string, volume double, turnover double")
    got = coerce(df, "bars").first()
    assert coerce(df, "bars").schema.names == struct("bars").names
    assert (got.date, got.adj_close, got.volume, got.turnover) == (dt.date(2024, 1, 2), None, 2, None)
    with pytest.raises(ValueError):
        coerce(df.withColumn("odd", F.lit(1)), "bars", strict=True)


def test_structural_gate(spark):
    good = bars(spark, walk(10))
    q.assert_valid(good)
    for bad in (good.withColumn("adj_low", F.col("adj_high") + 1), good.withColumn("adj_close", F.lit(0.0)), good.unionByName(good), good.withColumn("volume", F.lit(-1).cast("bigint"))):
        with pytest.raises(q.QualityError):
            q.assert_valid(bad)


def test_wrapped_volume_and_unusable_rows(spark):
    df = bars(spark, walk(3)).withColumn("volume", F.lit(-81_259_413).cast("bigint"))
    got = up.repair_wrapped(df).first()
    assert (got.volume, got.repaired) == (4_213_707_883, 1)
    good, bad = up.split_usable(df)
    assert good.count() == 0 and bad.count() == 3


def test_jump_contaminates_both_directions(spark):
    closes = [100.0] * 100 + [45.0] * 300
    df = bars(spark, path(closes))
    assert q.price_jumps(df).count() == 1
    marked = q.with_contamination(df).withColumn("r", F.row_number().over(__import__("pyspark.sql", fromlist=["W"]).Window.orderBy("date")))
    bad = sorted(r.r for r in marked.filter("contaminated").collect())
    assert bad == list(range(101 - 20, 101 + 250 + 1))
    day = df.orderBy("date").collect()[101].date
    explained = spark.createDataFrame([("A", day, 2.0)], "isin string, ex_date date, ratio double")
    assert q.with_contamination(df, explained).filter("contaminated").count() == 0


def test_factors_compound_strictly_after_the_date(spark):
    df = bars(spark, path([10.0] * 10))
    d = [r.date for r in df.orderBy("date").collect()]
    acts = spark.createDataFrame([("A", d[3], 2.0), ("A", d[7], 1.5), ("A", d[5], 0.0)], "isin string, ex_date date, ratio double")
    got = [r.adj_factor for r in ac.with_factor(df, acts).orderBy("date").collect()]
    assert got == [3.0] * 3 + [1.5] * 4 + [1.0] * 3
    raw = ac.derive_raw(df.withColumn("close", F.when(F.col("date") == F.lit(d[0]), 7.0)), acts).orderBy("date").collect()
    assert raw[0].close == 7.0 and raw[1].close == 30.0


def members(spark):
    return spark.createDataFrame([], "index_name string, isin string, symbol string, name string, from_date date, to_date date")


def snap(spark, *pairs):
    return spark.createDataFrame(list(pairs), "isin string, symbol string")


def test_snapshots_never_rewrite_the_past(spark):
    one = dims.apply_snapshot(members(spark), snap(spark, ("1", "a"), ("2", "b")), "IX", "2024-01-01").drop("change")
    same = dims.apply_snapshot(one, snap(spark, ("1", "a"), ("2", "b")), "IX", "2024-02-01")
    assert {r.change for r in same.collect()} == {"unchanged"}
    two = dims.apply_snapshot(one, snap(spark, ("1", "A!"), ("3", "c")), "IX", "2024-03-01")
    assert {r.isin: r.change for r in two.collect()} == {"1": "renamed", "2": "removed", "3": "added"}
    two = two.drop("change")
    on = lambda m, day: sorted(r.isin for r in dims.members_on(m, spark.sql(f"SELECT DATE'{day}' AS as_of")).collect())
    assert on(two, "2024-02-29") == ["1", "2"] and on(two, "2024-03-01") == ["1", "3"]
    back = dims.apply_snapshot(two, snap(spark, ("1", "A!"), ("2", "b"), ("3", "c")), "IX", "2024-04-01").drop("change")
    assert on(back, "2024-03-15") == ["1", "3"] and on(back, "2024-04-01") == ["1", "2", "3"]
    with pytest.raises(PySparkException, match="predates"):
        dims.apply_snapshot(back, snap(spark, ("1", "a")), "IX", "2024-01-15").collect()
    assert dims.membership_changes(back).count() == 5


def test_symbol_history_and_lookup(spark):
    seen = spark.createDataFrame([("1", "OLD", date("2020-01-01")), ("1", "OLD", date("2020-02-01")), ("1", "NEW", date("2020-03-01")), ("2", "OLD", date("2021-01-01"))],
                                 "isin string, symbol string, date date")
    hist = dims.symbol_history(seen)
    assert rows(dims.renames(hist)) == [("1", "OLD", "NEW", date("2020-03-01"))]
    probes = spark.createDataFrame([("1", date("2019-01-01")), ("1", date("2020-02-15")), ("1", date("2020-03-01")), ("9", date("2020-01-01"))], "isin string, date date")
    got = {(r.isin, str(r.date)): r.symbol for r in dims.symbol_on(probes, hist).collect()}
    assert list(got.values()).count("OLD") == 2 and got[("1", "2020-03-01")] == "NEW" and got[("9", "2020-01-01")] is None
    assert dims.reused_symbols(hist).count() == 2


def test_gaps(spark):
    span = spark.sql("SELECT DATE'2024-01-01' AS start, DATE'2024-01-14' AS end")
    have = spark.createDataFrame([(date("2024-01-02"),)], "date date")
    status = spark.createDataFrame([(date("2024-01-03"), "no_data"), (date("2024-01-04"), "error")], "date date, status string")
    holidays = spark.createDataFrame([(date("2024-01-01"),)], "date date")
    expected = cal.expected_sessions(span, holidays)
    assert cal.missing_dates(expected, have, status).count() == 7
    assert cal.missing_dates(expected, have, status, retry_errors=False).count() == 6


def test_windows(spark):
    span = spark.sql("SELECT DATE'2024-01-15' AS start, DATE'2024-03-10' AS end")
    assert [(str(r.from_date), str(r.to_date)) for r in cal.month_windows(span).orderBy("from_date").collect()] == [
        ("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]
    decades = cal.decade_windows(spark.sql("SELECT DATE'2000-01-01' AS start, DATE'2024-03-10' AS end")).orderBy("from_date").collect()
    assert [(str(r.from_date), str(r.to_date)) for r in decades] == [("2000-01-01", "2009-12-01"), ("2009-12-02", "2019-11-02"), ("2019-11-03", "2024-03-10")]
    long = cal.decade_windows(spark.sql("SELECT DATE'1500-01-01' AS start, DATE'2020-01-01' AS end")).orderBy("from_date").collect()
    assert str(long[-1].to_date) == "2020-01-01" and len(long) > 31


def test_exchange_file(spark):
    raw = spark.createDataFrame([
        ("2024-08-01", "INE1", " AAA", "EQ", "STK", "10", "5", "1"), ("01-08-2024", "INE1", "AAA", "EQ", "STK", "11", "6", "2"), ("2024-08-01", "INE2", "F", "EQ", "FUT", "1", "1", "3"),
        ("2024-08-01", "", "X", "EQ", "STK", "1", "1", "4"), ("2024-08-01", "INE3", "G", "GS", "STK", "1", "1", "5"), ("2024-08-01", "INE4", "Z", "BE", "STK", "0", "1", "6")],
        "TradDt string, ISIN string, TckrSymb string, SctySrs string, FinInstrmTp string, ClsPric string, TtlTradgVol string, line string")
    got = vendor.parse_exchange(raw).collect()
    assert [(r.isin, r.symbol, r.close, r.volume, r.adj_close) for r in got] == [("INE1", "AAA", 11.0, 6, None)]
    with pytest.raises(ValueError):
        vendor.parse_exchange(raw.drop("ISIN"))


def test_candles_drop_the_offset(spark):
    df = spark.createDataFrame([("A", '[["2024-08-01T09:16:00+05:30", 2, 3, 1, 2.5, 10, 0], ["2024-08-01T09:15:00+05:30", 1, 2, 1, 2, 5, 0]]')], "isin string, candles string")
    got = vendor.parse_candles(df).orderBy("ts").collect()
    assert [str(r.ts) for r in got] == ["2024-08-01 09:15:00", "2024-08-01 09:16:00"] and got[0].close == 2.0


def test_constituents(spark):
    raw = spark.createDataFrame([("X", " INE002A01018 ", "RIL"), ("Y", "DUMMY", "D")], "`Company Name` string, `ISIN Code` string, `Symbol` string")
    valid, excluded = vendor.parse_constituents(raw)
    assert rows(valid.select("isin", "symbol", "name")) == [("INE002A01018", "RIL", "X")] and excluded.count() == 1
    with pytest.raises(PySparkException, match="duplicate key"):
        vendor.parse_constituents(raw.unionByName(raw))[0].collect()


def test_series_documents_keep_holes(spark):
    df = bars(spark, walk(5, "A"), walk(3, "B", 2))
    got = {r.isin: r.c for r in sinks.series_documents(df, {"c": "adj_close"}).collect()}
    assert len(got["A"]) == len(got["B"]) == 5 and got["B"][3:] == [None, None]


def test_hour_bars_start_at_a_quarter_past(spark):
    df = spark.sql("SELECT 'A' AS isin, ts, 1D AS open, 2D AS high, 0D AS low, CAST(minute(ts) AS DOUBLE) AS close, 1L AS volume FROM (SELECT explode(sequence(TIMESTAMP_NTZ'2024-01-01 09:15:00', TIMESTAMP_NTZ'2024-01-01 11:14:00', INTERVAL 1 MINUTE)) AS ts)")
    got = io.hour_bars(df).orderBy("hour").collect()
    assert [(str(r.hour), r.volume, r.close) for r in got] == [("2024-01-01 09:15:00", 60, 14.0), ("2024-01-01 10:15:00", 60, 14.0)]


def test_a_crash_while_years_are_replaced_loses_nothing(spark, tmp_path, monkeypatch):
    """The replayed batch finds its rows beside the table and does not read what the crash left."""
    from panelspark.streaming import ingest
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    columns = ["isin", "date", "close"]

    def run(name):
        stream = spark.readStream.schema("isin string, date date, close double, seq int").parquet(f"{source}/{name}")
        ingest.stream_merge(stream, path, str(tmp_path / f"state-{name}"), ["isin", "date"], F.col("seq"), columns).awaitTermination()

    def put(name, rows):
        spark.createDataFrame(rows, "isin string, date string, close double, seq int").withColumn("date", F.to_date("date")).write.parquet(f"{source}/{name}")

    def table():
        return sorted((r.isin, str(r.date), r.close) for r in spark.read.parquet(path).select(*columns).collect())

    put("one", [("A", "2023-05-01", 1.0, 1), ("B", "2023-06-01", 2.0, 1), ("A", "2024-01-02", 3.0, 1)])
    run("one")
    put("two", [("A", "2023-05-01", 9.0, 1), ("C", "2024-02-01", 4.0, 1)])
    real = ingest.write_partitions

    def broken(df, to, *more):
        for year in ("2023", "2024"):  # the stored years are gone, the new ones not there yet
            files, folder = ingest._folder(spark, f"{to}/year={year}")
            files.delete(folder, True)
        raise RuntimeError("power cut")

    monkeypatch.setattr(ingest, "write_partitions", broken)
    with pytest.raises(Exception):
        run("two")
    monkeypatch.setattr(ingest, "write_partitions", real)
    run("two")
    want = [("A", "2023-05-01", 9.0), ("A", "2024-01-02", 3.0), ("B", "2023-06-01", 2.0), ("C", "2024-02-01", 4.0)]
    assert table() == want
    run("two")  # nothing new
    assert table() == want
    files, beside = ingest._folder(spark, f"{path}/_beside")
    assert not files.exists(beside) or not list(files.listStatus(beside))


def test_bars_inside_the_delay_take_their_place():
    """Shuffled batches give the rows of one batch in order; a bar later than the delay is reported."""
    import random

    import pandas as pd

    from panelspark.streaming.positions import Positions

    class Held(list):
        def exists(self):
            return bool(self)
        def get(self):
            return iter(list(self)) if self.many else self[0]
        def put(self, rows):
            self[:] = rows
        def clear(self):
            self[:] = []
        def update(self, value):
            self[:] = [value]

    def follow(batches, delay):
        one = Positions(1.0, 20, delay=delay)
        one.state, one.waiting = Held(), Held()
        one.state.many, one.waiting.many = False, True
        out = [f for b in batches for f in one.handleInputRows(("A",), iter([b]), None)]
        return [(str(r.entry_date), str(r.exit_date), r.exit, r.bars, r.why) for f in out for r in f.itertuples()]

    r = random.Random(3)
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=k), 10 + r.random(), 10 + r.random(), 10.4, 5.0, int(r.random() < 0.3)) for k in range(120)]
    rows.append((start + dt.timedelta(days=400), 10.0, 10.0, None, None, None))
    frame = pd.DataFrame(rows, columns=["date", "adj_open", "adj_close", "hi7_prior", "atr_pct", "signal"])
    whole = follow([frame], 30)
    assert len(whole) > 3 and all(w[-1] != "late" for w in whole)
    order = list(range(120))
    for i in range(0, 120, 20):  # shuffled inside 20 days
        part = order[i:i + 20]
        r.shuffle(part)
        order[i:i + 20] = part
    shuffled = [frame.iloc[order[i:i + 17]] for i in range(0, 120, 17)] + [frame.iloc[120:]]
    assert follow(shuffled, 30) == whole
    assert [w for w in follow([frame.iloc[20:], frame.iloc[:1]], 30) if w[-1] == "late"] == [("2024-01-01", "2024-01-01", None, 0, "late")]
