"""Source, maintenance, join, quality and scalar queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions import core
from ..functions.windows import PANEL as S
from ..operators import actions, calendar, dims, quality, universe, upsert
from ..operators.features import build_features
from ..schema import coerce
from ..session import checkpoint_dir
from ..sources import bars as bar_io, panels, sinks, vendor
from .base import BARS, DAYS, MINUTES, W, register, roll
from .cross import CAL, IX, MEMBER, index_bars
from .windows import CLOSE_POS, KEY, LEVELS, SMA, lag, pct_sql


def week(s, d):
    return panels.week_panel(s, d)


def stored(s, d):
    return panels.stored_week_panel(s, d)


def shared_path(spark) -> str:
    """A fresh folder for a round trip through files: under the cluster's shared folder when one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/panelspark-{spark.sparkContext.applicationId}-{next(_COUNTER)}"
    checkpoint_dir(spark)
    return tempfile.mkdtemp(prefix="spark-")


_COUNTER = iter(range(10**9))

# ------------------------------------------------------------------ sources and sinks
OHLCV = "adj_open:f4 adj_high:f4 adj_low:f4 adj_close:f4 volume:i"


def _round_trip(s, d):
    path = shared_path(s) + "/bars"
    bar_io.write_partitions(week(s, d), path, "bars")
    return bar_io.read_bars(s, path, "1996-03-01", "1998-06-30", columns=["isin", "date", "adj_open", "adj_high", "adj_low", "adj_close", "volume"])


register("S1_read_bars", KEY + OHLCV, _round_trip, f"WITH {BARS} @@ SELECT * FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'")


def _minutes_trip(s, d):
    path = shared_path(s) + "/minutes"
    bar_io.write_partitions(panels.minute_panel(s, d), path, "minutes")
    return bar_io.read_minutes(s, path, "2024-01-05 00:00:00", "2024-01-20 12:00:00").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


register("S2_read_minutes", "isin:s stamp:s close:f4", _minutes_trip,
         f"WITH {MINUTES} @@ SELECT isin, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, close FROM minutes WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")
register("S3_sql_over_views", "isin:s n:i top:f4",
         lambda s, d: bar_io.query(s, "SELECT isin, count(*) AS n, max(adj_high) AS top FROM bars WHERE volume >= :least GROUP BY isin", week(s, d), least=100),
         f"WITH {BARS} @@ SELECT isin, count(*) AS n, max(adj_high) AS top FROM bars WHERE volume >= 100 GROUP BY 1")


def _exchange(s, d):
    """Line items written out as exchange text rows, with noise rows and both date formats, then parsed."""
    li = panels.table(s, d, "lineitem")
    day = F.when(F.col("l_orderkey") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "dd-MM-yyyy"))
    raw = li.select(
        day.alias("TradDt"), F.format_string(" INE%09d ", "l_partkey").alias("ISIN"), F.concat(F.lit("P"), F.col("l_partkey")).alias("TckrSymb"),
        F.when(F.col("l_linenumber") == 1, "EQ").when(F.col("l_linenumber") == 2, "BE").when(F.col("l_linenumber") == 3, "GS").otherwise("bz ").alias("SctySrs"),
        F.when(F.col("l_returnflag") == "R", "FUT").otherwise("STK").alias("FinInstrmTp"),
        *[F.col("l_extendedprice").cast("string").alias(c) for c in ("OpnPric", "HghPric", "LwPric")],
        F.when(F.col("l_discount") > 0.09, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("ClsPric"),
        F.col("l_quantity").cast("string").alias("TtlTradgVol"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey") % 100000).alias("line"))
    return vendor.parse_exchange(raw)


_EX_WHERE = "l_returnflag <> 'R' AND l_linenumber <> 3 AND NOT l_discount > 0.09"
register("S4_exchange_file", KEY + "rows:i least:f2 most:f2",
         lambda s, d: _exchange(s, d).groupBy("isin", "date").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("adj_close").isNull().cast("int") * 1.0).alias("least"),
                                                                    F.max(F.col("close").isNotNull().cast("int") * 1.0).alias("most")),
         f"SELECT 'INE' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS isin, CAST(l_shipdate AS DATE) AS date, 1 AS rows, 1.0 AS least, 1.0 AS most FROM lineitem WHERE {_EX_WHERE} GROUP BY 1, 2")


def _candles(s, d):
    events = panels.table(s, d, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    cell = F.array(stamp, *[F.col("value").cast("string")] * 4, F.lit("1"), F.lit("0"))
    packed = events.groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("isin"), F.to_date("ts").alias("day")).agg(F.to_json(F.collect_list(cell)).alias("candles"))
    return vendor.parse_candles(packed).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


register("S5_candle_arrays", "isin:s stamp:s open:f4 close:f4 volume:i", _candles,
         "SELECT 'U' || CAST(user_id AS VARCHAR) AS isin, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp, value AS open, value AS close, 1 AS volume FROM events")


def _listing(s, d):
    part = panels.table(s, d, "part")
    code = F.when(F.col("p_partkey") % 7 == 0, F.lit("DUMMY")).otherwise(F.format_string(" INE%09d", "p_partkey"))
    return part.select(F.lit("x").alias(" Company Name"), F.col("p_name").alias("Symbol "), code.alias("ISIN Code"), F.lit("EQ").alias("Series"), F.lit("a").alias("Industry"))


register("S6_constituents", "isin:s symbol:s", lambda s, d: vendor.parse_constituents(_listing(s, d))[0],
         "SELECT 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS isin, trim(p_name) AS symbol FROM part WHERE p_partkey % 7 <> 0")
register("S7_instruments", "isin:s symbol:s",
         lambda s, d: vendor.filter_instruments(panels.table(s, d, "part").select(
             F.concat(F.lit("NSE_EQ|"), F.format_string("INE%04d", F.col("p_partkey") % 10000), F.lpad((F.col("p_size") % 9).cast("string"), 2, "0"), F.lit("017")).alias("instrument_key"),
             F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("9"), F.col("p_partkey"))).otherwise(F.concat(F.lit("P"), F.col("p_partkey"))).alias("symbol"))),
         "SELECT 'INE' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || lpad(CAST(p_size % 9 AS VARCHAR), 2, '0') || '017' AS isin, 'P' || p_partkey AS symbol FROM part WHERE p_partkey % 5 <> 0 AND p_size % 9 BETWEEN 1 AND 6")


def _rewrite(s, d):
    """Write everything, then rewrite one year with changed volumes: other years must stay."""
    path = shared_path(s) + "/bars"
    bars = week(s, d)
    bar_io.write_partitions(bars, path)
    bar_io.write_partitions(bars.filter(F.year("date") == 1997).withColumn("volume", F.col("volume") + 1), path)
    return bar_io.read_bars(s, path)


register("S8_partition_rewrite", KEY + "volume:i", _rewrite, f"WITH {BARS} @@ SELECT isin, date, volume + CASE WHEN year(date) = 1997 THEN 1 ELSE 0 END AS volume FROM bars")


def _table_trip(s, d):
    path = shared_path(s) + "/features"
    sinks.write_table(build_features(week(s, d), ["sma_20", "vol_ratio"]), path)
    return s.read.parquet(path)


register("S9_table_write", KEY + "sma_20:f4 vol_ratio:f4", _table_trip, f"WITH {BARS} @@ SELECT isin, date, {SMA[20]} AS sma_20, volume / ({roll('avg', 'volume', 20, 10)}) AS vol_ratio FROM bars")


def _json_trip(s, d):
    path = shared_path(s) + "/doc"
    df = build_features(week(s, d), ["new_lo7"]).groupBy(F.col("isin").alias("rule"), F.year("date").cast("string").alias("horizon")).agg(F.count_if(F.col("new_lo7") == 1).alias("n"))
    hist = df.select("rule", F.col("horizon").cast("int").alias("bin"), "n")
    sinks.write_json(sinks.result_documents(df, hist), path)
    back = s.read.json(path)
    return back.select("rule", F.explode("hist").alias("h")).select("rule", F.col("h.bin").alias("bin"), F.col("h.n").alias("n"))


register("S10_json_documents", "rule:s bin:i n:i", _json_trip,
         f"WITH {BARS}, t AS (SELECT *, adj_close < {roll('min', 'adj_close', 7, None, True)} AS f FROM bars) @@ SELECT isin AS rule, year(date) AS bin, count(*) FILTER (f) AS n FROM t GROUP BY 1, 2")
register("S11_series_grid", "isin:s days:i holes:i first_close:f4 last_close:f4",
         lambda s, d: sinks.series_documents(panels.day_panel(s, d), {"c": "adj_close", "v": "volume"}).select(
             "isin", F.size("c").alias("days"), F.size(F.filter("c", lambda x: x.isNull())).alias("holes"),
             F.filter("c", lambda x: x.isNotNull())[0].alias("first_close"), F.element_at(F.filter("c", lambda x: x.isNotNull()), -1).alias("last_close")),
         f"WITH {DAYS} @@ SELECT isin, (SELECT count(DISTINCT date) FROM days) AS days, (SELECT count(DISTINCT date) FROM days) - count(*) AS holes, arg_min(adj_close, date) AS first_close, arg_max(adj_close, date) AS last_close FROM days GROUP BY 1")
register("S12_shards", "isin:s shard:i", lambda s, d: week(s, d).select("isin").distinct().withColumn("shard", sinks.shard_number(F.col("isin"))),
         f"WITH {BARS}, n AS (SELECT DISTINCT isin FROM bars) @@ SELECT isin, list_sum(list_transform(string_split(isin, ''), lambda x: ascii(x))) % 15 AS shard FROM n")


def _csv_trip(s, d):
    path = shared_path(s) + "/csv"
    sinks.write_csv(week(s, d).select("isin", "date", "volume", "turnover"), path)
    back = vendor.read_text_csv(s, path)
    return back.select("isin", F.to_date("date").alias("date"), F.col("volume").cast("bigint").alias("volume"), F.col("turnover").cast("double").alias("turnover"))


register("S13_csv", KEY + "volume:i turnover:f2", _csv_trip, f"WITH {BARS} @@ SELECT * FROM bars")
register("S14_level_segments", "isin:s month:d start_i:i end_i:i m_p:f4",
         lambda s, d: sinks.level_segments(build_features(week(s, d), ["m_p", "m_r1"]), ["m_p", "m_r1"]),
         LEVELS + ", g AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), "
         "sg AS (SELECT isin, CAST(date_trunc('month', date) AS DATE) AS month, min(i) AS start_i, max(i) AS end_i, arg_min(m_p, date) AS m_p FROM lv JOIN g USING (date) WHERE m_p IS NOT NULL GROUP BY 1, 2) "
         "@@ SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY isin ORDER BY month DESC) <= 3")

# ------------------------------------------------------------------ maintenance


def _halves(s, d):
    """Stored bars hold even months with raw gaps; the new block overlaps them and adds odd months."""
    bars = stored(s, d).select("isin", "date", "adj_close", F.col("volume"))
    kept = bars.filter(F.month("date") % 3 > 0).withColumn("adj_close", F.when(F.dayofmonth("date") % 2 == 0, F.col("adj_close")))
    new = bars.filter(F.month("date") % 3 < 2).withColumns({
        "adj_close": F.when(F.dayofmonth("date") % 5 > 0, F.col("adj_close") + 1), "volume": F.when(F.dayofmonth("date") % 3 > 0, F.col("volume") * 2)})
    return kept, new


_HALF = (f"WITH {BARS}, st AS (SELECT isin, date, CASE WHEN day(date) % 2 = 0 THEN adj_close END AS adj_close, volume FROM bars WHERE month(date) % 3 > 0), "
         "nw AS (SELECT isin, date, CASE WHEN day(date) % 5 > 0 THEN adj_close + 1 END AS adj_close, CASE WHEN day(date) % 3 > 0 THEN volume * 2 END AS volume FROM bars WHERE month(date) % 3 < 2)")
register("M1_column_upsert", KEY + "adj_close:f4 volume:n change:s", lambda s, d: upsert.upsert_columns(*_halves(s, d), ["isin", "date"]),
         _HALF + " @@ SELECT isin, date, coalesce(n.adj_close, s.adj_close) AS adj_close, coalesce(n.volume, s.volume) AS volume, CASE WHEN s.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' "
         "WHEN (n.adj_close IS NOT NULL AND n.adj_close IS DISTINCT FROM s.adj_close) OR (n.volume IS NOT NULL AND n.volume IS DISTINCT FROM s.volume) THEN 'updated' ELSE 'same' END AS change "
         "FROM (SELECT *, 1 AS k FROM st) s FULL JOIN (SELECT *, 1 AS k FROM nw) n USING (isin, date)")
register("M1_change_counts", "change:s rows:i", lambda s, d: upsert.change_counts(upsert.upsert_columns(*_halves(s, d), ["isin", "date"])),
         _HALF + " @@ SELECT CASE WHEN s.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' "
         "WHEN (n.adj_close IS NOT NULL AND n.adj_close IS DISTINCT FROM s.adj_close) OR (n.volume IS NOT NULL AND n.volume IS DISTINCT FROM s.volume) THEN 'updated' ELSE 'same' END AS change, count(*) AS rows "
         "FROM (SELECT *, 1 AS k FROM st) s FULL JOIN (SELECT *, 1 AS k FROM nw) n USING (isin, date) GROUP BY 1")
register("M2_keep_last", "isin:s day:d event_id:i value:f4",
         lambda s, d: upsert.keep_last(panels.table(s, d, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("isin"), F.to_date("ts").alias("day"), "event_id", "value"), ["isin", "day"], F.col("event_id")),
         "SELECT 'U' || CAST(user_id AS VARCHAR) AS isin, CAST(ts AS DATE) AS day, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")


def _factor_table(s, d):
    table = panels.actions(s, d)
    new = table.filter(F.year("ex_date") > 1996).withColumn("ratio", F.lit(3.0))
    return upsert.replace_or_upsert(table, new, ["isin", "ex_date", "action"], False)


ACTIONS = ("ac AS (SELECT isin, min(date) AS ex_date, 2.0 AS ratio FROM bars JOIN nation ON n_name = isin WHERE n_nationkey % 4 = 0 AND year(date) % 4 = 0 GROUP BY isin, year(date))")
register("M3_factor_upsert", "isin:s ex_date:d ratio:f2", _factor_table,
         f"WITH {BARS}, {ACTIONS} @@ SELECT isin, ex_date, CASE WHEN year(ex_date) > 1996 THEN 3.0 ELSE ratio END AS ratio FROM ac")


def _log(s, d):
    o = panels.table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "no_data").otherwise("error")
    return o.select(F.to_date("o_orderdate").alias("date"), F.lit("bhavcopy_udiff").alias("source"), status.alias("status"), F.col("o_orderkey").alias("run_at"))


LOG = "lg AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'no_data' ELSE 'error' END AS status, o_orderkey AS run_at FROM orders), ls AS (SELECT date, arg_max(status, run_at) AS status, max(run_at) AS run_at FROM lg GROUP BY 1)"
register("M4_latest_status", "date:d status:s run_at:i", lambda s, d: upsert.latest_status(_log(s, d)), f"WITH {LOG} @@ SELECT * FROM ls")


def _sightings(s, d):
    """Orders as sightings: a customer's symbol changes with the order priority of the day."""
    o = panels.table(s, d, "orders")
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("isin"), F.to_date("o_orderdate").alias("date")).agg(
        F.max(F.substring("o_orderpriority", 1, 1)).alias("symbol"), F.max("o_orderstatus").alias("name"), F.lit("EQ").alias("series"))


SIGHT = "sg AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS isin, CAST(o_orderdate AS DATE) AS date, max(left(o_orderpriority, 1)) AS symbol, max(o_orderstatus) AS name FROM orders GROUP BY 1, 2)"
HIST = (SIGHT + ", sl AS (SELECT *, lag(symbol) OVER (PARTITION BY isin ORDER BY date) AS p FROM sg), sh AS (SELECT isin, symbol, date AS from_date, lead(date) OVER (PARTITION BY isin ORDER BY date) AS to_date FROM sl WHERE p IS NULL OR p <> symbol)")
register("M5_symbol_master", "isin:s symbol:s name:s first_seen:d last_seen:d", lambda s, d: dims.symbol_master(_sightings(s, d)),
         f"WITH {SIGHT} @@ SELECT isin, arg_max(symbol, date) AS symbol, arg_max(name, date) AS name, min(date) AS first_seen, max(date) AS last_seen FROM sg GROUP BY 1")
register("M5_symbol_history", "isin:s symbol:s from_date:d to_date:d", lambda s, d: dims.symbol_history(_sightings(s, d)), f"WITH {HIST} @@ SELECT * FROM sh")
register("M5_renames", "isin:s old_symbol:s new_symbol:s date:d", lambda s, d: dims.renames(dims.symbol_history(_sightings(s, d))),
         f"WITH {HIST} @@ SELECT isin, lag(symbol) OVER (PARTITION BY isin ORDER BY from_date) AS old_symbol, symbol AS new_symbol, from_date AS date FROM sh QUALIFY old_symbol IS NOT NULL")


def _snapshot(s, d):
    """A later list for one region: some nations missing, one renamed, one from elsewhere added."""
    m = panels.membership(s, d)
    nation = panels.table(s, d, "nation")
    snap = nation.filter(((F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 4 != 2)) | (F.col("n_nationkey") == 1)).select(
        F.col("n_name").alias("isin"), F.when(F.col("n_nationkey") % 5 == 2, F.concat(F.col("n_name"), F.lit("X"))).otherwise(F.col("n_name")).alias("symbol"))
    return dims.apply_snapshot(m, snap, "ASIA", "2010-01-04")


register("M6_snapshot", "index_name:s isin:s symbol:s from_date:d to_date:d change:s", _snapshot,
         f"WITH {BARS}, {MEMBER}, sn AS (SELECT n_name AS isin, CASE WHEN n_nationkey % 5 = 2 THEN n_name || 'X' ELSE n_name END AS symbol FROM nation WHERE (n_regionkey = 2 AND n_nationkey % 4 <> 2) OR n_nationkey = 1) "
         "@@ SELECT index_name, isin, symbol, from_date, to_date, NULL AS change FROM mem WHERE index_name <> 'ASIA' OR to_date IS NOT NULL UNION ALL "
         "SELECT 'ASIA', coalesce(m.isin, n.isin), CASE WHEN n.isin IS NULL THEN m.symbol ELSE n.symbol END, CASE WHEN m.isin IS NULL THEN DATE '2010-01-04' ELSE m.from_date END, CASE WHEN n.isin IS NULL THEN DATE '2010-01-04' END, "
         "CASE WHEN m.isin IS NULL THEN 'added' WHEN n.isin IS NULL THEN 'removed' WHEN m.symbol <> n.symbol THEN 'renamed' ELSE 'unchanged' END "
         "FROM (SELECT * FROM mem WHERE index_name = 'ASIA' AND to_date IS NULL) m FULL JOIN sn n ON n.isin = m.isin")
register("M7_membership_changes", "index_name:s date:d event:s isin:s", lambda s, d: dims.membership_changes(panels.membership(s, d)),
         f"WITH {BARS}, {MEMBER} @@ SELECT index_name, from_date AS date, 'join' AS event, isin FROM mem UNION ALL SELECT index_name, to_date, 'leave', isin FROM mem WHERE to_date IS NOT NULL")


def _damaged(s, d):
    """Day bars with some damaged rows."""
    bars = panels.day_panel(s, d)
    key = F.dayofmonth("date") + F.col("volume")
    return bars.withColumns({"adj_low": F.when(key % 17 == 0, F.col("adj_high") + 1).otherwise(F.col("adj_low")),
                             "adj_close": F.when(key % 19 == 0, F.lit(0.0)).when(key % 23 == 0, F.lit(None)).otherwise(F.col("adj_close")),
                             "volume": F.when(key % 29 == 0, -F.col("volume")).otherwise(F.col("volume"))})


DAMAGED = ("dm AS (SELECT isin, date, adj_open, adj_high, trades, turnover, CASE WHEN (day(date) + volume) % 17 = 0 THEN adj_high + 1 ELSE adj_low END AS adj_low, "
           "CASE WHEN (day(date) + volume) % 19 = 0 THEN 0.0 WHEN (day(date) + volume) % 23 = 0 THEN NULL ELSE adj_close END AS adj_close, CASE WHEN (day(date) + volume) % 29 = 0 THEN -volume ELSE volume END AS volume FROM days)")
GOOD = "coalesce(adj_open > 0 AND adj_high > 0 AND adj_low > 0 AND adj_close > 0 AND volume >= 0 AND adj_high >= greatest(adj_open, adj_close) AND adj_low <= least(adj_open, adj_close), false)"
register("M8_quarantine", KEY + "reason:s volume:i", lambda s, d: upsert.quarantine(upsert.split_usable(_damaged(s, d))[1], "unusable prices", "vendor"),
         f"WITH {DAYS}, {DAMAGED} @@ SELECT isin, date, 'unusable prices' AS reason, volume FROM dm WHERE NOT {GOOD} OR adj_close IS NULL")
register("M9_wrap_repair", KEY + "volume:i repaired:i", lambda s, d: upsert.repair_wrapped(_damaged(s, d)),
         f"WITH {DAYS}, {DAMAGED} @@ SELECT isin, date, CASE WHEN volume < 0 THEN volume + 4294967296 ELSE volume END AS volume, CASE WHEN volume < 0 THEN 1 ELSE 0 END AS repaired FROM dm")
register("M10_usable_split", KEY + "adj_close:f4", lambda s, d: upsert.split_usable(_damaged(s, d))[0], f"WITH {DAYS}, {DAMAGED} @@ SELECT isin, date, adj_close FROM dm WHERE adj_close IS NOT NULL AND {GOOD}")
register("M11_unproven_block", KEY + "adj_close:f4",
         lambda s, d: upsert.drop_unproven(week(s, d).withColumn("adj_source", F.when(F.month("date") > 6, "vendor"))),
         f"WITH {BARS} @@ SELECT isin, date, CASE WHEN month(date) > 6 THEN adj_close END AS adj_close FROM bars")
register("M12_coercion", KEY + "adj_close:f4 volume:n trades:n",
         lambda s, d: coerce(week(s, d).withColumns({"date": F.col("date").cast("string"), "adj_close": F.when(F.dayofmonth("date") == 4, "x").otherwise(F.col("adj_close").cast("string")),
                                                     "volume": F.col("volume") / 2, "trades": F.when(F.dayofmonth("date") == 5, F.lit(float("nan"))).otherwise(F.col("trades").cast("double"))}), "bars"),
         f"WITH {BARS} @@ SELECT isin, date, CASE WHEN day(date) <> 4 THEN adj_close END AS adj_close, round_even(volume / 2.0, 0) AS volume, CASE WHEN day(date) <> 5 THEN trades END AS trades FROM bars")
register("M13_lookup_chain", "isin:s name:s",
         lambda s, d: upsert.lookup_chain(week(s, d).select("isin").distinct(), "isin", "name", [
             (panels.table(s, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("isin"), F.concat(F.lit("A-"), F.col("n_name")).alias("n")), "n"),
             (panels.region_map(s, d), "index_name")]),
         "SELECT n_name AS isin, CASE WHEN n_nationkey % 2 = 0 THEN 'A-' || n_name ELSE r_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)")

# ------------------------------------------------------------------ scalars
register("P6_bands", KEY + "cap_band:s", lambda s, d: week(s, d).withColumn("cap_band", core.cap_band(F.col("adj_close") * 10)),
         f"WITH {BARS} @@ SELECT isin, date, CASE WHEN adj_close * 10 >= 100000 THEN 'Mega' WHEN adj_close * 10 >= 20000 THEN 'Large' WHEN adj_close * 10 >= 0 THEN 'Mid' END AS cap_band FROM bars")
register("P7_half_even", KEY + "half:f1", lambda s, d: week(s, d).withColumn("half", F.bround(F.col("volume") / 2, 0)), f"WITH {BARS} @@ SELECT isin, date, round_even(volume / 2.0, 0) AS half FROM bars")
register("P9_row_extremes", KEY + "top:f4 bottom:f4",
         lambda s, d: build_features(week(s, d), ["sma_20", "sma_50"]).select("isin", "date", F.greatest("sma_20", "sma_50", "adj_close").alias("top"), F.least("sma_20", "sma_50", "adj_close").alias("bottom")),
         f"WITH {BARS}, t AS (SELECT *, {SMA[20]} AS a, {SMA[50]} AS b FROM bars) @@ SELECT isin, date, greatest(a, b, adj_close) AS top, least(a, b, adj_close) AS bottom FROM t")
register("P11_position_size", KEY + "money:f4 lots:i",
         lambda s, d: week(s, d).select("isin", "date", core.position_size(F.lit(1e6), F.lit(1.0), F.abs(F.col("adj_close") - F.col("adj_low")) / 100).alias("money"), core.lot_count(F.col("adj_close")).alias("lots")),
         f"WITH {BARS} @@ SELECT isin, date, CASE WHEN abs(adj_close - adj_low) > 0 THEN 1e6 * (1.0 / (abs(adj_close - adj_low) / 100)) ELSE 0 END AS money, floor(100000 / adj_close) AS lots FROM bars")
register("P12_strings", "isin:s head:s code:s valid:i",
         lambda s, d: panels.table(s, d, "part").select(F.format_string("INE%09d", "p_partkey").alias("isin"), F.split(F.lower(F.trim(F.regexp_replace("p_name", "\\s+", " "))), " ")[0].alias("head"),
                                                        F.substring(F.format_string("INE%09d", "p_partkey"), 8, 2).alias("code"), F.format_string("INE%09d", "p_partkey").rlike(vendor.KEY_PATTERN).cast("int").alias("valid")),
         "SELECT 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS isin, string_split(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), ' ')[1] AS head, substring('INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 8, 2) AS code, 1 AS valid FROM part")


def _fundamentals(s, d):
    return panels.table(s, d, "supplier").select(F.format_string("S%06d", "s_suppkey").alias("isin"), F.when(F.col("s_suppkey") % 3 > 0, F.abs("s_acctbal") * 1e5).alias("shares"), (F.abs("s_acctbal") * 1e8).alias("vendor_mcap"))


FUND = "fd AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS isin, CASE WHEN s_suppkey % 3 > 0 THEN abs(s_acctbal) * 1e5 END AS shares, abs(s_acctbal) * 1e8 AS vendor FROM supplier)"
_SIZE = f"WITH {DAYS}, {FUND}, z AS (SELECT isin, date, shares * adj_close / 1e7 AS own, vendor / 1e7 AS ven FROM days LEFT JOIN fd USING (isin)) "
register("P13_size_disagreement", KEY + "size_disagrees:i", lambda s, d: universe.with_size(panels.day_panel(s, d), _fundamentals(s, d)),
         _SIZE + "@@ SELECT isin, date, CASE WHEN greatest(own / nullif(ven, 0), ven / nullif(own, 0)) > 3 THEN 1 ELSE 0 END AS size_disagrees FROM z")
register("P14_universe_floor", "isin:s", lambda s, d: universe.above_floor(_fundamentals(s, d), 40_000.0), f"WITH {FUND} @@ SELECT isin FROM fd WHERE vendor / 1e7 >= 40000")
register("P15_own_size", KEY + "mcap_cr:f3 cap_band:s", lambda s, d: universe.with_size(panels.day_panel(s, d), _fundamentals(s, d), 50_000.0),
         _SIZE + "@@ SELECT isin, date, coalesce(own, ven) AS mcap_cr, CASE WHEN coalesce(own, ven) >= 100000 THEN 'Mega' ELSE 'Large' END AS cap_band FROM z WHERE coalesce(own, ven) >= 50000")


def _listing_flag(s, d):
    from ..plans.screen import listing_columns
    return listing_columns(panels.day_panel(s, d).filter(F.col("volume") > 45))


register("P16_new_listing", KEY + "new_listing:i", _listing_flag, f"WITH {DAYS}, f AS (SELECT * FROM days WHERE volume > 45) @@ SELECT isin, date, CASE WHEN count(*) OVER (PARTITION BY isin) < 60 THEN 1 ELSE 0 END AS new_listing FROM f")

# ------------------------------------------------------------------ joins
register("J1_panel_join", KEY + "sma_20:f4 tenth:f4",
         lambda s, d: build_features(week(s, d), ["sma_20"]).select("isin", "date", "sma_20").join(week(s, d).filter(F.month("date") == 5).select("isin", "date", (F.col("adj_close") / 10).alias("tenth")), ["isin", "date"], "left"),
         f"WITH {BARS} @@ SELECT isin, date, {SMA[20]} AS sma_20, CASE WHEN month(date) = 5 THEN adj_close / 10 END AS tenth FROM bars")
register("J3_point_in_time", KEY + "index_name:s adj_close:f4", lambda s, d: (lambda b: dims.point_in_time(b, panels.membership(s, d, b)))(stored(s, d)),
         f"WITH {BARS}, {MEMBER} @@ SELECT bars.isin, date, index_name, adj_close FROM bars JOIN mem ON mem.isin = bars.isin AND from_date <= date AND (to_date IS NULL OR to_date > date)")


def _probes(s, d):
    return panels.table(s, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey")).alias("isin"), F.date_sub(F.to_date("o_orderdate"), 100).alias("date")).distinct()


PROBE = "pr AS (SELECT DISTINCT 'C' || CAST(o_custkey AS VARCHAR) AS isin, CAST(o_orderdate AS DATE) - 100 AS date FROM orders)"
register("J3b_symbol_on", KEY + "symbol:s", lambda s, d: dims.symbol_on(_probes(s, d), dims.symbol_history(_sightings(s, d))),
         f"WITH {HIST}, {PROBE}, e AS (SELECT isin, arg_min(symbol, from_date) AS first_symbol FROM sh GROUP BY 1) "
         "@@ SELECT pr.isin, pr.date, coalesce(sh.symbol, e.first_symbol) AS symbol FROM pr JOIN e ON e.isin = pr.isin LEFT JOIN sh ON sh.isin = pr.isin AND from_date <= pr.date AND (to_date IS NULL OR to_date > pr.date)")
register("J3b_isins_for_symbol", "symbol:s date:d n:i first_isin:s",
         lambda s, d: dims.isins_for_symbol(s.sql("SELECT symbol, DATE(day) AS date FROM VALUES ('1'), ('2'), ('5') AS a(symbol), VALUES ('1996-01-01'), ('1998-07-01') AS b(day)"), dims.symbol_history(_sightings(s, d)))
         .groupBy("symbol", "date").agg(F.count("isin").alias("n"), F.min("isin").alias("first_isin")),
         f"WITH {HIST}, q AS (SELECT * FROM (VALUES ('1'), ('2'), ('5')) a(symbol), (VALUES (DATE '1996-01-01'), (DATE '1998-07-01')) b(date)) "
         "@@ SELECT q.symbol, q.date, count(DISTINCT isin) AS n, min(isin) AS first_isin FROM q LEFT JOIN sh ON sh.symbol = q.symbol AND from_date <= q.date AND (to_date IS NULL OR to_date > q.date) GROUP BY 1, 2")
FACTOR = f"{ACTIONS}, fa AS (SELECT bars.*, coalesce((SELECT product(ratio) FROM ac WHERE ac.isin = bars.isin AND ex_date > bars.date), 1.0) AS adj_factor FROM bars)"
register("J4_suffix_factor", KEY + "adj_factor:f4", lambda s, d: (lambda b: actions.with_factor(b, panels.actions(s, d, b)))(stored(s, d)), f"WITH {BARS}, {FACTOR} @@ SELECT * FROM fa")


def _gaps(s, d):
    log = _log(s, d)
    span = log.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    holidays = calendar.expected_sessions(span).filter(F.dayofmonth("date") == 1)
    have = panels.table(s, d, "orders").filter("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("date"))
    return calendar.missing_dates(calendar.expected_sessions(span, holidays), have, upsert.latest_status(log))


register("J6_missing_dates", "date:d", _gaps,
         f"WITH {LOG}, sp AS (SELECT min(date) AS a, max(date) AS b FROM lg), dd AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp) "
         "@@ SELECT date FROM dd WHERE isodow(date) < 6 AND day(date) <> 1 AND date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000) AND date NOT IN (SELECT date FROM ls WHERE status = 'no_data')")
register("J7_semi_anti", "isin:s side:s bars:i",
         lambda s, d: (lambda m: universe.inside(week(s, d), m).groupBy("isin").agg(F.count(F.lit(1)).alias("bars")).withColumn("side", F.lit("in")).unionByName(
             universe.short_history(universe.outside(week(s, d), m), 400).withColumn("side", F.lit("short out"))))(panels.region_map(s, d).filter("index_name = 'ASIA'")),
         f"WITH {BARS}, a AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') @@ SELECT isin, 'in' AS side, count(*) AS bars FROM bars WHERE isin IN (SELECT n_name FROM a) GROUP BY 1 "
         "UNION ALL SELECT isin, 'short out', count(*) FROM bars WHERE isin NOT IN (SELECT n_name FROM a) GROUP BY 1 HAVING count(*) < 400")
JUMP = 900.0
MOVE = pct_sql("adj_close", lag("adj_close"))
JUMPS = f"{ACTIONS}, mv AS (SELECT *, {MOVE} AS move FROM bars), jp AS (SELECT *, EXISTS (SELECT 1 FROM ac WHERE ac.isin = mv.isin AND abs(ex_date - mv.date) <= 4) AS ok FROM mv WHERE abs(move) > {JUMP})"
register("J8_tolerance_join", KEY + "move_pct:f3 explained:i", lambda s, d: (lambda b: quality.price_jumps(b, panels.actions(s, d, b), JUMP))(stored(s, d)), f"WITH {BARS}, {JUMPS} @@ SELECT isin, date, move AS move_pct, CASE WHEN ok THEN 1 ELSE 0 END AS explained FROM jp")
register("J11_previous_year", KEY + "py_high:f4 py_pivot:f4", lambda s, d: calendar.previous_year_levels(week(s, d)),
         f"WITH {BARS}, y AS (SELECT isin, year(date) + 1 AS y, max(adj_high) AS h, min(adj_low) AS l, arg_max(adj_close, date) AS c FROM bars GROUP BY 1, 2) "
         "@@ SELECT bars.isin, date, h AS py_high, (h + l + c) / 3 AS py_pivot FROM bars LEFT JOIN y ON y.isin = bars.isin AND y.y = year(date)")


def _pivot(s, d):
    wide = calendar.pivot_index(index_bars(s, d).filter(F.dayofmonth("date") > 7), ["ASIA", "MIDDLE EAST"])
    return calendar.fill_to_calendar(wide, week(s, d), ["asia", "middle_east"])


register("J12_pivot_fill", "date:d asia:f4 middle_east:f4", _pivot,
         f"WITH {BARS}, {IX}, p AS (SELECT date, max(close) FILTER (index_name = 'ASIA') AS a, max(close) FILTER (index_name = 'MIDDLE EAST') AS m FROM ix WHERE day(date) > 7 GROUP BY 1), c AS (SELECT DISTINCT date FROM bars) "
         "@@ SELECT date, last_value(a IGNORE NULLS) OVER (ORDER BY date) AS asia, last_value(m IGNORE NULLS) OVER (ORDER BY date) AS middle_east FROM c LEFT JOIN p USING (date)")
register("L8_month_windows", "isin:s from_date:d to_date:d",
         lambda s, d: calendar.month_windows(week(s, d).groupBy("isin").agg(F.date_add(F.min("date"), 10).alias("start"), F.max("date").alias("end"))),
         f"WITH {BARS}, sp AS (SELECT isin, min(date) + 10 AS a, max(date) AS b FROM bars GROUP BY 1), m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS mo FROM sp) "
         "@@ SELECT isin, greatest(a, mo) AS from_date, least(b, last_day(mo)) AS to_date FROM m")
register("L8_decade_windows", "isin:s from_date:d to_date:d",
         lambda s, d: calendar.decade_windows(week(s, d).groupBy("isin").agg(F.add_months(F.min("date"), -240).alias("start"), F.max("date").alias("end"))),
         f"WITH RECURSIVE {BARS}, sp AS (SELECT isin, CAST(min(date) - INTERVAL 240 MONTH AS DATE) AS a, max(date) AS b FROM bars GROUP BY 1), w AS (SELECT isin, a AS f, b FROM sp UNION ALL SELECT isin, CAST(f + INTERVAL 119 MONTH AS DATE) + 1, b FROM w "
         "WHERE CAST(f + INTERVAL 119 MONTH AS DATE) + 1 <= b) @@ SELECT isin, f AS from_date, least(CAST(f + INTERVAL 119 MONTH AS DATE), b) AS to_date FROM w")

# ------------------------------------------------------------------ aggregation and audit
register("A1_counts_by_date", "date:d bars:i", lambda s, d: bar_io.counts_by_date(week(s, d)), f"WITH {BARS} @@ SELECT date, count(*) AS bars FROM bars GROUP BY 1")
register("A1_summary", "rows:i isins:i sessions:i first_date:d last_date:d", lambda s, d: bar_io.summary(panels.day_panel(s, d)),
         f"WITH {DAYS} @@ SELECT count(*) AS rows, count(DISTINCT isin) AS isins, count(DISTINCT date) AS sessions, min(date) AS first_date, max(date) AS last_date FROM days")
register("A1_available_dates", "date:d", lambda s, d: bar_io.available_dates(week(s, d).withColumn("close", F.when(F.month("date") < 3, F.col("adj_close"))), "both"), f"WITH {BARS} @@ SELECT DISTINCT date FROM bars WHERE month(date) < 3")
register("A2_coverage", "bucket:i raw_rows:i adj_rows:i both_rows:i empty_rows:i",
         lambda s, d: bar_io.coverage(week(s, d).withColumns({"close": F.when(F.month("date") < 3, F.col("adj_close")), "adj_close": F.when(F.dayofmonth("date") > 9, F.col("adj_close"))}), F.year("date")),
         f"WITH {BARS}, t AS (SELECT year(date) AS bucket, month(date) < 3 AS r, day(date) > 9 AS a FROM bars) @@ SELECT bucket, count(*) FILTER (r) AS raw_rows, count(*) FILTER (a) AS adj_rows, count(*) FILTER (r AND a) AS both_rows, count(*) FILTER (NOT r AND NOT a) AS empty_rows FROM t GROUP BY 1")
register("A16_reused_symbols", "isin:s symbol:s from_date:d", lambda s, d: dims.reused_symbols(dims.symbol_history(_sightings(s, d))),
         f"WITH {HIST} @@ SELECT isin, symbol, from_date FROM sh WHERE symbol IN (SELECT symbol FROM sh GROUP BY 1 HAVING count(DISTINCT isin) > 1)")
register("Q1_structural_counts", "adj_high_below_low:i adj_not_positive:i adj_outside_range:i negative_volume:i no_complete_block:i null_key:i duplicate_keys:i",
         lambda s, d: quality.structural_counts(_damaged(s, d).drop("close")),
         f"WITH {DAYS}, {DAMAGED} @@ SELECT count(*) FILTER (adj_high < adj_low) AS adj_high_below_low, count(*) FILTER (adj_open <= 0 OR adj_high <= 0 OR adj_low <= 0 OR adj_close <= 0) AS adj_not_positive, "
         "count(*) FILTER (adj_open > adj_high + 1e-9 OR adj_close > adj_high + 1e-9 OR adj_open < adj_low - 1e-9 OR adj_close < adj_low - 1e-9) AS adj_outside_range, count(*) FILTER (volume < 0) AS negative_volume, "
         "count(*) FILTER (adj_close IS NULL) AS no_complete_block, 0 AS null_key, 0 AS duplicate_keys FROM dm")
register("Q2_price_jumps", KEY + "move_pct:f3", lambda s, d: quality.price_jumps(week(s, d), None, JUMP), f"WITH {BARS}, {JUMPS} @@ SELECT isin, date, move AS move_pct FROM jp")
CONTAM = JUMPS + f", ct AS (SELECT bars.*, EXISTS (SELECT 1 FROM jp JOIN bars b2 ON b2.isin = jp.isin AND b2.date = jp.date WHERE NOT jp.ok AND jp.isin = bars.isin AND bars.r BETWEEN b2.r - 3 AND b2.r + 12) AS bad FROM bars)"
register("Q3_contamination", KEY + "contaminated:i", lambda s, d: (lambda b: quality.with_contamination(b, panels.actions(s, d, b), JUMP, 12, 3))(stored(s, d)), f"WITH {BARS}, {CONTAM} @@ SELECT isin, date, CASE WHEN bad THEN 1 ELSE 0 END AS contaminated FROM ct")
register("Q4_stale_junk", KEY + "stale:i junk:i",
         lambda s, d: panels.day_panel(s, d).withColumn("volume", F.when(F.col("volume") > 40, 0).otherwise(F.col("volume"))).select("isin", "date", quality.stale().cast("int").alias("stale"), quality.junk().cast("int").alias("junk")),
         f"WITH {DAYS}, t AS (SELECT *, adj_open = adj_high AND adj_high = adj_low AND adj_low = adj_close AS f FROM days) @@ SELECT isin, date, CASE WHEN f THEN 1 ELSE 0 END AS stale, CASE WHEN f AND volume > 40 THEN 1 ELSE 0 END AS junk FROM t")
register("Q5_gate_report", "bars:i symbols:i ohlc_violations:i non_positive:i duplicates:i jumps_total:i jumps_unexplained:i stale_bars:i junk_bars:i",
         lambda s, d: (lambda b: quality.report(b, panels.actions(s, d, b), JUMP))(stored(s, d)),
         f"WITH {BARS}, {JUMPS} @@ SELECT count(*) AS bars, count(DISTINCT isin) AS symbols, 0 AS ohlc_violations, 0 AS non_positive, 0 AS duplicates, (SELECT count(*) FROM jp) AS jumps_total, (SELECT count(*) FROM jp WHERE NOT ok) AS jumps_unexplained, "
         "count(*) FILTER (adj_open = adj_high AND adj_high = adj_low AND adj_low = adj_close) AS stale_bars, 0 AS junk_bars FROM bars")
register("Q6_duplicate_keys", "l_orderkey:i l_linenumber:i copies:i", lambda s, d: quality.duplicate_keys(panels.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
         "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("Q7_integrity", "name:s bad_count:i", lambda s, d: quality.integrity_battery(panels.day_panel(s, d)),
         f"WITH {DAYS}, g AS (SELECT date, date - lag(date) OVER (ORDER BY date) AS g FROM (SELECT DISTINCT date FROM days)), m AS (SELECT abs({MOVE}) AS m FROM days) "
         "@@ SELECT 'calendar_gaps' AS name, count(*) FILTER (g > 5) AS bad_count FROM g UNION ALL SELECT 'weekend_sessions', count(*) FILTER (isodow(date) > 5) FROM g UNION ALL SELECT 'implausible_move', count(*) FILTER (m > 90) FROM m "
         "UNION ALL SELECT n, 0 FROM (VALUES ('high_below_low'), ('not_positive'), ('outside_range'), ('missing_adjusted'), ('missing_volume')) v(n)")
register("Q8_source_agreement", KEY + "rel_err:f6 agrees:i",
         lambda s, d: quality.source_agreement(week(s, d), week(s, d).filter(F.month("date") > 2).withColumn("adj_close", F.col("adj_close") * (1 + F.dayofmonth("date") / 3000.0)), "adj_close"),
         f"WITH {BARS} @@ SELECT isin, date, abs(adj_close / (adj_close * (1 + day(date) / 3000.0)) - 1) AS rel_err, CASE WHEN abs(adj_close / (adj_close * (1 + day(date) / 3000.0)) - 1) <= 0.005 THEN 1 ELSE 0 END AS agrees FROM bars WHERE month(date) > 2")
register("Q9_derive_raw", KEY + "close:f4 open:f4", lambda s, d: actions.derive_raw(week(s, d).withColumn("close", F.when(F.month("date") == 2, F.lit(7.0))), panels.actions(s, d)),
         f"WITH {BARS}, {FACTOR} @@ SELECT isin, date, CASE WHEN month(date) = 2 THEN 7.0 ELSE adj_close * adj_factor END AS close, adj_open * adj_factor AS open FROM fa")
register("Q10_verify_raw", KEY + "derived_close:f4 rel_err:f6 ok:i", lambda s, d: actions.verify_raw(week(s, d).withColumn("close", F.col("adj_close") * 2), panels.actions(s, d)),
         f"WITH {BARS}, {FACTOR} @@ SELECT isin, date, adj_close * adj_factor AS derived_close, abs(adj_close * adj_factor - adj_close * 2) / (adj_close * 2) AS rel_err, CASE WHEN abs(adj_close * adj_factor - adj_close * 2) / (adj_close * 2) <= 0.005 THEN 1 ELSE 0 END AS ok FROM fa")
AUDITED = ["sma_50", "ema_21", "rsi_14", "atr_14", "m_cpr_tc", "w_p", "since_brk_60", "brk_cushion", "m_cpr_width_rank", "vol_ratio", "tight_3w_pct"]
register("Q11_causality", "field:s mismatches:i", lambda s, d: quality.causality_audit(stored(s, d), lambda b: build_features(b, AUDITED), "1999-06-07", AUDITED),
         "SELECT * FROM (VALUES " + ", ".join(f"('{x}', 0)" for x in AUDITED) + ") v(field, mismatches)")


def _rederive(s, d):
    """Closing lows derived a second way (array of the previous seven closes), minus the feature's own hits."""
    bars = week(s, d)
    own = build_features(bars, ["new_lo7"]).filter("new_lo7 = 1").select("isin", "date")
    seven = F.collect_list("adj_close").over(S.frame(7, prior=True))
    other = bars.withColumn("__a", seven).filter((F.size("__a") == 7) & (F.col("adj_close") < F.array_min("__a"))).select("isin", "date")
    only_own = own.join(other, ["isin", "date"], "left_anti").agg(F.count(F.lit(1)).alias("bad")).withColumn("side", F.lit("feature only"))
    only_other = other.join(own, ["isin", "date"], "left_anti").agg(F.count(F.lit(1)).alias("bad")).withColumn("side", F.lit("rederived only"))
    return only_own.unionByName(only_other)


register("Q12_rederived_hits", "side:s bad:i", _rederive, "SELECT * FROM (VALUES ('feature only', 0), ('rederived only', 0)) v(side, bad)")


def _parity(s, d):
    """The reversal outcome against a second formulation: the first exit row by a plain range of positions."""
    from .outcomes import positioned, signals
    from ..operators import outcomes as oc
    panel = positioned(s, d)
    sig = signals(panel)
    a = oc.first_touch(panel, sig, oc.REVERSAL).select("isin", "date", "exit_r", "exit")
    fires = panel.filter("adj_close > hi7_prior").select(F.col("isin").alias("__i"), F.col("r").alias("__r"))
    first = oc.open_trades(panel, sig, oc.Exit()).select("isin", "date", "r", "last_r").join(
        fires, (F.col("isin") == F.col("__i")) & (F.col("__r") > F.col("r")) & (F.col("__r") <= F.col("r") + 20), "left")
    b = first.groupBy("isin", "date", "r", "last_r").agg(F.min("__r").alias("x"))
    at = F.when(F.col("x").isNull(), F.least(F.col("r") + 20, F.col("last_r"))).otherwise(F.least(F.col("x") + 1, F.col("last_r")))
    b = b.withColumn("exit_r", at).withColumn("use_open", F.col("x").isNotNull() & (F.col("x") < F.col("last_r")))
    px = panel.select(F.col("isin").alias("__i"), F.col("r").alias("__r"), "adj_open", "adj_close")
    b = b.join(px, (F.col("isin") == F.col("__i")) & (F.col("exit_r") == F.col("__r"))).withColumn("exit", F.when(F.col("use_open"), F.col("adj_open")).otherwise(F.col("adj_close")))
    return quality.mismatches(a, b, ["isin", "date"], ["exit_r", "exit"])


register("Q13_outcome_parity", "field:s mismatches:i", _parity, "SELECT * FROM (VALUES " + ", ".join(f"('{x}', 0)" for x in ("exit_r", "exit")) + ") v(field, mismatches)")
