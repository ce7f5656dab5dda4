"""Streaming queries, each driven to completion over files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import build_features
from ..sources import panels
from ..streaming import ingest, positions
from .base import BARS, MINUTES, register
from .outcomes import GREEDY, touch_sql
from .upkeep import shared_path
from .windows import KEY


BATCHES = 5


def _files(df, path: str, part=None):
    """Write ``df`` in ``BATCHES`` parts, one after the other, and stream them back, a part per batch.

    ``part`` (0, 1, ...) says which part a row belongs to; rows are dealt by a hash where it is not given.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(BATCHES)) if part is None else part
    held = df.withColumn("__part", part.cast("int"))
    held.write.mode("overwrite").partitionBy("__part").parquet(path + "-parts")
    spark = df.sparkSession
    for i in range(BATCHES):
        spark.read.schema(held.schema).parquet(path + "-parts").filter(F.col("__part") == i).select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_order(df, time: str):
    """Parts by equal shares of the time span: later rows come in later batches."""
    span = df.agg(F.min(F.unix_timestamp(F.col(time).cast("timestamp"))).alias("lo"), F.max(F.unix_timestamp(F.col(time).cast("timestamp"))).alias("hi")).first()
    width = max(1, (span.hi - span.lo) // BATCHES + 1)
    return F.floor((F.unix_timestamp(F.col(time).cast("timestamp")) - span.lo) / width)


def _drain(stream, root: str, mode: str):
    """Run a stream once over the available files into parquet and read the result back."""
    def save(batch, batch_id):
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(root + "/out")
    query = (stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", root + "/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(root + "/out")


def _blocks(s, d):
    """Raw and adjusted blocks of the same bars arriving separately, out of order and repeated."""
    bars = panels.week_panel(s, d).select("isin", "date", F.col("adj_close").alias("close"), "adj_close", "volume")
    raw = bars.withColumns({"adj_close": F.lit(None).cast("double"), "seq": F.lit(1)})
    adjusted = bars.withColumns({"close": F.lit(None).cast("double"), "volume": F.lit(None).cast("bigint"), "seq": F.lit(2)})
    return raw, adjusted


def _late_blocks(s, d):
    root = shared_path(s)
    raw, adjusted = _blocks(s, d)
    columns = ["isin", "date", "close", "adj_close", "volume"]
    for i, block in enumerate((adjusted, raw, adjusted)):  # the last one is a replay
        stream = _files(block, f"{root}/in{i}")
        ingest.stream_merge(stream, root + "/bars", f"{root}/state{i}", ["isin", "date"], F.col("seq"), columns).awaitTermination()
    return s.read.parquet(root + "/bars").select(*columns)


register("ST1_late_blocks", KEY + "close:f4 adj_close:f4 volume:i", _late_blocks, f"WITH {BARS} @@ SELECT isin, date, adj_close AS close, adj_close, volume FROM bars")


def _hours(s, d):
    """Bars of every hour: a closing row a day after the last one moves the watermark past them and stays open itself."""
    root = shared_path(s)
    minutes = panels.minute_panel(s, d)
    closing = minutes.agg(F.max("ts").alias("ts")).selectExpr("'closing' AS isin", "ts + INTERVAL 1 DAY AS ts")
    rows = minutes.unionByName(closing, allowMissingColumns=True)
    out = _drain(ingest.stream_hour_bars(_files(rows, root + "/in", _in_order(rows, "ts"))), root, "append")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


register("ST2_stream_hours", "isin:s hour:s open:f4 high:f4 low:f4 close:f4 volume:i", _hours,
         f"WITH {MINUTES}, h AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01 09:15:00') AS hr FROM minutes) "
         "@@ SELECT isin, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hour, first(open ORDER BY ts, event_id) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM h GROUP BY isin, hr")


def _versions(s, d):
    root = shared_path(s)
    rows = panels.minute_panel(s, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("isin", "ts", "close", "event_id")
    out = _drain(ingest.stream_keep_last(_files(rows, root + "/in", _in_order(rows, "ts")), "event_id"), root, "update")
    last = out.groupBy("isin", "ts").agg(F.max_by("close", "__batch").alias("close"), F.max("event_id").alias("event_id"))
    return last.withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


register("ST3_keep_last", "isin:s stamp:s close:f4 event_id:i", _versions,
         f"WITH {MINUTES} @@ SELECT isin, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS stamp, arg_max(close, event_id) AS close, max(event_id) AS event_id FROM minutes GROUP BY 1, 2")


def _provisional(s, d):
    """A provisional bar of each day, later replaced by the final one."""
    root = shared_path(s)
    bars = panels.week_panel(s, d).select("isin", "date", "adj_close", "volume")
    for i, block in enumerate((bars.withColumns({"adj_close": F.col("adj_close") * 2, "volume": F.lit(1).cast("bigint"), "seq": F.lit(1)}), bars.withColumn("seq", F.lit(2)))):
        ingest.stream_merge(_files(block, f"{root}/in{i}"), root + "/bars", f"{root}/state{i}", ["isin", "date"], F.col("seq"), ["isin", "date", "adj_close", "volume"]).awaitTermination()
    return s.read.parquet(root + "/bars").select("isin", "date", "adj_close", "volume")


register("ST4_provisional_bars", KEY + "adj_close:f4 volume:i", _provisional, f"WITH {BARS} @@ SELECT isin, date, adj_close, volume FROM bars")


def _lifecycle(s, d):
    """Bars in several batches, one in eight of them a batch late; a bar of each key far ahead lets the last ones go through."""
    root = shared_path(s)
    panel = build_features(panels.week_panel(s, d), ["hi7_prior", "atr_pct", "new_lo7"])
    bars = panel.select("isin", "date", "adj_open", "adj_close", "hi7_prior", "atr_pct", F.col("new_lo7").alias("signal"))
    ahead = bars.groupBy("isin").agg(F.date_add(F.max("date"), DELAY + 30).alias("date"))
    late = F.pmod(F.xxhash64("isin", "date"), F.lit(8)) == 0
    rows = bars.unionByName(ahead, allowMissingColumns=True)
    part = F.least(_in_order(rows, "date") + F.when(late & F.col("adj_open").isNotNull(), 1).otherwise(0), F.lit(BATCHES - 1))
    stream = positions.stream_positions(_files(rows, root + "/in", part), 0.2, 20, delay=DELAY)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider)
    s.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drain(stream, root, "append")
    finally:
        s.conf.set(provider, before)


DELAY = 1200  # days: more than a batch of the fixture spans, so that a bar one batch late still takes its place
register("ST5_position_lifecycle", "isin:s entry_date:d exit_date:d entry:f4 exit:f4 bars:i why:s", _lifecycle,
         touch_sql(stop="atr", stop_on="close", trigger="adj_close > hi7", why="reversal", cap=20, risk="entry * atr_pct / 100 * 0.2") + ", " + GREEDY
         + "@@ SELECT tk.isin, a.date AS entry_date, b.date AS exit_date, entry, exit, bars, why FROM tk JOIN bars a ON a.isin = tk.isin AND a.r = tk.t + 1 JOIN bars b ON b.isin = tk.isin AND b.r = tk.exit_r "
         "WHERE NOT (why = 'time' AND bars < 20)")
