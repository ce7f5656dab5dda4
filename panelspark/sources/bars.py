"""Reading, writing and down-sampling bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import week_friday
from ..schema import ADJ_BLOCK, RAW_BLOCK

# The session opens at 09:15 and its hours run to 15:30.
SESSION_OFFSET = "15 minutes"
SESSION_OPEN, SESSION_CLOSE = "09:15", "15:30"


def instant_order(ts: Column, tie: Column | None = None) -> Column:
    """Instants, and whole numbers (up to 18 digits) among equal ones, as one decimal: an aggregate hashes on it, on a struct it sorts."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(38,0)")
    return micros if tie is None else (micros * F.lit(10 ** 18).cast("decimal(19,0)") + tie.cast("decimal(18,0)")).cast("decimal(38,0)")


def hour_bars(minutes: DataFrame, session_hours: bool = False) -> DataFrame:
    """Sixty-minute bars whose boundaries fall at a quarter past."""
    if session_hours:
        clock = F.date_format("ts", "HH:mm")
        minutes = minutes.filter((clock >= SESSION_OPEN) & (clock < SESSION_CLOSE))
    order = instant_order(F.col("ts"), F.col("event_id") if "event_id" in minutes.columns else None)
    slot = F.window("ts", "60 minutes", "60 minutes", SESSION_OFFSET)
    return minutes.groupBy("isin", slot.alias("w")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"),
    ).select("isin", F.col("w.start").alias("hour"), "open", "high", "low", "close", "volume")


def week_bars(bars: DataFrame) -> DataFrame:
    """Weekly bars ending on Friday; weeks without a session do not appear."""
    return bars.groupBy("isin", week_friday(F.col("date")).alias("week")).agg(
        F.min_by("adj_open", "date").alias("open"), F.max("adj_high").alias("high"),
        F.min("adj_low").alias("low"), F.max_by("adj_close", "date").alias("close"), F.sum("volume").alias("volume"))


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
              isins: Sequence[str] | None = None, symbols: Sequence[str] | None = None,
              columns: Sequence[str] | None = None) -> DataFrame:
    """Bars partitioned by year. The year bound is derived from the dates so whole partitions are skipped."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if start is not None:
        df = df.filter((F.col("year") >= int(str(start)[:4])) & (F.col("date") >= F.lit(str(start)).cast("date")))
    if end is not None:
        df = df.filter((F.col("year") <= int(str(end)[:4])) & (F.col("date") <= F.lit(str(end)).cast("date")))
    if isins is not None:
        df = df.filter(F.col("isin").isin(list(isins)))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    df = df.drop("year")
    return df.select(*columns) if columns else df


def read_minutes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                 isins: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Minute rows partitioned by year and month, pruned by a month number derived from the bounds."""
    df = spark.read.parquet(path)
    stamp = F.col("year") * 12 + F.col("month")
    for bound, is_start in ((start, True), (end, False)):
        if bound is None:
            continue
        y, m = int(bound[:4]), int(bound[5:7])
        at = F.lit(bound).cast("timestamp_ntz")
        df = df.filter((stamp >= y * 12 + m) & (F.col("ts") >= at) if is_start else (stamp <= y * 12 + m) & (F.col("ts") <= at))
    if isins is not None:
        df = df.filter(F.col("isin").isin(list(isins)))
    df = df.drop("year", "month")
    return df.select(*columns) if columns else df


def write_partitions(df: DataFrame, path: str, kind: str = "bars") -> None:
    """Rewrite only the year (bars) or year/month (minutes) partitions present in ``df``.

    Rows are clustered by partition and a hash of the key, so a partition is written by several tasks
    and one busy month does not fall to a single writer.
    """
    stamp = F.col("date") if kind == "bars" else F.col("ts")
    parts = ["year"] if kind == "bars" else ["year", "month"]
    df = df.withColumn("year", F.year(stamp))
    if kind != "bars":
        df = df.withColumn("month", F.month(stamp))
    spread = F.pmod(F.hash("isin"), F.lit(16))
    (df.repartition(*parts, spread).sortWithinPartitions(*parts, "isin").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def available_dates(bars: DataFrame, require: str = "any") -> DataFrame:
    """Distinct sessions that carry the required price block (``raw``, ``adj``, ``both`` or ``any``)."""
    raw, adj = F.col("close").isNotNull(), F.col("adj_close").isNotNull()
    keep = {"raw": raw, "adj": adj, "both": raw & adj, "any": F.lit(True)}[require]
    return bars.filter(keep).select("date").distinct()


def counts_by_date(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(F.count(F.lit(1)).alias("bars"))


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("isin").alias("isins"),
                    F.countDistinct("date").alias("sessions"), F.min("date").alias("first_date"),
                    F.max("date").alias("last_date"))


def coverage(bars: DataFrame, by: Column) -> DataFrame:
    """How many rows carry the raw block, the adjusted block, both or neither."""
    raw = F.col(RAW_BLOCK[-1]).isNotNull()
    adj = F.col(ADJ_BLOCK[-1]).isNotNull()
    return bars.groupBy(by.alias("bucket")).agg(
        F.count_if(raw).alias("raw_rows"), F.count_if(adj).alias("adj_rows"),
        F.count_if(raw & adj).alias("both_rows"), F.count_if(~raw & ~adj).alias("empty_rows"))


def query(spark: SparkSession, sql: str, bars: DataFrame | None = None, minutes: DataFrame | None = None, **parameters) -> DataFrame:
    """Ad-hoc SQL over views named ``bars`` and ``minutes``, with named parameters."""
    if bars is not None:
        bars.createOrReplaceTempView("bars")
    if minutes is not None:
        minutes.createOrReplaceTempView("minutes")
    return spark.sql(sql, args=parameters or None)
