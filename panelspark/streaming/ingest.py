"""Streaming ingest: idempotent merges, session-anchored bars, keep-last deduplication."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import keep_last, upsert_columns
from ..session import cut_lineage
from ..sources.bars import SESSION_OFFSET, instant_order, write_partitions


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def merge_into(path: str, key: list[str], order: Column, columns: list[str], log: str = "merge") -> Callable[[DataFrame, int], None]:
    """A batch function that merges column-wise into a year-partitioned table.

    Only the years a batch touches are read and rewritten. The merged rows are first written beside the table, under the
    batch's own name (``log`` tells streams into one table apart; readers skip the folder), and then replace the years. When a
    crash breaks the replacement, the replayed batch finds its rows there, whole, and replaces again: it never reads the broken
    table. A batch replayed later than that changes nothing, so a restarted query is safe at any point.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        beside = f"{path}/_beside/{log}-{batch_id}"
        files, done = _folder(spark, beside + "/_SUCCESS")
        if not files.exists(done):
            fresh = cut_lineage(keep_last(batch.select(*columns, order.alias("__order")), key, F.col("__order")).drop("__order"))
            years = [r[0] for r in fresh.select(F.year("date")).distinct().collect()]  # a handful of partitions
            if not years:
                return
            try:
                stored = spark.read.parquet(path).filter(F.col("year").isin(years)).select(*columns)
            except Exception as error:  # the first batch finds no table
                if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                    raise
                stored = fresh.limit(0)
            upsert_columns(stored, fresh, key).drop("change").write.mode("overwrite").parquet(beside)
        write_partitions(spark.read.parquet(beside), path)
        files, folder = _folder(spark, beside)
        files.delete(folder, True)

    return apply


def stream_merge(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: Column, columns: list[str]) -> StreamingQuery:
    """Merge a stream of late or provisional bars into a table, through the available data, batch by batch."""
    log = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (stream.writeStream.foreachBatch(merge_into(path, key, order, columns, log))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_hour_bars(minutes: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hour bars of a minute stream (isin, ts, open, high, low, close, volume); emitted when the watermark passes."""
    instant = F.col("ts").cast("timestamp")
    order = instant_order(F.col("at"), F.col("event_id") if "event_id" in minutes.columns else None)
    return (minutes.withColumn("at", instant).withWatermark("at", late)
            .groupBy("isin", F.window("at", "60 minutes", "60 minutes", SESSION_OFFSET).alias("w"))
            .agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
            .select("isin", F.col("w.start").cast("timestamp_ntz").alias("hour"), "open", "high", "low", "close", "volume"))


def stream_keep_last(minutes: DataFrame, order: str, late: str = "1 day") -> DataFrame:
    """The latest version of each (isin, ts) row: an update-mode aggregate whose state expires with the watermark.

    ``dropDuplicatesWithinWatermark`` would keep the first version instead.
    """
    rest = [c for c in minutes.columns if c not in ("isin", "ts")]
    return (minutes.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
            .groupBy("isin", "at").agg(F.max_by(F.struct(*rest), order).alias("__row"))
            .select("isin", F.col("at").cast("timestamp_ntz").alias("ts"), *[F.col("__row")[c].alias(c) for c in rest]))
