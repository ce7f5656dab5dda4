"""Result sinks: tables, CSV, nested JSON documents, sharded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import month_start


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def result_documents(stats: DataFrame, hist: DataFrame) -> DataFrame:
    """One nested document per rule: horizon -> statistics, and the histogram as an ordered array."""
    values = [c for c in stats.columns if c not in ("rule", "horizon")]
    horizons = stats.groupBy("rule").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", F.struct(*values))))).alias("horizons"))
    bars = hist.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("hist"))
    return horizons.join(bars, "rule", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def shared_grid(panel: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every session for every key, with its position; the grid is one row per (key, session).

    Sessions are a bounded calendar: one array, read as a scalar subquery and exploded per key, without a join.
    """
    calendar = panel.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("days")).scalar()
    names = (panel if keys is None else keys).select("isin").distinct()
    return names.select("isin", F.posexplode(calendar).alias("grid_i", "date"))


def series_documents(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per key, equal-length arrays on the shared grid, holes as null. A key's array is as long as the calendar."""
    grid = shared_grid(panel).join(panel.select("isin", "date", *columns.values()), ["isin", "date"], "left")
    row = F.struct(F.col("grid_i"), *[F.col(c).alias(n) for n, c in columns.items()])
    packed = grid.groupBy("isin").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return packed.select("isin", *[F.col(f"__rows.{n}").alias(n) for n in columns])


def level_segments(panel: DataFrame, levels: list[str], months: int = 3) -> DataFrame:
    """Per key, the last months that carry levels: their values and the first and last grid position."""
    grid = panel.select("date").distinct().withColumn("grid_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    df = panel.join(F.broadcast(grid), "date").filter(F.col(levels[0]).isNotNull())
    seg = df.groupBy("isin", month_start(F.col("date")).alias("month")).agg(
        F.min("grid_i").alias("start_i"), F.max("grid_i").alias("end_i"), *[F.min_by(x, "date").alias(x) for x in levels])
    recent = Window.partitionBy("isin").orderBy(F.col("month").desc())
    return seg.withColumn("__p", F.row_number().over(recent)).filter(F.col("__p") <= months).drop("__p")


def shard_number(key: Column, shards: int = 15) -> Column:
    """Character-sum shard of a key, stable across engines."""
    codes = F.transform(F.split(key, ""), lambda x: F.ascii(x))
    return F.pmod(F.aggregate(codes, F.lit(0), lambda a, x: a + x), F.lit(shards))


def write_shards(df: DataFrame, path: str, shards: int = 15) -> None:
    """Files per shard; a shard's keys are spread over several tasks by a hash of the key."""
    tagged = df.withColumn("shard", shard_number(F.col("isin"), shards))
    tagged.repartition("shard", F.pmod(F.hash("isin"), F.lit(4))).write.mode("overwrite").partitionBy("shard").json(path)
