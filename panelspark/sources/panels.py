"""Panels derived from the star-schema tables: how raw observations become bars.

Raw rows meet their dimension once and are aggregated with map-side partials, so whatever one supplier
contributes leaves a task as one row per (key, period). The supplier side is sent whole only when the
optimizer knows it is small; otherwise the join shuffles and adaptive execution splits a hot supplier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

# The columns that are unique in lineitem inside a period, and the decimal digits each may take.
LINE_ORDER = {"l_orderkey": 13, "l_linenumber": 2, "l_partkey": 11, "l_suppkey": 11}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(parts: Sequence[tuple[Column, int]]) -> Column:
    """Whole numbers as one decimal that orders like their tuple; (column, digits), 38 digits in all.

    A decimal fits a hash aggregate's buffer, a struct does not and would have every raw row sorted.
    A value outside its digits fails the job rather than misorder.
    """
    groups: list[tuple[Column, int]] = []  # neighbours that fit a long together are joined as longs
    for column, digits in parts:
        fits = (column >= 0) & (column < F.lit(10 ** digits))
        whole = F.when(column.isNull() | fits, column).otherwise(F.raise_error(F.lit(f"an ordering value needs more than {digits} digits")).cast("bigint"))
        if groups and groups[-1][1] + digits <= 18:
            before, taken = groups.pop()
            groups.append((before * F.lit(10 ** digits).cast("bigint") + whole, taken + digits))
        else:
            groups.append((whole.cast("bigint"), digits))
    out = groups[0][0].cast("decimal(38,0)")
    for column, digits in groups[1:]:
        out = out * F.lit(10 ** digits).cast("decimal(38,0)") + column.cast("decimal(38,0)")
    return out.cast("decimal(38,0)")


def to_bars(rows: DataFrame, by: list, price: Column, order: Column, volume: Column, amount: Column) -> DataFrame:
    """Observations to bars: first and last by a unique order, extremes, sums.

    With a price and an order of fixed width (``packed``) this is a hash aggregate with map-side partials.
    """
    rows = rows.withColumns({"__price": price, "__order": order})
    px = F.col("__price")
    merged = rows.groupBy(*by).agg(
        F.min_by(px, "__order").alias("adj_open"), F.max(px).alias("adj_high"), F.min(px).alias("adj_low"), F.max_by(px, "__order").alias("adj_close"),
        F.sum(volume).alias("v"), F.sum(amount).alias("a"), F.count(F.lit(1)).alias("trades"))
    return merged.select(*by, "adj_open", "adj_high", "adj_low", "adj_close",
                         F.col("v").cast("bigint").alias("volume"), F.round("a", 2).alias("turnover"), "trades")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_shipdate", *LINE_ORDER, "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))


def _order() -> Column:
    """By ship date (a week has one digit of days), then by what is unique on a date."""
    return packed([(F.datediff("l_shipdate", "date"), 1), *[(F.col(c), n) for c, n in LINE_ORDER.items()]])


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (supplier nation, week)."""
    rows = _lines(spark, sf_dir).withColumn("date", F.trunc(F.to_date("l_shipdate"), "week"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("isin"))
    joined = (rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return _with_raw(to_bars(joined, ["isin", "date"], F.col("px"), _order(), F.col("l_quantity"), F.col("l_extendedprice")))


def stored_week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars, materialised once: for plans that read them along several branches."""
    return cut_lineage(week_panel(spark, sf_dir))


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (supplier, day): many keys, long history, thin bars."""
    rows = _lines(spark, sf_dir).select(
        F.format_string("S%06d", "l_suppkey").alias("isin"), F.to_date("l_shipdate").alias("date"), "*")
    return _with_raw(to_bars(rows, ["isin", "date"], F.col("px"), _order(), F.col("l_quantity"), F.col("l_extendedprice")))


def _with_raw(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"symbol": F.col("isin"), "close": F.lit(None).cast("double")})


def minute_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event observations as minute-style rows keyed by (isin, ts)."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("isin"), F.col("ts"), F.col("event_id"),
        *[F.col("value").alias(x) for x in ("open", "high", "low", "close")],
        F.lit(1).cast("bigint").alias("volume"))


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_name, isin): which nation belongs to which region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("index_name"), F.col("n_name").alias("isin"), "n_nationkey"))


def membership(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Half-open membership intervals: every third nation leaves at its middle bar."""
    bars = week_panel(spark, sf_dir) if bars is None else bars
    days = bars.groupBy("isin").agg(F.sort_array(F.collect_list("date")).alias("d"))
    span = days.select("isin", F.element_at("d", 1).alias("from_date"),
                       F.element_at("d", (F.size("d") / 2).cast("int") + 1).alias("mid"))
    return region_map(spark, sf_dir).join(span, "isin").select(
        "index_name", "isin", F.col("isin").alias("symbol"), F.col("isin").alias("name"), "from_date",
        F.when(F.col("n_nationkey") % 3 == 0, F.col("mid")).alias("to_date"))


def actions(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Ratio 2 on the first bar of each leap year for every fourth nation."""
    bars = week_panel(spark, sf_dir) if bars is None else bars
    chosen = region_map(spark, sf_dir).filter(F.col("n_nationkey") % 4 == 0).select("isin")
    return (bars.join(chosen, "isin").filter(F.year("date") % 4 == 0)
            .groupBy("isin", F.year("date").alias("y")).agg(F.min("date").alias("ex_date"))
            .select("isin", "ex_date", F.lit("split").alias("action"), F.lit(2.0).alias("ratio")))
