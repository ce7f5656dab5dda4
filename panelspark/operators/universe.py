"""Universe floors, size columns and semi/anti membership filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.core import cap_band, holds, ratio

CRORE = 1e7


def above_floor(fundamentals: DataFrame, floor_cr: float) -> DataFrame:
    """Distinct keys whose vendor size reaches the floor."""
    return fundamentals.filter(F.col("vendor_mcap") / CRORE >= floor_cr).select("isin").distinct()


def with_size(panel: DataFrame, fundamentals: DataFrame, floor_cr: float | None = None) -> DataFrame:
    """Own size (shares x close) or else the vendor's, its band, and a flag when the two differ threefold."""
    f = fundamentals.select("isin", "shares", "vendor_mcap")
    df = panel.join(f, "isin", "left")
    own = F.col("shares") * F.coalesce(F.col("close"), F.col("adj_close")) / CRORE if "close" in panel.columns else F.col("shares") * F.col("adj_close") / CRORE
    vendor = F.col("vendor_mcap") / CRORE
    spread = F.greatest(ratio(own, vendor), ratio(vendor, own))
    df = df.withColumns({"mcap_cr": F.coalesce(own, vendor), "size_disagrees": holds(spread > 3).cast("int")})
    df = df.withColumn("cap_band", cap_band(F.col("mcap_cr"))).drop("shares", "vendor_mcap")
    return df if floor_cr is None else df.filter(F.col("mcap_cr") >= floor_cr)


def inside(panel: DataFrame, keys: DataFrame, on: Sequence[str] = ("isin",)) -> DataFrame:
    return panel.join(keys.select(*on).distinct(), list(on), "left_semi")


def outside(panel: DataFrame, keys: DataFrame, on: Sequence[str] = ("isin",)) -> DataFrame:
    return panel.join(keys.select(*on).distinct(), list(on), "left_anti")


def short_history(panel: DataFrame, least: int) -> DataFrame:
    return panel.groupBy("isin").agg(F.count(F.lit(1)).alias("bars")).filter(F.col("bars") < least)
