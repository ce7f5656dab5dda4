"""Parsers for exchange files, candle arrays, instrument masters and constituent lists.

Each takes a frame of text columns (``spark.read.csv`` with a header, or a JSON column) and stays
declarative; bad values become null or go to a rejected frame, never to an exception per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.core import holds
from ..operators.upsert import keep_last
from ..schema import coerce


class FileColumn(NamedTuple):
    """One column of a text file: its header, our name, how to read it, and what stands for an absent optional column."""
    header: str
    name: str
    kind: str = "text"
    required: bool = False
    absent: str | None = None


# File headers, instrument types, series, key pattern, master kinds.
EXCHANGE = (
    FileColumn("TradDt", "date", "date", True),
    FileColumn("ISIN", "isin", "text", True),
    FileColumn("TckrSymb", "symbol", "text", True),
    FileColumn("SctySrs", "series", "text", True),
    FileColumn("FinInstrmTp", "instrument", absent="STK"),
    FileColumn("OpnPric", "open", "number"),
    FileColumn("HghPric", "high", "number"),
    FileColumn("LwPric", "low", "number"),
    FileColumn("ClsPric", "close", "number", True),
    FileColumn("PrvsClsgPric", "prev_close", "number"),
    FileColumn("TtlTradgVol", "volume", "number"),
    FileColumn("TtlTrfVal", "turnover", "number"),
    FileColumn("TtlNbOfTxsExctd", "trades", "number"),
)
LISTING = (
    FileColumn("ISIN Code", "isin", "filled", True),
    FileColumn("Symbol", "symbol", "filled", True),
    FileColumn("Company Name", "name", "filled"),
    FileColumn("Series", "series", "filled"),
    FileColumn("Industry", "industry", "filled"),
)
EQUITY_TYPES = ["STK", "EQ"]
EQUITY_SERIES = ["EQ", "BE", "BZ"]
KEY_PATTERN = "^IN[EF][A-Z0-9]{9}$"
MASTER_KINDS = ["01", "02", "03", "04", "05", "06"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; types are decided by the parsers."""
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)


def parse_date(x: Column) -> Column:
    """Year-first, day-first, or anything the engine recognises."""
    x = F.trim(x)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in ("yyyy-MM-dd", "dd-MM-yyyy")], x.try_cast("date"))


READ_AS: dict[str, Callable[[Column], Column]] = {
    "text": F.trim,
    "filled": lambda x: F.trim(F.coalesce(x, F.lit(""))),
    "number": lambda x: F.trim(x).try_cast("double"),
    "date": parse_date,
}


def declared(raw: DataFrame, table: Sequence[FileColumn], what: str, fold: Callable[[str], str] = str.strip) -> list[Column]:
    """The columns of ``table`` out of a text frame: headers are compared after ``fold``, kinds decide the reading."""
    held = {fold(c): F.col(f"`{c}`") for c in raw.columns}
    lost = [c.header for c in table if c.required and fold(c.header) not in held]
    if lost:
        raise ValueError(f"{what} without {', '.join(lost)}")
    return [READ_AS[c.kind](held.get(fold(c.header), F.lit(c.absent).cast("string"))).alias(c.name) for c in table]


def parse_exchange(raw: DataFrame, series: Sequence[str] = tuple(EQUITY_SERIES), source: str = "bhavcopy_udiff") -> DataFrame:
    """Exchange file to canonical raw bars; the adjusted block is never filled here.

    ``line`` orders repeated keys when present, otherwise input order inside a partition.
    """
    line = F.col("line").cast("bigint") if "line" in raw.columns else F.monotonically_increasing_id()
    rows = raw.select(*declared(raw, EXCHANGE, "exchange file"), F.lit(source).alias("source"), line.alias("__line"))
    equity = F.upper("instrument").isin(EQUITY_TYPES) & F.upper("series").isin([x.upper() for x in series])
    bars = rows.filter(equity & holds(F.col("isin") != "") & holds(F.col("close") > 0)).drop("instrument")
    return coerce(keep_last(bars, ["isin", "date"], F.col("__line")).drop("__line"), "bars")


def parse_candles(df: DataFrame, column: str = "candles") -> DataFrame:
    """JSON arrays ``[ts, o, h, l, c, v, oi]`` to rows; the offset is dropped, keeping exchange wall clock."""
    arrays = F.from_json(F.col(column), "array<array<string>>")
    rows = df.withColumn("__c", F.explode(arrays))
    # Text with an offset to an instant, then to exchange wall clock without a zone.
    instant = F.to_timestamp(F.col("__c")[0]).cast("timestamp_ntz")
    wall = F.convert_timezone(F.current_timezone(), F.lit("Asia/Kolkata"), instant)
    number = lambda i: F.get(F.col("__c"), F.lit(i)).try_cast("double")
    return rows.select("isin", wall.alias("ts"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"),
                       number(4).alias("close"), F.bround(number(5), 0).cast("bigint").alias("volume"))


def daily_from_candles(candles: DataFrame, source: str = "vendor") -> DataFrame:
    """Candle rows to adjusted daily bars."""
    return candles.select("isin", F.to_date("ts").alias("date"), *[F.col(c).alias(f"adj_{c}") for c in ("open", "high", "low", "close")],
                          "volume", F.lit(source).alias("adj_source"))


def parse_constituents(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Constituent list to (valid, excluded); headers are compared without case, the key pattern decides.

    With ``strict`` a row with a bad key fails the job. Duplicate valid keys always do.
    """
    rows = raw.select(*declared(raw, LISTING, "constituent list", lambda c: c.strip().lower()))
    sound = F.col("isin").rlike(KEY_PATTERN)
    # Bad keys may be many and alike: unless they fail the job, they are gone before copies are counted.
    counted = (rows if strict else rows.filter(sound)).withColumn("__copies", F.count(F.lit(1)).over(Window.partitionBy("isin")))
    fault = (F.when(~sound, F.lit("row with an unusable key"))
             .when(F.col("__copies") > 1, F.concat(F.lit("duplicate key "), F.col("isin"))))
    valid = counted.withColumn("isin", F.when(fault.isNull(), F.col("isin")).otherwise(F.raise_error(fault).cast("string")))
    return valid.drop("__copies"), rows.filter(~sound)


def filter_instruments(master: DataFrame) -> DataFrame:
    """Equity rows of an instrument master: key after the bar in ``instrument_key``, tickers not starting with a digit."""
    df = master.withColumn("isin", F.element_at(F.split("instrument_key", "\\|"), -1))
    return df.filter(F.col("isin").rlike(KEY_PATTERN) & ~F.col("symbol").rlike("^[0-9]") & F.substring("isin", 8, 2).isin(MASTER_KINDS))
