"""Declared tables and schema coercion.

Dates are DATE, instants are TIMESTAMP_NTZ (exchange wall clock). Only the key columns are
mandatory: a bar may carry the raw price block, the adjusted block, or both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_DDL = {
    "bars": "isin string, date date, symbol string, series string, open double, high double, low double, "
            "close double, prev_close double, adj_open double, adj_high double, adj_low double, "
            "adj_close double, volume bigint, turnover double, trades bigint, source string, adj_source string",
    "minutes": "isin string, ts timestamp_ntz, open double, high double, low double, close double, "
               "volume bigint, source string",
    "actions": "isin string, ex_date date, action string, ratio double, purpose string",
    "symbols": "isin string, symbol string, name string, series string, first_seen date, last_seen date",
    "symbol_history": "isin string, symbol string, from_date date, to_date date",
    "membership": "index_name string, isin string, symbol string, name string, from_date date, to_date date",
    "fundamentals": "isin string, symbol string, shares double, vendor_mcap double, source string, fetched_at timestamp_ntz",
    "ingest_log": "date date, source string, status string, rows bigint, message string, run_at timestamp_ntz",
}

KEYS = {
    "bars": ["isin", "date"],
    "minutes": ["isin", "ts"],
    "actions": ["isin", "ex_date", "action"],
    "symbols": ["isin"],
    "fundamentals": ["isin"],
    "ingest_log": ["date", "source"],
}

RAW_BLOCK = ["open", "high", "low", "close"]
ADJ_BLOCK = ["adj_open", "adj_high", "adj_low", "adj_close"]


def struct(table: str) -> T.StructType:
    """The declared schema of ``table``."""
    return T.StructType.fromDDL(_DDL[table])


def coerce(df: DataFrame, table: str, strict: bool = False) -> DataFrame:
    """Declared columns in declared order; missing ones null, bad casts null, integers rounded half-even.

    NaN becomes null so comparisons against a missing value are false.
    """
    have = set(df.columns)
    unknown = sorted(have - set(struct(table).names))
    if strict and unknown:
        raise ValueError(f"unexpected columns for {table}: {unknown}")
    out = []
    for field in struct(table):
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        column = F.col(field.name)
        source = df.schema[field.name].dataType
        if isinstance(field.dataType, T.LongType) and not isinstance(source, (T.LongType, T.IntegerType, T.ShortType)):
            number = F.bround(F.expr(f"try_cast(`{field.name}` AS double)"), 0)
            out.append(number.try_cast("bigint").alias(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            number = column.try_cast("double")
            out.append(F.when(~F.isnan(number), number).alias(field.name))
        else:
            out.append(column.try_cast(field.dataType.simpleString()).alias(field.name))
    return df.select(*out)
