"""Registration of queries with their ANSI SQL twins.

A result is declared once as ``"name:kind ..."`` and the same rounding is applied on both sides:
``s`` string, ``d`` date (as ISO text), ``i`` integer (never null), ``n`` nullable integer (as double),
``f3`` double rounded to 3 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rounding offset: prices over small quantities fall exactly on halves, where engines disagree; this avoids them.
HALF = 0.4873

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _parse(columns):
        x = F.col(name)
        if kind == "s":
            x = x.cast("string")
        elif kind == "d":
            x = F.date_format(x, "yyyy-MM-dd")
        elif kind == "i":
            x = x.cast("bigint")
        elif kind == "n":
            x = x.cast("double")
        else:
            scale = 10.0 ** int(kind[1:])
            x = F.floor(x.cast("double") * scale + HALF) / F.lit(scale)
        out.append(x.alias(name))
    return df.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _parse(columns):
        if kind == "s":
            x = f"CAST({name} AS VARCHAR)"
        elif kind == "d":
            x = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            x = f"CAST({name} AS BIGINT)"
        elif kind == "n":
            x = f"CAST({name} AS DOUBLE)"
        else:
            x = f"floor(CAST({name} AS DOUBLE) * 1e{kind[1:]} + {HALF}) / 1e{kind[1:]}"
        out.append(f"{x} AS {name}")
    head, body = split_with(sql)
    return f"{head} SELECT {', '.join(out)} FROM ({body}) AS result"


def split_with(sql: str) -> tuple[str, str]:
    """Queries are written as ``<common table expressions> @@ <final select>``."""
    if "@@" not in sql:
        return "", sql
    head, body = sql.split("@@")
    return head, body


def register(name: str, columns: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is already registered")
    QUERIES[name] = lambda spark, sf_dir: shape(query(spark, sf_dir), columns)
    if sql is not None:
        ORACLES[name] = shape_sql(sql, columns)


# ---------------------------------------------------------------- shared SQL of the derived panels
LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

BARS = f"""
li AS (SELECT l.*, l_extendedprice / l_quantity AS px FROM lineitem l),
bars0 AS (
  SELECT n_name AS isin, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         first(px ORDER BY {LINE_ORDER}) AS adj_open, max(px) AS adj_high, min(px) AS adj_low,
         last(px ORDER BY {LINE_ORDER}) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume,
         round(sum(l_extendedprice), 2) AS turnover, count(*) AS trades
  FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY date) AS r,
                count(*) OVER (PARTITION BY isin) AS last_r FROM bars0)
"""

DAYS = f"""
li AS (SELECT l.*, l_extendedprice / l_quantity AS px FROM lineitem l),
days0 AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS isin, CAST(l_shipdate AS DATE) AS date,
         first(px ORDER BY {LINE_ORDER}) AS adj_open, max(px) AS adj_high, min(px) AS adj_low,
         last(px ORDER BY {LINE_ORDER}) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume,
         round(sum(l_extendedprice), 2) AS turnover, count(*) AS trades
  FROM li GROUP BY 1, 2),
days AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY date) AS r FROM days0)
"""

MINUTES = """
minutes AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS isin, ts, event_id, value AS open, value AS high,
            value AS low, value AS close, CAST(1 AS BIGINT) AS volume FROM events)
"""

W = "PARTITION BY isin ORDER BY date"


def roll(agg: str, x: str, n: int, least: int | None = None, prior: bool = False, over: str = W) -> str:
    """SQL of a rolling aggregate with a minimum count."""
    frame = f"ROWS BETWEEN {n if prior else n - 1} PRECEDING AND {'1 PRECEDING' if prior else 'CURRENT ROW'}"
    w = f"OVER ({over} {frame})"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {agg}({x}) {w} END"
