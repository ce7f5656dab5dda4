"""Session calendars: expected days, gaps, request windows, period shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE(:a), DATE(:b))) AS date", args={"a": start, "b": end})
    return days.filter(F.weekday("date") < 5)


def expected_sessions(span: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays of a one-row (start, end) frame, minus holidays."""
    days = span.select(F.explode(F.sequence("start", "end")).alias("date")).filter(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays.select("date"), "date", "left_anti")


def missing_dates(expected: DataFrame, have: DataFrame, status: DataFrame | None = None, retry_errors: bool = True) -> DataFrame:
    """Expected sessions without raw bars and without a "no data" verdict; failed days come back unless told otherwise."""
    out = expected.join(have.select("date").distinct(), "date", "left_anti")
    if status is not None:
        settled = ["no_data"] if retry_errors else ["no_data", "error"]
        out = out.join(status.filter(F.col("status").isin(settled)).select("date").distinct(), "date", "left_anti")
    return out


def month_windows(spans: DataFrame) -> DataFrame:
    """Split (start, end) into calendar months clipped to the range."""
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    df = spans.withColumn("__m", F.explode(months))
    return df.select(*spans.columns, F.greatest("start", "__m").alias("from_date"), F.least("end", F.last_day("__m")).alias("to_date"))


def decade_windows(spans: DataFrame) -> DataFrame:
    """Split (start, end) into windows of nine years and eleven months plus a day's step."""
    # A window is at least 119 months long, so the span bounds how many there are.
    df = spans.filter("start <= end").withColumn("__i", F.explode(F.expr("sequence(0, cast(months_between(end, start) / 119 AS int))")))
    # Each window starts the day after the previous end: i full steps of (119 months + 1 day).
    start = F.expr("aggregate(sequence(1, __i), start, (acc, x) -> date_add(add_months(acc, 119), 1))")
    df = df.withColumn("from_date", F.when(F.col("__i") == 0, F.col("start")).otherwise(start))
    df = df.withColumn("to_date", F.least(F.add_months("from_date", 119), F.col("end")))
    return df.filter(F.col("from_date") <= F.col("end")).select(*spans.columns, "from_date", "to_date")


def fill_to_calendar(series: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """A wide date table on the session calendar, holes carried forward. One row per session."""
    from ..functions.windows import CALENDAR as D
    joined = calendar.select("date").distinct().join(series, "date", "left")
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(D.so_far()) for c in columns})


def pivot_index(index_bars: DataFrame, names: list[str], value: str = "close") -> DataFrame:
    """Long (index_name, date, value) to one column per named index."""
    cells = [F.max(F.when(F.col("index_name") == n, F.col(value))).alias(n.lower().replace(" ", "_")) for n in names]
    return index_bars.groupBy("date").agg(*cells)


def previous_year_levels(bars: DataFrame) -> DataFrame:
    """High, low and close of the previous calendar year on every row: aggregate, shift the key, equi join."""
    year = F.year("date")
    levels = bars.groupBy("isin", year.alias("__y")).agg(
        F.max("adj_high").alias("py_high"), F.min("adj_low").alias("py_low"), F.max_by("adj_close", "date").alias("py_close"))
    levels = levels.withColumn("__y", F.col("__y") + 1)
    pivot = (F.col("py_high") + F.col("py_low") + F.col("py_close")) / 3
    return bars.withColumn("__y", year).join(levels, ["isin", "__y"], "left").drop("__y").withColumn("py_pivot", pivot)


