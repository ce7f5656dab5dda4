"""Market-wide state per date: gates with memory, thrusts, oscillators and the index block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import flag, holds, month_start, pct, ratio
from ..functions.events import fresh_after_quiet, rows_since, schmitt
from ..functions.ewm import ewm_mean_adjusted, ewm_scan, span_alpha
from ..functions.windows import CALENDAR as D, PANEL

# Fixed values of the market gate.
GATE_ON, GATE_OFF = 50.0, 40.0
THRUST_HIGH, THRUST_LOW, THRUST_SPAN, THRUST_SESSIONS = 0.615, 0.40, 10, 126
VIX_YEAR = 252
FRESH_RULES = {"trend_stack": "trend_stack", "momentum_leaders": "momentum_leaders"}


def advance_decline(panel: DataFrame) -> DataFrame:
    """Per date: advances, declines and the share of known names above their 50-session average."""
    panel = panel.withColumn("__ret", F.col("adj_close") - PANEL.lag(F.col("adj_close")))
    above = F.when(F.col("sma_50").isNotNull(), holds(F.col("adj_close") > F.col("sma_50")).cast("double"))
    return panel.groupBy("date").agg(
        F.count_if(holds(F.col("__ret") > 0)).alias("adv"), F.count_if(holds(F.col("__ret") < 0)).alias("dec"),
        (F.avg(above) * 100).alias("b50"))


def gate_series(day: DataFrame, window: int = THRUST_SESSIONS) -> DataFrame:
    """``mkt_breadth_50`` and ``mkt_gate_on`` = two-threshold breadth gate OR an open thrust window."""
    day = day.withColumn("__adr", ratio(F.col("adv"), F.col("adv") + F.col("dec")))
    day = ewm_scan(day, {"zweig_ema": ("__adr", span_alpha(THRUST_SPAN))}, D)
    ema = F.col("zweig_ema")
    low_before = F.min(ema).over(D.frame(10, prior=True))
    fires = (D.row() > 10) & holds(ema > THRUST_HIGH) & holds(low_before < THRUST_LOW)
    day = day.withColumn("thrust", fires.cast("int"))
    day = day.withColumns({
        "hysteresis": schmitt(F.col("b50"), GATE_ON, GATE_OFF),
        "thrust_on": F.max("thrust").over(D.frame(window))})
    gate = holds(F.col("hysteresis") == 1) | (F.col("thrust_on") == 1)
    return day.withColumns({"mkt_breadth_50": F.col("b50"), "mkt_gate_on": gate.cast("int")}).drop("__adr")


def index_columns(index_bars: DataFrame, volatility: str, benchmark: str, year: int = VIX_YEAR) -> DataFrame:
    """Volatility level and its one-year percentile, and the benchmark's 20-session range."""
    v = index_bars.filter(F.col("index_name") == volatility).select("date", F.col("close").alias("mkt_vix"))
    v = v.withColumn("mkt_vix_pctile_1y", D.rank_in_window(F.col("mkt_vix"), year))
    n = index_bars.filter(F.col("index_name") == benchmark)
    n = n.select("date", pct(D.highest(F.col("high"), 20), D.lowest(F.col("low"), 20)).alias("mkt_nifty_range_20d"))
    return v.join(n, "date", "full")


def attach_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Market columns on every row of their date. The date table holds one row per session, so it is sent whole."""
    return panel.join(F.broadcast(market), "date", "left")


def add_fresh_flags(df: DataFrame, expressions: dict[str, str], quiet: int = 10) -> DataFrame:
    """``fresh_<name>`` = 1 on the first true row after ``quiet`` false rows."""
    df = df.withColumns({f"__st_{n}": holds(F.expr(e)) for n, e in expressions.items()})
    df = df.withColumns({f"fresh_{n}": fresh_after_quiet(F.col(f"__st_{n}"), quiet).cast("int") for n in expressions})
    return df.drop(*[f"__st_{n}" for n in expressions])


def oscillators(day: DataFrame) -> DataFrame:
    """Ratio-adjusted oscillator and summation, advance/decline line, averaged new highs minus new lows."""
    net = ratio(F.col("adv") - F.col("dec"), F.col("adv") + F.col("dec"))
    day = day.withColumns({"__net": net, "__rana": net * 1000})
    day = ewm_scan(day, {"__e19": ("__rana", span_alpha(19)), "__e39": ("__rana", span_alpha(39))}, D)
    day = day.withColumn("mcc_osc", F.col("__e19") - F.col("__e39"))
    spread = ratio(F.col("nh") - F.col("nl"), F.col("n")) * 100
    day = day.withColumns({"mcc_sum": F.sum("mcc_osc").over(D.so_far()), "ad_line": F.sum("__net").over(D.so_far()),
                           "nhnl_10": D.mean(spread, 10), "nhnl_20": D.mean(spread, 20, 15)})
    return day.withColumns({
        "mcc_sum_rising": F.when(D.lag(F.col("mcc_sum"), 5).isNotNull(), flag(F.col("mcc_sum") > D.lag(F.col("mcc_sum"), 5))),
        "ad_line_sma50": D.mean(F.col("ad_line"), 50)}).drop("__net", "__rana", "__e19", "__e39")


def sustained_gate(day: DataFrame, sessions: int = 10) -> DataFrame:
    """Off only after ``sessions`` straight sessions with breadth below half; null until they exist."""
    below = F.when(F.col("b50").isNotNull(), (F.col("b50") < 50).cast("double"))
    run = D.total(below, sessions)
    return day.withColumn("b50_sustained_on", F.when(run.isNotNull(), (run < sessions).cast("int")))


def breadth_thrust(day: DataFrame, span: int = 10) -> DataFrame:
    """The bias-corrected exponential average of the advance ratio."""
    return ewm_mean_adjusted(day, "adv_ratio", "breadth_thrust_10", span, D)


def washout(day: DataFrame) -> DataFrame:
    """Lowest breadth of the last 20 sessions."""
    return day.withColumn("mkt_washout", D.lowest(F.col("b50"), 20, 5))


def low_age(df: DataFrame) -> DataFrame:
    """Sessions since the 52-week low (at most 250) and the depth of the 52-week range."""
    new_low = holds(F.col("adj_low") <= F.col("low_52w") + 1e-9)
    since = rows_since(new_low)
    return df.withColumns({"bars_since_52w_low": F.when(since.isNotNull(), F.least(since, F.lit(250))),
                           "dd_depth_52w": pct(F.col("low_52w"), F.col("high_52w"))})


def trend_block(index: DataFrame, prefix: str) -> DataFrame:
    """Trend, return, drawdown and volatility columns of one index series (date, close)."""
    x = F.col("close")
    index = index.withColumn("__ret", ratio(x, D.lag(x)) - 1)
    columns: dict[str, Column] = {}
    for n in (20, 50, 200):
        columns[f"{prefix}_vs_{n}dma"] = pct(x, D.mean(x, n))
        columns[f"{prefix}_above_{n}dma"] = flag(x > D.mean(x, n))
    for n in (5, 20, 60):
        columns[f"{prefix}_ret_{n}d"] = pct(x, D.lag(x, n))
    columns[f"{prefix}_dd_252"] = pct(x, D.highest(x, 252))
    columns[f"{prefix}_rvol_20"] = D.std(F.col("__ret"), 20) * 252 ** 0.5 * 100
    index = index.withColumns({"__m20": D.mean(x, 20)}).withColumns(columns)
    slope = pct(F.col("__m20"), D.lag(F.col("__m20"), 10))
    return index.withColumn(f"{prefix}_20dma_slope", slope).select("date", *columns, f"{prefix}_20dma_slope")


def volatility_block(index: DataFrame, year: int = VIX_YEAR) -> DataFrame:
    """Level, change, distance and percentile of a volatility series (date, close)."""
    v = F.col("close")
    return index.select(
        "date", v.alias("vix"), pct(v, D.lag(v, 5)).alias("vix_chg_5d"), pct(v, D.mean(v, 20)).alias("vix_vs_20dma"),
        D.rank_in_window(v, year).alias("vix_pctile_1y"), flag(v > 15).alias("vix_above_15"), flag(v > 20).alias("vix_above_20"),
        flag(v > D.mean(v, 10) * 1.2).alias("vix_spike"))


def ten_month_average(index: DataFrame) -> DataFrame:
    """Mean of the last nine completed month-end closes and today's close (date, close -> faber_sma10m)."""
    month = index.groupBy(month_start(F.col("date")).alias("__mo")).agg(F.max_by("close", "date").alias("__end"))
    w = Window.partitionBy(F.lit(0)).orderBy("__mo").rowsBetween(-9, -1)
    month = month.select("__mo", F.when(F.count("__end").over(w) == 9, F.sum("__end").over(w)).alias("__nine"))
    joined = index.withColumn("__mo", month_start(F.col("date"))).join(month, "__mo", "left")
    average = (F.col("__nine") + F.col("close")) / 10
    return joined.select("date", "close", average.alias("faber_sma10m"),
                         F.when(average.isNotNull(), (F.col("close") > average).cast("int")).alias("above_10m"))


def calendar_flags(calendar: DataFrame) -> DataFrame:
    """Day and month parts, turn of month, expiry week, results season and week end of a session calendar."""
    month = Window.partitionBy("__mo").orderBy("date")
    whole = Window.partitionBy("__mo")
    day = F.dayofmonth("date")
    df = calendar.select("date").distinct().withColumn("__mo", month_start(F.col("date")))
    df = df.withColumns({
        "dow": F.weekday("date"), "month": F.month("date"), "iso_week": F.weekofyear("date"),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("date")), "quarter": F.quarter("date"), "year": F.year("date"),
        "__pos": F.row_number().over(month), "__n": F.count(F.lit(1)).over(whole)})
    # Expiry week: the five days ending on each month's last Thursday session.
    expiry = (calendar.filter(F.weekday("date") == 3).groupBy(month_start(F.col("date")).alias("__mo"))
              .agg(F.max("date").alias("__thu")).select(F.explode(F.sequence(F.date_sub("__thu", 4), F.col("__thu"))).alias("date"))
              .distinct().withColumn("__exp", F.lit(1)))
    df = df.join(expiry, "date", "left")
    season = ((day.between(12, 31)) & F.month("date").isin(1, 4, 7, 10)) | ((day <= 15) & F.month("date").isin(2, 5, 8, 11))
    next_date = D.lead(F.col("date"))
    return df.withColumns({
        "turn_of_month": flag((F.col("__pos") <= 3) | (F.col("__pos") >= F.col("__n") - 1)),
        "expiry_week": F.coalesce(F.col("__exp"), F.lit(0)),
        "earnings_season": flag(season),
        "week_end": (F.coalesce(F.trunc(next_date, "week") != F.trunc("date", "week"), F.lit(True))).cast("int"),
    }).drop("__mo", "__pos", "__n", "__exp")
