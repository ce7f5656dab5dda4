"""Quality gate: structural checks, unexplained jumps, contamination, cross-source agreement, causality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import holds, pct, ratio
from ..functions.windows import PANEL as S
from ..schema import ADJ_BLOCK, KEYS, RAW_BLOCK

# Fixed values of the gate.
JUMP_PCT, EXPLAIN_DAYS = 25.0, 4
CONTAMINATED_AFTER, CONTAMINATED_BEFORE = 250, 20
TICK = 1e-9
SPLIT_RATIOS = [1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0]


class QualityError(ValueError):
    """A frame that must not be written."""


def block_defects(block: Sequence[str]) -> dict[str, Column]:
    """Named defects of one OHLC block; a null price is not a defect here."""
    o, h, l, c = (F.col(n) for n in block)
    return {
        "high_below_low": holds(h < l),
        "not_positive": holds((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)),
        "outside_range": holds((o > h + TICK) | (c > h + TICK) | (o < l - TICK) | (c < l - TICK)),
    }


def structural_counts(bars: DataFrame) -> DataFrame:
    """One row of defect counts: the write-time validation."""
    checks: dict[str, Column] = {}
    complete = F.lit(False)
    for label, block in (("raw", RAW_BLOCK), ("adj", ADJ_BLOCK)):
        if all(n in bars.columns for n in block):
            checks |= {f"{label}_{n}": x for n, x in block_defects(block).items()}
            filled = F.lit(True)
            for n in block:
                filled = filled & F.col(n).isNotNull()
            complete = complete | filled
    checks["no_complete_block"] = ~complete
    checks["null_key"] = F.col("isin").isNull() | (F.trim("isin") == "") | F.col("date").isNull()
    if "volume" in bars.columns:
        checks["negative_volume"] = holds(F.col("volume") < 0)
    counts = bars.agg(*[F.count_if(x).alias(n) for n, x in checks.items()])
    return counts.crossJoin(duplicate_keys(bars, KEYS["bars"]).agg(F.count(F.lit(1)).alias("duplicate_keys")))


def assert_valid(bars: DataFrame) -> None:
    """Raise when any structural count is above zero (one aggregate row is read)."""
    bad = {k: v for k, v in structural_counts(bars).first().asDict().items() if v}
    if bad:
        raise QualityError(f"bars rejected: {bad}")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def price_jumps(bars: DataFrame, actions: DataFrame | None = None, threshold: float = JUMP_PCT,
                window_days: int = EXPLAIN_DAYS) -> DataFrame:
    """Single-session moves beyond ``threshold`` %, and whether an action within some days explains them.

    The tolerance join is an equi join: every action is repeated for each of its 2w+1 covered days.
    """
    moves = bars.withColumn("move_pct", pct(F.col("adj_close"), S.lag(F.col("adj_close"))))
    jumps = moves.filter(F.abs("move_pct") > threshold).select("isin", "date", "adj_close", "move_pct")
    if actions is None:
        return jumps.withColumn("explained", F.lit(False))
    days = F.sequence(F.date_sub("ex_date", window_days), F.date_add("ex_date", window_days))
    covered = actions.select("isin", F.explode(days).alias("date")).distinct().withColumn("explained", F.lit(True))
    return jumps.join(covered, ["isin", "date"], "left").withColumn("explained", F.coalesce("explained", F.lit(False)))


def with_contamination(panel: DataFrame, actions: DataFrame | None = None, threshold: float = JUMP_PCT,
                       after: int = CONTAMINATED_AFTER, before: int = CONTAMINATED_BEFORE) -> DataFrame:
    """``contaminated``: an unexplained jump lies within the last ``after`` or the next ``before`` sessions."""
    panel = panel.withColumn("__move", F.abs(pct(F.col("adj_close"), S.lag(F.col("adj_close")))) > threshold)
    if actions is not None:
        days = F.sequence(F.date_sub("ex_date", EXPLAIN_DAYS), F.date_add("ex_date", EXPLAIN_DAYS))
        covered = actions.select("isin", F.explode(days).alias("date")).distinct().withColumn("__ok", F.lit(True))
        panel = panel.join(covered, ["isin", "date"], "left")
        bad = holds(F.col("__move")) & F.col("__ok").isNull()
    else:
        bad = holds(F.col("__move"))
    panel = panel.withColumn("__bad", bad.cast("int"))
    near = F.max("__bad").over(S.spec.rowsBetween(-after, before))
    return panel.withColumn("contaminated", near == 1).drop("__move", "__bad", "__ok")


def stale(block: Sequence[str] = tuple(ADJ_BLOCK)) -> Column:
    o, h, l, c = (F.col(n) for n in block)
    return holds((o == h) & (h == l) & (l == c))


def junk(block: Sequence[str] = tuple(ADJ_BLOCK)) -> Column:
    """Stale and untraded."""
    return stale(block) & (F.coalesce(F.col("volume"), F.lit(0)) <= 0)


def report(bars: DataFrame, actions: DataFrame | None = None, threshold: float = JUMP_PCT) -> DataFrame:
    """Everything the gate found, as one row of counters."""
    jumps = price_jumps(bars, actions, threshold).agg(
        F.count(F.lit(1)).alias("jumps_total"), F.count_if(~F.col("explained")).alias("jumps_unexplained"),
        F.countDistinct(F.when(~F.col("explained"), F.col("isin"))).alias("jump_symbols"))
    marked = with_contamination(bars, actions, threshold)
    o, h, l, c = (F.col(n) for n in ADJ_BLOCK)
    sound = (h >= l) & (h >= o - TICK) & (h >= c - TICK) & (l <= o + TICK) & (l <= c + TICK)
    positive = (o > 0) & (h > 0) & (l > 0) & (c > 0)
    counters = marked.agg(
        F.count(F.lit(1)).alias("bars"), F.countDistinct("isin").alias("symbols"),
        F.count_if(~holds(sound)).alias("ohlc_violations"), F.count_if(~holds(positive)).alias("non_positive"),
        F.count_if(F.col("contaminated")).alias("contaminated_rows"),
        F.count_if(stale()).alias("stale_bars"), F.count_if(junk()).alias("junk_bars"))
    extra = duplicate_keys(bars, KEYS["bars"]).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
    out = counters.crossJoin(jumps).crossJoin(extra)  # three single-row frames
    return out.withColumn("contaminated_pct", ratio(F.col("contaminated_rows"), F.col("bars")) * 100)


def integrity_battery(bars: DataFrame, gap_days: int = 5) -> DataFrame:
    """Checks as rows (name, bad_count): structure, coverage, plausibility, calendar gaps, weekend sessions."""
    calendar = bars.select("date").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    gaps = calendar.withColumn("__g", F.datediff("date", F.lag("date").over(w))).agg(
        F.count_if(F.col("__g") > gap_days).alias("calendar_gaps"), F.count_if(F.weekday("date") >= 5).alias("weekend_sessions"))
    found = block_defects(ADJ_BLOCK)
    move = F.abs(pct(F.col("adj_close"), S.lag(F.col("adj_close"))))
    body = bars.withColumn("__m", move).agg(
        *[F.count_if(x).alias(n) for n, x in found.items()],
        F.count_if(F.col("adj_close").isNull()).alias("missing_adjusted"),
        F.count_if(F.col("volume").isNull()).alias("missing_volume"),
        F.count_if(F.col("__m") > 90).alias("implausible_move"))
    wide = body.crossJoin(gaps)
    return wide.unpivot([], wide.columns, "name", "bad_count")


def source_agreement(a: DataFrame, b: DataFrame, column: str, tolerance: float = 0.005) -> DataFrame:
    """Rows both sources carry, the relative error and whether it is within tolerance."""
    right = b.select("isin", "date", F.col(column).alias("value_b"))
    joined = a.select("isin", "date", F.col(column).alias("value_a")).join(right, ["isin", "date"])
    error = F.abs(ratio(F.col("value_a"), F.col("value_b")) - 1)
    return joined.withColumns({"rel_err": error, "agrees": holds(error <= tolerance)})


def split_ratio(move: Column, tolerance: float = 0.02) -> Column:
    """The known split ratio a price ratio matches, or null."""
    out = F.lit(None).cast("double")
    for r in SPLIT_RATIOS:
        out = F.when(F.abs(move / r - 1) <= tolerance, F.lit(r)).otherwise(out)
    return out


def mismatches(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """Per column: rows where two frames disagree (missing on one side counts as one)."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in columns])
    on = None
    for k in key:
        part = F.col(k) == F.col(f"__{k}")
        on = part if on is None else on & part
    both = left.select(*key, *columns).join(r, on, "full")
    counts = []
    for c in columns:
        x, y = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
        close = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * rtol + 1e-12
        counts.append(F.count_if(~((x.isNull() & y.isNull()) | holds(close))).alias(c))
    wide = both.agg(*counts)
    return wide.unpivot([], list(columns), "field", "mismatches")


def causality_audit(bars: DataFrame, build, cut, columns: Sequence[str]) -> DataFrame:
    """Recompute on rows up to ``cut`` and compare the rows at the cut: a difference means a column saw the future."""
    at_cut = build(bars).filter(F.col("date") == F.lit(cut))
    truncated = build(bars.filter(F.col("date") <= F.lit(cut))).filter(F.col("date") == F.lit(cut))
    return mismatches(at_cut, truncated, ["isin", "date"], columns)
