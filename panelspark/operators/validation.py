"""Validation statistics: split samples, clustered errors, rank correlation, binned tables, filter search.

All regressions are closed forms over sums: a group of any size is reduced by partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import holds, ratio
from ..functions.order_stats import quantile_columns, ranks, row_numbers
from ..session import cut_lineage
from .stats import share


def clustered_slope(df: DataFrame, by: Sequence[str], y: str, x: str, cluster: str, least: int = 10) -> DataFrame:
    """Slope of y = a + b x with its cluster-robust t.

    x is centred on its group's mean first, so a small spread around a large value is kept. Then two aggregations: the
    normal equations per group, and per cluster the score sums (sum e, sum e x), which are linear in the cluster's own sums
    once (a, b) are known. Groups with fewer than ``least`` rows or no spread keep their row, with null slope and t.
    """
    known = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumns({"__y": F.col(y).cast("double"), "__x": F.col(x).cast("double")})
    centre = known.groupBy(*[F.col(b).alias(f"__k_{b}") for b in by]).agg(F.avg("__x").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    same = [F.col(b).eqNullSafe(F.col(f"__k_{b}")) for b in by]
    # No spread: every row is exactly the centre, whatever the mean was rounded to.
    known = (known.join(centre, same) if by else known.crossJoin(centre)).withColumn("__x", F.when(F.col("__lo") < F.col("__hi"), F.col("__x") - F.col("__c")).otherwise(0.0))
    cells = known.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"),
        F.sum(F.col("__x") * F.col("__y")).alias("sxy"))
    total = cells.groupBy(*by).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    det = F.col("t_n") * F.col("t_sxx") - F.col("t_sx") * F.col("t_sx")
    total = total.withColumn("det", F.when((F.col("t_n") >= least) & (det > 0), det))
    total = total.withColumn("b", (F.col("t_n") * F.col("t_sxy") - F.col("t_sx") * F.col("t_sy")) / F.col("det"))
    total = total.withColumn("a", (F.col("t_sy") - F.col("b") * F.col("t_sx")) / F.col("t_n"))
    joined = cells.join(total, list(by)) if by else cells.crossJoin(total)
    u0 = F.col("sy") - F.col("a") * F.col("n") - F.col("b") * F.col("sx")
    u1 = F.col("sxy") - F.col("a") * F.col("sx") - F.col("b") * F.col("sxx")
    # Second row of the inverse normal matrix applied to each cluster's score.
    z = (F.col("t_n") * u1 - F.col("t_sx") * u0) / F.col("det")
    out = joined.groupBy(*by).agg(F.first("t_n").alias("n"), F.first("b").alias("slope"), F.sum(z * z).alias("__v"), F.count(F.lit(1)).alias("clusters"))
    return out.select(*by, "n", "clusters", "slope", F.when(F.col("__v") > 0, F.col("slope") / F.sqrt("__v")).alias("t_cluster"))


def clustered_mean(df: DataFrame, by: Sequence[str], value: str, cluster: str = "date") -> DataFrame:
    """t of the mean with one observation per cluster; 0 with fewer than three clusters or no spread."""
    days = df.groupBy(*by, cluster).agg(F.avg(value).alias("m"))
    out = days.groupBy(*by).agg(F.count("m").alias("days"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("__s"))
    t = F.when((F.col("days") > 2) & (F.col("__s") > 0), F.col("mean") / (F.col("__s") / F.sqrt("days"))).otherwise(0.0)
    return out.select(*by, "days", "mean", t.alias("t"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: power series up to 2.5, continued fraction beyond.

    Both run as a fold over a short constant sequence, so the expression stays small.
    """
    root_pi = 3.141592653589793 ** 0.5
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * x * x * F.lit(2.0) / (n * 2 + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda acc: acc["total"])
    series = F.lit(1.0) - F.exp(-x * x) * total * (2.0 / root_pi)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2 / acc)
    return F.when(x < 2.5, series).otherwise(F.exp(-x * x) / (fraction * root_pi))


def spearman(df: DataFrame, ident: Sequence[str], by: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation, its two-sided normal p and the sample size, per group."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*ident, *by, x, y]))
    place = ranks(known, list(dict.fromkeys([*ident, *by])), by, {"__rx": x, "__ry": y}, pct=False)
    out = place.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("rho") * F.col("rho")))
    out = out.withColumn("__t", F.when(F.abs("rho") < 1, F.abs(t) / F.sqrt(F.lit(2.0))))
    return out.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(erfc(F.col("__t")))).drop("__t")


def welch(df: DataFrame, by: Sequence[str], value: str, group: Column) -> DataFrame:
    """t of the difference of two means with unequal variances (group true minus false)."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    out = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"))
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    usable = (F.col("n1") >= 2) & (F.col("n0") >= 2) & (error > 0)
    return out.select(*by, "n1", "n0", (F.col("m1") - F.col("m0")).alias("diff"), F.when(usable, (F.col("m1") - F.col("m0")) / error).alias("welch_t"))


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    return df.select(*keep, F.explode(F.array(*cells)).alias("__s")).select(*keep, "__s.feature", "__s.x")


def bin_edges(long: DataFrame, inner: Sequence[float], sample: Column) -> DataFrame:
    """Per feature, the distinct inner quantile edges of the in-sample rows (ties collapse)."""
    wanted = {f"__q{i}": ("x", p) for i, p in enumerate(inner)}
    edges = quantile_columns(long.filter(sample), ["feature"], wanted)
    return edges.select("feature", F.array_distinct(F.array(*wanted)).alias("edges"))


def with_bins(long: DataFrame, edges: DataFrame, right_closed: bool = True) -> DataFrame:
    """Bin number from 1 by edges learned in-sample; outer bins are open-ended. Edges are one row per feature."""
    joined = long.join(F.broadcast(edges), "feature")
    passed = F.filter("edges", (lambda e: e < F.col("x")) if right_closed else (lambda e: e <= F.col("x")))
    return joined.withColumn("bin", F.when(F.col("x").isNotNull(), F.size(passed) + 1)).drop("edges")


def feature_table(binned: DataFrame, period: str = "period", value: str = "net", big_loss: float = -8.0) -> DataFrame:
    """Statistics per feature, bin and period."""
    net = F.col(value)
    gain, pain = F.sum(F.greatest(net, F.lit(0.0))), F.sum(F.greatest(-net, F.lit(0.0)))
    return binned.filter(F.col("bin").isNotNull()).groupBy("feature", period, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(net).alias("net"), share(net > 0).alias("win"), F.when(pain > 0, gain / pain).alias("pf"),
        share(net < big_loss).alias("big_loss"), F.min("x").alias("low"), F.max("x").alias("high"))


def monotonicity(table: DataFrame, period: str = "period", value: str = "net") -> DataFrame:
    """Per feature and period: rank correlation of bin number and bin mean, and top minus bottom. Bins are few."""
    w = Window.partitionBy("feature", period).orderBy(value)
    ties = Window.partitionBy("feature", period, value)
    df = table.withColumn("__r", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    order = Window.partitionBy("feature", period).orderBy("bin")
    df = df.withColumn("__b", F.row_number().over(order))
    return df.groupBy("feature", period).agg(
        F.count(F.lit(1)).alias("bins"), F.corr("__r", "__b").alias("mono"), (F.max_by(value, "bin") - F.min_by(value, "bin")).alias("top_minus_bottom"))


def promotion(rho: DataFrame, mono: DataFrame, mono_min: float = 0.5) -> DataFrame:
    """Features whose in-sample relation is significant and repeats out of sample with the same sign.

    ``rho`` and ``mono`` are per (feature, period) with period IS / OOS.
    """
    wide = rho.join(mono, ["feature", "period"]).groupBy("feature").agg(*[
        F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{p.lower()}") for c in ("rho", "p", "mono", "top_minus_bottom") for p in ("IS", "OOS")])
    sign = F.signum("rho_is")
    ok_is = (F.abs("rho_is") >= 0.03) & (F.col("p_is") < 0.05) & (F.col("mono_is") * sign >= mono_min)
    ok = (ok_is & (sign == F.signum("rho_oos")) & (sign != 0) & (F.abs("rho_oos") >= F.abs("rho_is") * 0.5)
          & (F.signum("top_minus_bottom_is") == F.signum("top_minus_bottom_oos")) & (F.col("mono_oos") * sign >= mono_min))
    return wide.withColumns({"passes_is_only": holds(ok_is).cast("int"), "promoted": holds(ok).cast("int"), "direction": sign.cast("int")})


def split_scores(df: DataFrame, by: Sequence[str], value: str, first: Column) -> DataFrame:
    """In-sample and out-of-sample means, degradation, and the place of each candidate by both (unknown last, ties by name).

    Candidates may be keys of a panel, so no window spans all of them: places come from ``row_numbers``.
    """
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    out = df.groupBy(*by).agg(F.count(a).alias("n_is"), F.count(b).alias("n_oos"), F.avg(a).alias("is_mean"), F.avg(b).alias("oos_mean"))
    scored = cut_lineage(out.withColumn("degradation", F.col("is_mean") - F.col("oos_mean")))
    best = scored.agg((F.max("is_mean") * 0.8).alias("__best"))  # one row
    ranked = scored.crossJoin(best).withColumn("near_best", holds(F.col("is_mean") >= F.col("__best")).cast("int")).drop("__best")
    for name, mean in (("is_rank", "is_mean"), ("oos_rank", "oos_mean")):
        ranked = ranked.join(row_numbers(scored, by, mean, name), list(by))
    return ranked


# ------------------------------------------------------------------ filter search
def threshold_candidates(long: DataFrame, probabilities: Sequence[float], sample: Column) -> DataFrame:
    """(candidate, feature, op, threshold): in-sample quantiles of each feature, kept above or below."""
    wanted = {f"__q{i}": ("x", p) for i, p in enumerate(probabilities)}
    edges = quantile_columns(long.filter(sample), ["feature"], wanted)
    levels = edges.select("feature", F.explode(F.array_distinct(F.array(*wanted))).alias("threshold"))
    ops = levels.withColumn("op", F.explode(F.array(F.lit(">="), F.lit("<="))))
    return ops.select(F.concat_ws(" ", "feature", "op", F.format_number("threshold", 6)).alias("candidate"), "feature", "op", "threshold")


def evaluate_filters(trades: DataFrame, long: DataFrame, candidates: DataFrame, ident: str = "sid") -> DataFrame:
    """Kept and removed results of every candidate in each half.

    Candidates are a small table (features x levels x two directions) sent to every task; each trade meets
    only the candidates of its own feature, and the result is aggregated at once.
    """
    tests = long.join(F.broadcast(candidates), "feature")
    keep = F.when(F.col("op") == ">=", F.col("x") >= F.col("threshold")).otherwise(F.col("x") <= F.col("threshold"))
    tests = tests.withColumn("__keep", holds(keep))
    k, r = F.when(F.col("__keep"), F.col("net")), F.when(~F.col("__keep"), F.col("net"))
    return tests.groupBy("candidate", "feature", "half").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(k).alias("n_kept"), F.avg(k).alias("mean_kept"), F.avg((k > 0).cast("double")).alias("win_kept"),
        F.avg(r).alias("mean_removed"), F.avg((r > 0).cast("double")).alias("win_removed"),
        F.when(-F.sum(F.when(k <= 0, k)) > 0, F.sum(F.when(k > 0, k)) / -F.sum(F.when(k <= 0, k))).alias("pf_kept"))


def passing_filters(results: DataFrame, base: DataFrame, least: int = 30) -> DataFrame:
    """Candidates that beat the unfiltered win rate and mean in both halves with enough trades; best first."""
    joined = results.join(F.broadcast(base), "half")
    good = (F.col("win_kept") > F.col("base_win")) & (F.col("mean_kept") > F.col("base_net")) & (F.col("n_kept") >= least)
    out = joined.groupBy("candidate", "feature").agg(
        F.count_if(holds(good)).alias("halves_passed"), F.min("win_kept").alias("worse_win"), F.min("mean_kept").alias("worse_mean"), F.min("n_kept").alias("worse_n"))
    return out.filter(F.col("halves_passed") == 2)


def base_rates(trades: DataFrame) -> DataFrame:
    return trades.groupBy("half").agg(F.avg((F.col("net") > 0).cast("double")).alias("base_win"), F.avg("net").alias("base_net"))


def best_per_feature(passing: DataFrame, limit: int = 8) -> DataFrame:
    """The best passing candidate of each feature, at most ``limit`` (the leaderboard feature)."""
    w = Window.partitionBy("feature").orderBy(F.col("worse_win").desc(), F.col("worse_mean").desc(), "candidate")
    top = passing.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") == 1).drop("__p")
    return top.orderBy(F.col("worse_win").desc(), F.col("worse_mean").desc(), "candidate").limit(limit)


def pair_candidates(best: DataFrame) -> DataFrame:
    """Unordered pairs of at most eight leaders (a 28-row table)."""
    a = best.select(F.col("candidate").alias("a"), F.col("feature").alias("fa"))
    b = best.select(F.col("candidate").alias("b"), F.col("feature").alias("fb"))
    return a.join(b, F.col("a") < F.col("b")).select(F.concat_ws(" AND ", "a", "b").alias("candidate"), "a", "b")


def kept_by_candidate(long: DataFrame, candidates: DataFrame, ident: str = "sid") -> DataFrame:
    """(candidate, trade) of the trades a candidate keeps."""
    tests = long.join(F.broadcast(candidates), "feature")
    keep = F.when(F.col("op") == ">=", F.col("x") >= F.col("threshold")).otherwise(F.col("x") <= F.col("threshold"))
    return tests.filter(holds(keep)).select("candidate", ident, "half", "date", "net")


def evaluate_pairs(kept: DataFrame, pairs: DataFrame, ident: str = "sid") -> DataFrame:
    """Results of AND combinations: trades kept by both sides, matched by trade id."""
    left = kept.join(F.broadcast(pairs.withColumnRenamed("candidate", "pair")), F.col("candidate") == F.col("a"))
    right = kept.select(F.col("candidate").alias("__c"), F.col(ident).alias("__id"))
    both = left.join(right, (F.col(ident) == F.col("__id")) & (F.col("b") == F.col("__c")))
    return both.groupBy(F.col("pair").alias("candidate"), "half").agg(
        F.count(F.lit(1)).alias("n_kept"), F.avg("net").alias("mean_kept"), F.avg((F.col("net") > 0).cast("double")).alias("win_kept"))


def months_active(kept: DataFrame, trades: DataFrame, least: int = 5) -> DataFrame:
    """Share of the months in which a candidate keeps at least ``least`` trades."""
    all_months = trades.agg(F.countDistinct(F.trunc("date", "month")).alias("__all"))
    months = kept.groupBy("candidate", F.trunc("date", "month").alias("mo")).agg(F.count(F.lit(1)).alias("k"))
    out = months.groupBy("candidate").agg(F.count_if(F.col("k") >= least).alias("__m"))
    return out.crossJoin(F.broadcast(all_months)).select("candidate", (F.col("__m") / F.col("__all")).alias("months_active"))


def null_probability(bins: int = 5, limit: float = 0.9) -> float:
    """Chance that two independent random orders of ``bins`` means (one per half) both correlate with their place by at
    least ``limit``, in the same direction. Up and down are equally likely, so it is twice the square of one direction's chance.
    """
    from itertools import permutations
    from math import factorial
    # rho = 1 - 6 * sum(d^2) / (n * (n^2 - 1)), so a bound on rho is a bound on the squared displacements
    most = (1 - limit) * bins * (bins * bins - 1) / 6 + 1e-9
    rising = sum(sum((place - i) ** 2 for i, place in enumerate(order)) <= most for order in permutations(range(bins)))
    return 2 * (rising / factorial(bins)) ** 2


# ------------------------------------------------------------------ gates
def evaluate_gates(trades: DataFrame, gates: DataFrame, by: Sequence[str] = ("gate", "strategy", "half")) -> DataFrame:
    """On/off results of every gate (gate, date, on): one equi join on the date, then aggregates."""
    joined = trades.join(F.broadcast(gates), "date").filter(F.col("on").isNotNull())
    a, b = F.when(F.col("on") == 1, F.col("net")), F.when(F.col("on") == 0, F.col("net"))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"), F.count(a).alias("n_on"), F.count(b).alias("n_off"), F.avg(a).alias("mean_on"), F.avg(b).alias("mean_off"),
        (F.avg((a > 0).cast("double")) * 100).alias("win_on"), (F.avg((b > 0).cast("double")) * 100).alias("win_off"), (F.avg(a) - F.avg(b)).alias("diff"))


def time_in_market(gates: DataFrame) -> DataFrame:
    return gates.groupBy("gate").agg((F.avg("on") * 100).alias("share_on"), F.count("on").alias("sessions"))


def gate_pairs(gates: DataFrame) -> DataFrame:
    """AND and OR of every pair of gates, per date (a gate table holds one row per gate and session)."""
    a = gates.select("date", F.col("gate").alias("a"), F.col("on").alias("x"))
    b = gates.select("date", F.col("gate").alias("b"), F.col("on").alias("y"))
    both = a.join(b, "date").filter(F.col("a") < F.col("b"))
    cells = F.array(F.struct(F.lit(" AND ").alias("op"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.least("x", "y")).alias("on")),
                    F.struct(F.lit(" OR ").alias("op"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("on")))
    return both.select("date", "a", "b", F.explode(cells).alias("c")).select("date", F.concat("a", "c.op", "b").alias("gate"), "c.on")


def verdict(table: DataFrame, least_win: float = 65.0) -> DataFrame:
    """TRADE when both halves are positive, ``win`` (percent) reaches its floor and the quarters pass; MAYBE without the quarters; else DROP."""
    sound = holds((F.col("h1_net") > 0) & (F.col("h2_net") > 0) & (F.col("win") >= least_win))
    return table.withColumn("verdict", F.when(sound & holds(F.col("quarter_pass") == 1), "TRADE").when(sound, "MAYBE").otherwise("DROP"))


def best_cells(cells: DataFrame) -> DataFrame:
    """Per setup, the two cells with the best worse-half net and the one with the best worse-half win rate."""
    net = Window.partitionBy("setup").orderBy(F.col("worse_net").desc(), F.col("worse_win").desc(), "cell")
    win = Window.partitionBy("setup").orderBy(F.col("worse_win").desc(), F.col("worse_net").desc(), "cell")
    ranked = cells.withColumns({"__n": F.row_number().over(net), "__w": F.row_number().over(win)})
    return ranked.filter((F.col("__n") <= 2) | (F.col("__w") == 1)).drop("__n", "__w")
