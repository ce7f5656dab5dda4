"""Validity-interval dimensions: symbol history, index membership, point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def live_on(date, start: str = "from_date", stop: str = "to_date"):
    """Half-open validity: from <= date < to, an open end being infinite."""
    return (F.col(start) <= date) & (F.col(stop).isNull() | (F.col(stop) > date))


def members_on(membership: DataFrame, as_of: DataFrame) -> DataFrame:
    """Members on one date; ``as_of`` is a single-row frame with that column."""
    return membership.crossJoin(F.broadcast(as_of)).filter(live_on(F.col("as_of"))).drop("as_of")


def point_in_time(panel: DataFrame, membership: DataFrame, date: str = "date") -> DataFrame:
    """Panel rows with the indices they belonged to on their own date: an equi join on the key, then the interval test."""
    m = membership.select(F.col("isin").alias("__i"), "index_name", "from_date", "to_date")
    joined = panel.join(m, (F.col("isin") == F.col("__i")) & live_on(F.col(date)))
    return joined.drop("__i", "from_date", "to_date")


BUCKET_DAYS = 512
PART_ROWS = 200_000


def _in_buckets(probes: DataFrame, history: DataFrame, key: str, part_rows: int) -> DataFrame:
    """Probes (key, date, ...) with the history rows of their key that are live on their date: an interval join as an equi join.

    Intervals are cut into buckets of ``BUCKET_DAYS``, so a probe meets the intervals that touch its bucket and not all of its key.
    A key with more than ``part_rows`` interval pieces is split into parts by a hash of the row, and only its probes are
    repeated, once per part. Probes without a live interval leave the join.
    """
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("int")
    last = probes.agg(F.max(bucket(F.col("date"))).alias("__last"))  # one row: open intervals reach the last bucket asked for
    cut = history.withColumnRenamed(key, "__key").crossJoin(last).withColumn("__stop", F.least(F.coalesce(bucket(F.date_sub("to_date", 1)), F.col("__last")), F.col("__last")))
    cut = cut.filter(bucket(F.col("from_date")) <= F.col("__stop")).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("from_date")), F.col("__stop")))).drop("__last", "__stop")
    parts = cut.groupBy("__key").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("__parts")).filter("__parts > 1")
    spread = F.xxhash64("from_date", *[c for c in history.columns if c not in (key, "from_date", "to_date")])
    cut = cut.join(parts, "__key", "left").withColumn("__part", F.pmod(spread, F.coalesce("__parts", F.lit(1)))).drop("__parts")
    asked = probes.join(parts.withColumnRenamed("__key", key), key, "left").withColumn("__bucket", bucket(F.col("date")))
    asked = asked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    met = asked.join(cut, (F.col(key) == F.col("__key")) & (asked["__bucket"] == cut["__bucket"]) & (asked["__part"] == cut["__part"]) & live_on(F.col("date")))
    return met.drop("__key", "__bucket", "__part")


def symbol_on(probes: DataFrame, history: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Symbol per (isin, date): the latest live interval, else the earliest known symbol, else null."""
    asked = probes.select("isin", "date").distinct()
    live = _in_buckets(asked, history.select("isin", "symbol", "from_date", "to_date"), "isin", part_rows)
    live = live.groupBy("isin", "date").agg(F.max_by("symbol", "from_date").alias("__live"))
    first = history.groupBy("isin").agg(F.min_by("symbol", "from_date").alias("__first"))
    return asked.join(live, ["isin", "date"], "left").join(first, "isin", "left").select("isin", "date", F.coalesce("__live", "__first").alias("symbol"))


def isins_for_symbol(probes: DataFrame, history: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(symbol, date, isin): a row for every isin that traded under a symbol on a date; several mean the symbol was reused.

    Rows, not a set: a symbol may have any number of isins. A probe without any keeps one row with a null isin.
    """
    asked = probes.select("symbol", "date").distinct()
    found = _in_buckets(asked, history.select("isin", "symbol", "from_date", "to_date"), "symbol", part_rows).select("symbol", "date", "isin").distinct()
    return asked.join(found, ["symbol", "date"], "left")


def reused_symbols(history: DataFrame) -> DataFrame:
    """History rows of symbols that map to more than one isin."""
    many = history.groupBy("symbol").agg(F.countDistinct("isin").alias("n")).filter("n > 1").select("symbol")
    return history.join(many, "symbol", "left_semi")


def symbol_master(sightings: DataFrame) -> DataFrame:
    """Bounds and latest non-empty attributes per key (sightings: isin, symbol, name, series, date)."""
    def latest(c: str):
        filled = F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
        return F.max_by(filled, F.when(filled.isNotNull(), F.col("date"))).alias(c)

    return sightings.filter("isin is not null and symbol is not null").groupBy("isin").agg(
        latest("symbol"), latest("name"), latest("series"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


def symbol_history(sightings: DataFrame) -> DataFrame:
    """Intervals from sightings: change points of the symbol per key become [from, to) rows.

    Sightings of one key and day are reduced first (the last symbol wins), so a key holds at most one row
    per session.
    """
    day = sightings.filter("isin is not null and symbol is not null").groupBy("isin", "date").agg(F.max("symbol").alias("symbol"))
    w = Window.partitionBy("isin").orderBy("date")
    changed = F.coalesce(F.lag("symbol").over(w) != F.col("symbol"), F.lit(True))
    starts = day.withColumn("__c", changed).filter("__c")
    return starts.select("isin", "symbol", F.col("date").alias("from_date"), F.lead("date").over(w).alias("to_date"))


def renames(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("isin").orderBy("from_date")
    return history.withColumn("old_symbol", F.lag("symbol").over(w)).filter("old_symbol is not null").select(
        "isin", "old_symbol", F.col("symbol").alias("new_symbol"), F.col("from_date").alias("date"))


def merge_sightings(master: DataFrame, history: DataFrame, sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold new sightings into a stored master and history: stored intervals count as sightings at their starts."""
    seen = history.select("isin", "symbol", F.col("from_date").alias("date"))
    everything = seen.unionByName(sightings.select("isin", "symbol", "date"))
    fresh = symbol_master(sightings).select("isin", *[F.col(c).alias(f"__{c}") for c in ("symbol", "name", "series", "first_seen", "last_seen")])
    old = master.withColumn("__has", F.lit(True))
    newer = F.coalesce(F.col("__last_seen") >= F.col("last_seen"), F.lit(True)) & F.col("__symbol").isNotNull()
    merged = old.join(fresh, "isin", "full").select(
        "isin", F.when(newer, F.col("__symbol")).otherwise(F.col("symbol")).alias("symbol"),
        F.coalesce("__name", "name").alias("name"), F.coalesce("__series", "series").alias("series"),
        F.least("first_seen", "__first_seen").alias("first_seen"), F.greatest("last_seen", "__last_seen").alias("last_seen"))
    return merged, symbol_history(everything)


def apply_snapshot(membership: DataFrame, snapshot: DataFrame, index_name: str, as_of: str, allow_backdate: bool = False) -> DataFrame:
    """Fold one constituent list, observed on ``as_of``, into the membership history.

    A full outer join of open rows and the snapshot decides each key: gone closes at ``as_of``, new opens,
    kept carries the new symbol. Closed rows and other indices pass through. Re-applying is a no-op.
    ``change`` tells what happened (added, removed, renamed, unchanged; null for untouched history).
    """
    day = F.lit(as_of).cast("date")
    mine = F.col("index_name") == index_name
    closed = membership.filter(~mine | F.col("to_date").isNotNull()).withColumn("change", F.lit(None).cast("string"))
    open_rows = membership.filter(mine & F.col("to_date").isNull())
    if not allow_backdate:
        latest = membership.filter(mine).agg(F.max(F.greatest(F.col("from_date"), F.coalesce("to_date", "from_date"))).alias("__latest"))
        open_rows = open_rows.crossJoin(F.broadcast(latest)).withColumn(
            "from_date", F.when(day < F.col("__latest"), F.raise_error(F.lit(f"snapshot {as_of} predates recorded history")).cast("date"))
            .otherwise(F.col("from_date"))).drop("__latest")
    snap = snapshot.groupBy("isin").agg(F.first("symbol").alias("__symbol"), F.first("name").alias("__name")) if "name" in snapshot.columns \
        else snapshot.groupBy("isin").agg(F.first("symbol").alias("__symbol"), F.lit(None).cast("string").alias("__name"))
    joined = open_rows.withColumn("__open", F.lit(True)).join(snap.withColumn("__in", F.lit(True)), "isin", "full")
    added, removed = F.col("__open").isNull(), F.col("__in").isNull()
    changed = (F.when(added, "added").when(removed, "removed")
               .when(F.col("symbol") != F.col("__symbol"), "renamed").otherwise("unchanged"))
    named = F.when(F.trim(F.coalesce("__name", F.lit(""))) != "", F.col("__name"))
    current = joined.select(
        F.lit(index_name).alias("index_name"), "isin",
        F.when(removed, F.col("symbol")).otherwise(F.col("__symbol")).alias("symbol"),
        F.when(removed, F.col("name")).otherwise(F.coalesce(named, F.col("name"))).alias("name"),
        F.when(added, day).otherwise(F.col("from_date")).alias("from_date"),
        F.when(removed, day).alias("to_date"), changed.alias("change"))
    return closed.select(current.columns).unionByName(current)


def membership_changes(membership: DataFrame) -> DataFrame:
    joins = membership.select("index_name", F.col("from_date").alias("date"), F.lit("join").alias("event"), "isin", "symbol")
    leaves = membership.filter("to_date is not null").select("index_name", F.col("to_date").alias("date"), F.lit("leave").alias("event"), "isin", "symbol")
    return joins.unionByName(leaves)
