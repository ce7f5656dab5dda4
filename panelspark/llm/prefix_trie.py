"""Operator 13: the trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its name is 128 bits: the exclusive or of one hash per (place, turn), so names
of all prefixes are running values of a scan. The scan is cut by ranges of (conversation, turn): a conversation that holds a
third of all rows lies in many parts, and a part only needs the value of the parts before it.

Sums over subtrees come from the centroid decomposition of the parent edges. A component's centroid is its deepest node with
half of the component below it. What lies below the centroid is totalled and added to every node from the centroid up to the
component's top; then the centroid goes, and what it held together are components of half the size or less. Every (node,
descendant) pair is separated once, so every value is added once, after at most log2(nodes) levels, however deep the trie is.
Components of over ``PIECE`` nodes are split by joins on all executors: the number of nodes below a node follows from the
conversations that pass it, and whether one node lies below another from one lookup in the conversation that owns it.
Smaller components are dealt to bins of about ``PIECE`` nodes and decomposed there, all components of a bin at once.

Rows without conv_id are left out; null role and text are empty; turns are ordered by turn (null first), then role, then a
hash of the turn. Repeated rows are turns of their own. An empty table gives no rows. Other columns play no part. Texts of any
length enter as a hash and a number of code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import rows, store

PIECE = 20_000
CHUNK_IDS = 4096
NAME = ["p1", "p2"]
PARENT = ["q1", "q2"]
TOP = ["c1", "c2"]


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, h1, h2, chars) of every turn, pos from 0, and (conv_id, part, offset, n_turns) of every part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    coded = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(7), text, role).alias("h2"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    cut = store(coded.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turn-parts")
    parts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id").orderBy("part")  # one row per part of a conversation
    parts = parts.select("conv_id", "part", (F.sum("n").over(whole) - F.col("n")).alias("offset"),
                         F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    parts = store(parts, "turn-offsets")
    placed = cut.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1)
    placed = placed.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") + F.col("offset")).alias("pos"), "h1", "h2", "chars")
    return placed, parts


def rebuilt(placed: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation c after its first h are put behind the first h turns of conversation c - c % 100."""
    placed = store(placed, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    convs = parts.filter("offset = 0").select("conv_id", "n_turns", h, F.expr("conv_id - conv_id % 100 AS base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = store(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "rebuilt")
    own = placed.join(parts.select("conv_id", "part").join(convs, "conv_id"), ["conv_id", "part"]).filter("pos >= h")
    own = own.select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "chars", "length")
    first = placed.filter("conv_id % 100 = 0 AND pos < 5").select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "chars")
    lent = convs.join(first, "base").filter("pos < taken").select("conv_id", F.lit(-1).alias("part"), "pos", "h1", "h2", "chars", "length")
    return own.union(lent), convs.select("conv_id", "length")


def _xor(*columns: str) -> Column:
    found = F.col(columns[0])
    for c in columns[1:]:
        found = found.bitwiseXOR(F.col(c))
    return found


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name (p1, p2), parent's name (q1, q2), chars, length of every prefix of every conversation."""
    lanes = {"x1": F.xxhash64("pos", "h1", "h2"), "x2": F.xxhash64(F.lit(3), "h2", "h1", "pos")}
    marked = store(turns.select("conv_id", "part", "pos", "chars", "length", *(v.alias(k) for k, v in lanes.items())), "turn-hashes")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("conv_id", "part").agg(*(F.expr(f"bit_xor({x}) AS {x}") for x in lanes))
    carried = totals.select("conv_id", "part", *(F.coalesce(F.expr(f"bit_xor({x})").over(before), F.lit(0)).alias("b" + x[1]) for x in lanes))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select("*", *(F.expr(f"bit_xor({x})").over(inside).alias("s" + x[1]) for x in lanes)).join(carried, ["conv_id", "part"])
    return local.select("conv_id", (F.col("pos") + 1).alias("depth"), _xor("s1", "b1").alias("p1"), _xor("s2", "b2").alias("p2"),
                        _xor("s1", "b1", "x1").alias("q1"), _xor("s2", "b2", "x2").alias("q2"), "chars", "length")


def local_rollup(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of a forest by centroid decomposition; ``parent`` holds places (-1: top), ``values`` a row per node."""
    n = len(parent)
    sums = np.zeros_like(values)
    size = np.ones(n, np.int64)
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(-depth[by_depth])) + 1) if n else []:
        level = level[parent[level] >= 0]
        np.add.at(size, parent[level], size[level])
    up = parent.copy()
    alive = np.arange(n)
    while len(alive):
        top = np.where(up >= 0, up, np.arange(n))
        while True:  # double the jumps until everything points to its component's top
            further = top[top]
            if (further == top).all():
                break
            top = further
        heavy = alive[2 * size[alive] >= size[top[alive]]]
        order = np.lexsort([size[heavy], top[heavy]])
        heavy = heavy[order]
        centroid = heavy[np.append(True, top[heavy][1:] != top[heavy][:-1])]
        of = np.full(n, -1)
        of[top[centroid]] = centroid
        jump = np.where(up >= 0, up, np.arange(n))
        jump[centroid] = centroid  # now everything below a centroid points to it, the rest to the top
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        below = alive[jump[alive] == of[top[alive]]]
        total = np.zeros_like(values)
        np.add.at(total, jump[below], values[below])
        lost = size[centroid].copy()
        climb, gain = centroid, total[centroid]
        while len(climb):
            sums[climb] += gain
            size[climb] -= lost
            on = up[climb] >= 0
            climb, gain, lost = up[climb[on]], gain[on], lost[on]
        gone = np.zeros(n, bool)
        gone[centroid] = True
        up[(up >= 0) & gone[np.maximum(up, 0)]] = -1
        up[centroid] = -1
        alive = alive[~gone[alive]]
    return sums


def _pieces(nodes: DataFrame, values: list[str], total: int, piece: int) -> DataFrame:
    """Subtree sums inside the components (c1, c2), which have ``piece`` nodes at most, bin by bin."""
    schema = pa.schema([*((c, pa.int64()) for c in (*NAME, *values))])

    def run(held: pa.Table) -> pa.Table:
        column = lambda c: held.column(c).to_numpy()
        name = np.stack([column("p1"), column("p2")], axis=1)
        top = (name[:, 0] == column("c1")) & (name[:, 1] == column("c2"))
        order = np.lexsort([name[:, 1], name[:, 0]])
        ranked = np.ascontiguousarray(name[order]).view([("a", "i8"), ("b", "i8")]).ravel()
        above = np.stack([column("q1"), column("q2")], axis=1).view([("a", "i8"), ("b", "i8")]).ravel()
        place = np.minimum(np.searchsorted(ranked, above), len(ranked) - 1)
        parent = np.where(top, -1, order[place])
        sums = local_rollup(parent, column("depth"), np.stack([column(v) for v in values], axis=1))
        return pa.table({"p1": name[:, 0], "p2": name[:, 1], **{v: sums[:, k] for k, v in enumerate(values)}}, schema=schema)

    bins = max(1, -(-total // piece))
    dealt = nodes.withColumns({"bin": F.pmod(F.xxhash64(*TOP), F.lit(bins)), **{q: F.coalesce(q, F.lit(0)) for q in PARENT}})
    return dealt.groupBy("bin").applyInArrow(run, "p1 bigint, p2 bigint, " + ", ".join(f"{v} bigint" for v in values))


def _below(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``nodes`` with size, the number of nodes in the subtree.

    A node is owned by its least conversation, and a conversation owns its path from some depth on. So a subtree holds what
    its owner's path still has, and all that the other conversations passing it own.
    """
    owned = nodes.groupBy("conv_id").agg(F.count("*").alias("owned"))
    passing = members.join(nodes.select(*NAME, F.col("conv_id").alias("owner")), NAME).join(owned, "conv_id", "left")
    part = F.when(F.col("owner") == F.col("conv_id"), F.col("length") - F.col("depth") + 1).otherwise(F.coalesce("owned", F.lit(0)))
    return nodes.join(passing.groupBy(*NAME).agg(F.sum(part).alias("size")), NAME)


def subtree_sums(nodes: DataFrame, members: DataFrame, values: list[str], piece: int = PIECE) -> DataFrame:
    """p1, p2 and the sums of ``values`` over the subtree of every node, for a trie with its root.

    ``nodes`` has p1, p2, q1, q2, depth, conv_id (owner) and the values; ``members`` (conv_id, depth, p1, p2, length) names
    every prefix of every conversation, the root's left out.
    """
    total = nodes.count()
    root = nodes.filter("depth = 0")
    start = nodes.withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long"), "top_depth": F.lit(0).cast("long")})
    if total <= piece:
        return _pieces(start, values, total, piece)
    inner = _below(nodes.filter("depth > 0"), members).withColumn("of", F.lit(total))
    current = inner.unionByName(root.withColumns({"size": F.lit(total).cast("long"), "of": F.lit(total)}))
    current = store(current.withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long"), "top_depth": F.lit(0).cast("long")}), "component")
    found: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        small.append(current.filter(F.col("of") <= piece))
        current = current.filter(F.col("of") > piece)
        best = F.min(F.struct("size", "p1", "p2", "conv_id", "depth", "top_depth")).alias("z")
        cut = store(current.filter("2 * size >= of").groupBy(*TOP).agg(best).select(*TOP, "z.*"), "centroids")
        if cut.isEmpty():
            break
        names = {"size": "z_size", "p1": "z1", "p2": "z2", "conv_id": "z_conv", "depth": "z_depth"}
        met = current.join(cut.drop("top_depth").withColumnsRenamed(names), TOP)
        at = members.select(F.col("conv_id").alias("m_conv"), F.col("depth").alias("m_depth"), F.col("p1").alias("w1"), F.col("p2").alias("w2"),
                            F.col("q1").alias("v1"), F.col("q2").alias("v2"))
        deep = met.join(at, (F.col("conv_id") == F.col("m_conv")) & (F.col("z_depth") + 1 == F.col("m_depth")) & (F.col("depth") > F.col("z_depth")), "left")
        hangs = F.coalesce((F.col("v1") == F.col("z1")) & (F.col("v2") == F.col("z2")), F.lit(False))
        met = store(deep.withColumn("lower", hangs).withColumn("is_z", (F.col("p1") == F.col("z1")) & (F.col("p2") == F.col("z2"))), "split")
        totals = met.filter("lower OR is_z").groupBy(*TOP).agg(*(F.sum(v).alias(v) for v in values))
        gains = cut.join(totals, TOP)
        climb = members.select(F.col("conv_id"), F.col("depth").alias("at"), F.col("p1").alias("u1"), F.col("p2").alias("u2")).join(gains, "conv_id")
        climb = climb.filter("at >= top_depth AND at <= depth").select("u1", "u2", "size", *values)
        climb = climb.union(gains.filter("top_depth = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "size", *values))
        climb = store(climb.toDF(*NAME, "lost", *values), "paths")
        found.append(climb.drop("lost"))
        rest = met.filter("NOT is_z").join(climb.select(*NAME, "lost"), NAME, "left")
        moved = {"size": F.col("size") - F.coalesce("lost", F.lit(0)), "top_depth": F.when(F.col("lower"), F.col("z_depth") + 1).otherwise(F.col("top_depth")),
                 "c1": F.when(F.col("lower"), F.col("w1")).otherwise(F.col("c1")), "c2": F.when(F.col("lower"), F.col("w2")).otherwise(F.col("c2"))}
        rest = store(rest.withColumns(moved).select(*(c for c in current.columns if c != "of")), "split")
        sizes = rest.groupBy(*TOP).agg(F.count("*").alias("of"))
        current = store(rest.join(sizes, TOP), "component")
    kept = small[0].select(*NAME, *PARENT, "depth", *TOP, *values)
    for s in small[1:]:
        kept = kept.union(s.select(*kept.columns))
    out = _pieces(kept, values, total, piece)
    for f in found:
        out = out.union(f)
    return out.groupBy(*NAME).agg(*(F.sum(v).alias(v) for v in values))


def _end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: the digest of the conversations that end at a node, ascending and comma-joined.

    Ranges of (node, conversation) are joined to chunks of ``CHUNK_IDS`` ids where they lie, so a node that ends very many
    conversations is a few long chunks by the time they meet; the digest takes them one by one.
    """
    chunk = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
    digest = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (batch.column(c).to_numpy() for c in ("p1", "p2", "conv_id"))
            if not len(ids):
                continue
            new = np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))
            start = np.flatnonzero(new)
            within = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
            heads = np.flatnonzero(within % CHUNK_IDS == 0)
            text = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(heads, np.append(heads[1:], len(ids)))]
            yield rows(chunk, p1=p1[heads], p2=p2[heads], first=ids[heads], ids=text)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for p1, p2, ids in zip(batch.column("p1").to_pylist(), batch.column("p2").to_pylist(), batch.column("ids")):
                if (p1, p2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(ids.as_py())
                else:
                    state.update(b"," + ids.as_py())
            yield rows(digest, **dict(zip(digest.names, zip(*done) if done else ([], [], []))))
            done = []
        if key is not None:
            yield rows(digest, p1=[key[0]], p2=[key[1]], ends_sha256=[state.hexdigest()])

    ranged = ends.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    chunks = ranged.mapInArrow(joined, "p1 bigint, p2 bigint, first bigint, ids binary")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digested, "p1 bigint, p2 bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, part, pos, h1, h2, chars, length) and ``convs`` (conv_id, length).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    members = store(prefixes(turns), "prefixes")
    least = lambda c: F.min(c).alias(c)  # noqa: E731  equal in all members
    inner = members.groupBy(*NAME).agg(least("q1"), least("q2"), least("conv_id"), least("depth"), F.count("*").alias("n_convs"), least("chars"))
    zero = F.lit(0).cast("long")
    root = convs.agg(least("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"))
    nodes = store(inner.select(*root.columns).union(root), "nodes")
    children = nodes.filter("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children")).withColumnsRenamed(dict(zip(PARENT, NAME)))
    nodes = store(nodes.join(children, NAME, "left").select(*nodes.columns, F.coalesce("n_children", zero).alias("n_children")), "nodes")
    valued = nodes.select(*NAME, *PARENT, "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(valued, members, ["n_leaves", "saved_tokens"], piece)
    ends = members.filter("depth = length").select(*NAME, "conv_id").union(convs.filter("length = 0").select(zero, zero, "conv_id"))
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NAME).join(_end_digests(ends), NAME, "left").join(above, PARENT, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The trie of the conversations as they are."""
    placed, parts = ordered_turns(conversations)
    lengths = parts.select("conv_id", "part", F.col("n_turns").alias("length"))
    return trie(placed.join(lengths, ["conv_id", "part"]), parts.filter("offset = 0").select("conv_id", F.col("n_turns").alias("length")), piece)


def rebuilt_trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The trie of the conversations rebuilt on shared openings (``rebuilt``)."""
    return trie(*rebuilt(*ordered_turns(conversations)), piece)
