"""Operator 3: near-duplicates by SimHash with a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Two searches use it:

``linked_documents``: the exact one. 64-bit fingerprints link at ``distance`` or fewer differing bits. Only distinct
fingerprints are searched. Upper nodes of the index are masked bit patterns: the bits are cut into ``distance + 1`` blocks,
and two linked fingerprints share at least one block, so they meet under a node (mask, pattern). Nodes are dealt to
shards by a hash; a shard that is too large has its nodes refined by the same cut of the bits not yet masked, which
loses no link and ends because fingerprints are distinct. Inside a node the fingerprints are sorted by Gray rank, groups
of eight factor out the bits they share, level by level, and a search adds up the differences on the way down and drops
a whole group once they exceed the distance.

``near_duplicates``: five-word shingles and a Jaccard similarity of 0.8 or more. Fingerprints of 256 bits, upper nodes of
random masks (as many as give ``RECALL`` at that similarity), the same index below them; every document's closest
neighbours within the distance of that similarity are then checked exactly on their shingle sets. That joins the dense
groups cheaply. What it misses is found by an exhaustive prefix join over the pairs not yet in one group, so every link
counts and neither masks nor shard sizes change the result.

Null text has no words; a document of fewer words than a shingle is one shingle; no words give fingerprint zero, linked
like any other. Repeated rows and doc_ids fall into one component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import documents, rows, store
from panelspark.llm.components import components

GROUP = 8
SHARD_ROWS = 50_000
SHARD_MOST = 400_000
SEED = 42
LANES = 4
RECALL = 0.9  # of the masks; what they miss the prefix join finds
SIMILARITY = 0.8
JOIN_ROWS = 500_000
JOIN_MOST = 4 * JOIN_ROWS
SHORT_RUN = 64
PARITY_BITS = 2048
COUNTERS = 1 << 22  # shingle counts that set the order of the prefixes; a fixed size, as errors only cost work
SEGMENT = 1 << 16
# one byte as eight byte lanes that hold its bits
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the text with A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows; ``hashes`` has one column per 64 bits."""
    n = len(hashes)
    if not n:
        return np.zeros(hashes.shape[1], np.uint64)
    lanes = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8)]
    parts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # a byte lane holds up to 255
    counts = np.ascontiguousarray(parts).view(np.uint8).astype(np.int64).sum(axis=0)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def _mixed(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` independent hashes of each hash."""
    x = h[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, width: int, lanes: int = 1) -> bytes:
    h = shingle_hashes(text, width)
    return majority(h[:, None] if lanes == 1 else _mixed(h, lanes)).tobytes()


def fingerprints(docs: DataFrame, width: int, lanes: int = 1) -> DataFrame:
    """doc_id, fp (``8 * lanes`` bytes) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            yield rows(schema, doc_id=batch.column("doc_id"), fp=[fingerprint(t, width, lanes) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp binary")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over distinct fingerprints (rows of words) that share a pattern under ``mask`` run by run."""

    def __init__(self, fps: np.ndarray, mask: np.ndarray):
        pattern = fps & mask
        order = np.lexsort([*gray_rank(fps).T[::-1], *pattern.T[::-1]])
        self.order, self.items = order, fps[order]
        pattern = pattern[order]
        n = len(fps)
        run = np.concatenate([[0], np.cumsum((pattern[1:] != pattern[:-1]).any(axis=1))]) if n else np.zeros(0, np.int64)
        self.levels: list[dict] = []  # from the leaves up: first and end child, last item, shared mask and pattern
        full, codes, runs, last = np.full_like(self.items, np.iinfo(np.uint64).max), self.items, run, np.arange(n)
        while True:
            start = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1]) if len(runs) else np.zeros(0, np.int64)
            within = np.arange(len(runs)) - np.repeat(start, np.diff(np.append(start, len(runs))))
            heads = np.flatnonzero(within % GROUP == 0)
            if not len(heads):
                break
            ends = np.append(heads[1:], len(runs))
            first = np.repeat(codes[heads], ends - heads, axis=0)
            shared = np.bitwise_and.reduceat(full, heads, axis=0) & ~np.bitwise_or.reduceat(codes ^ first, heads, axis=0)
            own = full & ~np.repeat(shared, ends - heads, axis=0)  # what the children keep once the shared bits move up
            self.levels.append({"start": heads, "end": ends, "own": own, "codes": codes, "last": last})
            full, codes, runs, last = shared, codes[heads] & shared, runs[heads], last[ends - 1]
            if len(np.unique(runs)) == len(runs):
                break
        self.root = np.searchsorted(runs, run) if n else run
        self.roots = {"own": full, "codes": codes}

    def pairs(self, distance: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, differences) of items i < j (in index order) of one run that differ in up to ``distance`` bits."""
        for at in range(0, len(self.items), block):
            q = np.arange(at, min(at + block, len(self.items)))
            node = self.root[q]
            gap = np.bitwise_count((self.items[q] ^ self.roots["codes"][node]) & self.roots["own"][node]).sum(axis=1, dtype=np.int64)
            for level in reversed(self.levels):
                keep = gap <= distance
                q, node, gap = q[keep], node[keep], gap[keep]
                size = (level["end"] - level["start"])[node]
                child = np.repeat(level["start"][node] - np.cumsum(size) + size, size) + np.arange(size.sum())
                q, gap = np.repeat(q, size), np.repeat(gap, size)
                ahead = level["last"][child] > q
                q, gap, node = q[ahead], gap[ahead], child[ahead]
                gap = gap + np.bitwise_count((self.items[q] ^ level["codes"][node]) & level["own"][node]).sum(axis=1, dtype=np.int64)
            keep = gap <= distance
            yield q[keep], node[keep], gap[keep]


def _local_roots(n: int, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least item of each item's component under the found links, block by block."""
    label = np.arange(n)
    for i, j, _ in found:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def block_masks(bits: int, mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` near-equal blocks of the bits outside it added."""
    free = [b for b in range(bits - 1, -1, -1) if not mask >> b & 1]
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def random_masks(bits: int, count: int, width: int, seed: int = SEED, inside: int = 0) -> list[int]:
    """``count`` masks of ``width`` random bits, added to ``inside``."""
    rng = np.random.default_rng(seed)
    free = [b for b in range(bits) if not inside >> b & 1]
    return [inside | sum(1 << int(b) for b in rng.choice(free, min(width, len(free)), replace=False)) for _ in range(count)]


def _words(mask: int, lanes: int) -> np.ndarray:
    return np.frombuffer(mask.to_bytes(8 * lanes, "little"), "<u8").astype(np.uint64)


def _deal(batches: Iterator[pa.RecordBatch], masks: dict[int, list[tuple[int, int]]], lanes: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under each child mask of the mask it came with, with the shard of its masked pattern."""
    schema = pa.schema([("mask", pa.int32()), ("shard", pa.int64()), ("fp", pa.binary())])
    for batch in batches:
        came = batch.column("mask").to_numpy(zero_copy_only=False)
        for m in np.unique(came):
            part = batch.column("fp").filter(pa.array(came == m))
            fps = np.frombuffer(b"".join(part.to_pylist()), "<u8").reshape(-1, lanes)
            for number, mask in masks[int(m)]:
                pattern = fps & _words(mask, lanes)
                mixed = _mixed(np.bitwise_xor.reduce(_mixed(pattern.ravel() + np.tile(np.arange(lanes, dtype=np.uint64), len(fps)), 1).reshape(-1, lanes), axis=1), 1)[:, 0]
                yield rows(schema, mask=np.full(len(fps), number, np.int32), shard=(mixed % np.uint64(shards)).astype(np.int64), fp=part)


def _search(fps: DataFrame, lanes: int, first: list[int], refine, leaf, leaf_schema: str) -> DataFrame:
    """Deal distinct fingerprints (fp) to the nodes of ``first`` and run ``leaf(mask, fps)`` on every shard.

    Shards of over ``SHARD_MOST`` rows hold a hot node: their rows go on under the masks ``refine`` gives, until none is left
    or nothing is left to refine. Only counts reach the driver.
    """
    shards = max(1, -(-fps.count() // SHARD_ROWS))
    numbered = dict(enumerate(first, 1))
    todo, came, results = fps.select(F.lit(0).alias("mask"), "fp"), {0: list(numbered.items())}, None

    def run(held: pa.Table) -> pa.Table:
        return leaf(masks[held.column("mask")[0].as_py()], np.frombuffer(b"".join(held.column("fp").to_pylist()), "<u8").reshape(-1, lanes).astype(np.uint64))

    while True:
        dealt = todo.mapInArrow(lambda b, c=came: _deal(b, c, lanes, shards), "mask int, shard bigint, fp binary")
        masks = dict(numbered)
        sizes = dealt.groupBy("mask", "shard").count().filter(F.col("count") > SHARD_MOST)
        hot = store(sizes.select("mask", "shard"), "hot-nodes") if _may_be_hot(shards) else None
        more = {r.mask for r in hot.select("mask").distinct().collect()} if hot is not None else set()  # masks, not nodes
        children = {m: refine(numbered[m]) for m in more}
        children = {m: c for m, c in children.items() if c}
        going = hot.filter(F.col("mask").isin(list(children))) if children else None
        cold = dealt.join(going, ["mask", "shard"], "left_anti") if going is not None else dealt
        part = cold.groupBy("mask", "shard").applyInArrow(run, leaf_schema)
        results = part if results is None else results.union(part)
        if going is None:
            return results
        came = {}
        for m, found in children.items():
            came[m] = [(len(numbered) + k, c) for k, c in enumerate(found, 1)]
            numbered |= dict(came[m])
        todo = store(dealt.join(going, ["mask", "shard"], "left_semi").select("mask", "fp"), "hot-rows")


def _may_be_hot(shards: int) -> bool:
    """Whether any shard can exceed ``SHARD_MOST`` rows: not when there are fewer rows in all."""
    return shards * SHARD_ROWS > SHARD_MOST


def _exact_edges(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) that connect distinct 64-bit fingerprints as links of ``distance`` or fewer bits do."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def leaf(mask: int, held: np.ndarray) -> pa.Table:
        index = GrayIndex(held, _words(mask, 1))
        roots = _local_roots(len(held), index.pairs(distance))
        moved = np.flatnonzero(roots != np.arange(len(held)))
        signed = index.items[:, 0].view(np.int64)
        return pa.table({"u": signed[moved], "v": signed[roots[moved]]}, schema=schema)

    def refine(mask: int) -> list[int]:
        return block_masks(64, mask, distance + 1) if 64 - mask.bit_count() > 16 else []

    return _search(fps, 1, block_masks(64, 0, distance + 1), refine, leaf, "u bigint, v bigint")


def linked_documents(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable) of every document."""
    made = store(fingerprints(docs, width), "fingerprints")
    marked = made.withColumn("code", _code("fp"))
    own = store(marked.groupBy("code").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "distinct-fingerprints")
    nodes = components(_exact_edges(own, distance))
    rooted = own.select("code", "least").join(nodes.withColumnRenamed("node", "code"), "code", "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("code", "component_id")
    return marked.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def _code(fp: str):
    """An 8-byte little-endian binary as a signed long."""
    return F.expr("+".join(f"shiftleft(cast(conv(hex(substring({fp}, {k + 1}, 1)), 16, 10) AS bigint), {8 * k})" for k in range(8)))


def closeness(similarity: float) -> float:
    """Chance that a fingerprint bit differs at a Jaccard similarity, from the angle between the shingle sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id over links of ``similarity`` or more on ``width``-word shingle sets.

    Documents of one shingle set are copies. Every other set is linked to its closest fingerprints under each node (the
    closest before it and the closest of all) and to one set of its own fingerprint, after an exact check of the pair;
    ``_missed`` adds every link between the groups found so.
    """
    bits = 64 * LANES
    features = store(_features(docs, width), "fingerprints")
    made = features.filter("segment IS NULL").select("doc_id", "fp", "key")
    own = store(made.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "distinct-sets")
    prints = store(own.groupBy("fp").agg(F.min("least").alias("least")), "distinct-fingerprints")
    n = prints.count()
    p = closeness(similarity)
    wide = max(8, math.ceil(math.log2(n + 1)) - 2)
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - p) ** wide))
    most = math.ceil(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def leaf(mask: int, held: np.ndarray) -> pa.Table:
        index = GrayIndex(held, _words(mask, LANES))
        before, nearest = np.full(len(held), 1 << 60), np.full(len(held), 1 << 60)
        for i, j, gap in index.pairs(most):
            np.minimum.at(before, j, gap << 32 | i)
            np.minimum.at(nearest, j, gap << 32 | i)
            np.minimum.at(nearest, i, gap << 32 | j)
        out = []
        for best in (before, nearest):
            here = np.flatnonzero(best < 1 << 60)
            out.append((here, best[here] & 0xFFFFFFFF))
        one, two = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        code = [r.tobytes() for r in index.items]
        ends = {tuple(sorted((code[x], code[y]))) for x, y in zip(one.tolist(), two.tolist())}
        return pa.table({"a": [e[0] for e in ends], "b": [e[1] for e in ends]}, schema=schema)

    def refine(mask: int) -> list[int]:
        return random_masks(bits, 4, 6, mask.bit_count(), mask) if bits - mask.bit_count() > bits // 2 else []

    close = _search(prints.select("fp"), LANES, random_masks(bits, count, wide), refine, leaf, "a binary, b binary").distinct()
    apart = close.join(prints.toDF("a", "u"), "a").join(prints.toDF("b", "v"), "b").select("u", "v")
    same = own.select("fp", F.col("least").alias("v")).join(prints.toDF("fp", "u"), "fp").filter("u < v").select("u", "v")
    named = store(apart.union(same).distinct(), "close-pairs")
    links = store(_checked(docs, named, width, similarity), "links")
    groups = store(own.select("least").distinct().join(components(links).toDF("least", "root"), "least", "left").select("least", F.coalesce("root", "least").alias("root")), "groups")
    sent = docs.sparkSession.sparkContext.broadcast(_shingle_counts(features))
    chosen = own.select("key", "least").join(groups, "least").select("key", F.col("least").alias("doc_id"), "root")
    missed = _missed(_prefixes(docs, width, similarity, sent).dropDuplicates(["key", "doc_id"]).join(chosen, ["key", "doc_id"]), similarity, sent)
    nodes = components(links.union(_checked(docs, missed, width, similarity)))
    rooted = own.join(nodes.toDF("least", "root"), "least", "left").select("key", F.coalesce("root", "least").alias("component_id"))
    return made.select("doc_id", "key").join(rooted, "key").select("doc_id", "component_id")


def prefix(held: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``rarest`` where ``common`` has some shingles (sorted) and how often they occur; the others count as 0."""
    names, times = common
    if not len(names) or not len(held):
        return rarest(held, similarity, np.zeros(len(held), np.int64))
    at = np.minimum(np.searchsorted(names, held), len(names) - 1)
    return rarest(held, similarity, np.where(names[at] == held, times[at], 0))


def rarest(held: np.ndarray, similarity: float, times: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set (sorted hashes), so many that two sets of the similarity share one of theirs.

    Any total order over the shingles gives that; rare ones first keeps the groups small.
    """
    size = len(held) - math.ceil(similarity * len(held) - 1e-9) + 1
    return held[np.lexsort([held, times])[:size]]


def parity(held: np.ndarray) -> np.ndarray:
    """How often (odd or even) each value of the low hash bits occurs, as bits: where two sets' bits differ the sets do."""
    wide = max(64, 1 << max(0, len(held) - 1).bit_length())
    counts = np.bincount((held & np.uint64(wide - 1)).astype(np.int64), minlength=wide)
    return np.packbits(counts & 1 == 1, bitorder="little").view("<u8")


def _features(docs: DataFrame, width: int) -> DataFrame:
    """Of every text's shingle set: fp, digest (key); and, as rows of their own, each task's counts of shingles by counter."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("key", pa.binary()), ("segment", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def counted(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, part in enumerate(table.reshape(-1, SEGMENT)):
            at = np.flatnonzero(part)
            if len(at):
                full = len(at) > SEGMENT // 4
                yield rows(schema, doc_id=[None], fp=[None], key=[None], segment=[s], places=[None if full else at.astype("<u2").tobytes()],
                           counts=[(part if full else part[at]).astype("<u4").tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting = np.zeros(COUNTERS, np.int64), []
        for batch, texts in documents(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            waiting += sets
            if sum(map(len, waiting)) > COUNTERS:
                table, waiting = table + _counters(waiting), []
            none = [None] * len(sets)
            yield rows(schema, doc_id=batch.column("doc_id"), fp=[majority(_mixed(h, LANES)).tobytes() for h in sets],
                       key=[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], segment=none, places=none, counts=none)
        yield from counted(table + _counters(waiting))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp binary, key binary, segment int, places binary, counts binary")


def _counters(sets: list[np.ndarray]) -> np.ndarray:
    held = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return np.bincount((held & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)


def _shingle_counts(features: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each counter: all documents counted, added up segment by segment on the executors."""
    schema = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, places, counts in zip(batch.column("segment").to_pylist(), batch.column("places"), batch.column("counts")):
                table = held.setdefault(s, np.zeros(SEGMENT, np.int64))
                table[np.frombuffer(places.as_py(), "<u2") if places.is_valid else slice(None)] += np.frombuffer(counts.as_py(), "<u4")
        for s, table in held.items():
            yield rows(schema, segment=[s], counts=[np.minimum(table, 0xFFFFFFFF).astype("<u4").tobytes()])

    table = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.uint32)
    parts = features.filter("segment IS NOT NULL").select("segment", "places", "counts").repartition("segment")
    for r in parts.mapInArrow(run, "segment int, counts binary").collect():
        table[r.segment] = np.frombuffer(r.counts, "<u4")
    return table.ravel()


def _prefixes(docs: DataFrame, width: int, similarity: float, sent) -> DataFrame:
    """doc_id, key, size, parity bits (folded to ``PARITY_BITS`` at most) and prefix of every text's shingle set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("parity", pa.binary()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            yield rows(schema, doc_id=batch.column("doc_id"), key=[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], size=[len(h) for h in sets],
                       parity=[folded(parity(h), PARITY_BITS // 64).tobytes() for h in sets],
                       prefix=[rarest(h, similarity, sent.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]).tobytes() for h in sets])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key binary, size int, parity binary, prefix binary")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (along the last axis, a power of two of words) folded to ``words`` at most."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Run:
    """Rows of a shard of the prefix join: shingle, set, group, size, place of the shingle in the prefix, parity bits."""

    def __init__(self, held: pa.Table, similarity: float):
        self.similarity = similarity
        token, size = held.column("token").to_numpy(), held.column("size").to_numpy().astype(np.int64)
        order = np.lexsort([size, token])
        token, root = token[order], held.column("root").to_numpy()[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        several = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        order = order[np.repeat(several, np.diff(np.append(start, len(token))))]
        self.token, self.size, self.root = (held.column(c).to_numpy()[order] for c in ("token", "size", "root"))
        self.size = self.size.astype(np.int64)
        self.place = held.column("place").to_numpy()[order].astype(np.int64)
        self.names, self.at = np.unique(held.column("node").to_numpy()[order], return_inverse=True)
        self.parity = held.column("parity").combine_chunks().take(pa.array(order))

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Codes of the pairs of rows (size of i up to that of j) that sizes, places and parity bits leave open."""
        m, n = self.size[i], self.size[j]
        least = np.ceil(self.similarity / (1 + self.similarity) * (m + n) - 1e-9)  # shingles such sets have in common
        # at the first shingle that both have, no more than the rest of either can follow
        keep = (self.root[i] != self.root[j]) & (m >= self.similarity * n - 1e-9) & (np.minimum(m - self.place[i], n - self.place[j]) >= least)
        i, j = i[keep], j[keep]
        a, b = np.minimum(self.at[i], self.at[j]), np.maximum(self.at[i], self.at[j])
        codes, first = np.unique(a * len(self.names) + b, return_index=True)
        return codes[self._alike(i[first], j[first])]

    def _alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the parity bits, where both rows carry them, differ no more often than the sets may."""
        fine = np.ones(len(i), bool)
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            x, y = self.parity.take(pa.array(i[part])), self.parity.take(pa.array(j[part]))
            wide = [np.asarray(pc.fill_null(pc.binary_length(c), 0)) // 8 for c in (x, y)]
            most = (self.size[i[part]] + self.size[j[part]]) * (1 - self.similarity) / (1 + self.similarity) + 1e-6
            ok = fine[part]
            for w in np.unique(np.stack(wide, axis=1), axis=0).tolist():
                if not min(w):
                    continue
                here = np.flatnonzero((wide[0] == w[0]) & (wide[1] == w[1]))
                bits = [folded(np.frombuffer(b"".join(c.take(pa.array(here)).to_pylist()), "<u8").reshape(len(here), -1), min(w)) for c in (x, y)]
                ok[here] = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64) <= most[here]
        return fine

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1])) if len(self.token) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(self.token)))
        codes, waiting = np.zeros(0, np.int64), []

        def gather(found: np.ndarray) -> None:
            nonlocal codes, waiting
            waiting.append(found)
            if sum(map(len, waiting)) > JOIN_ROWS:
                codes, waiting = np.unique(np.concatenate([codes, *waiting])), []

        i, step = np.flatnonzero(np.repeat(length <= SHORT_RUN, length)), 0
        while len(i):  # short runs: pairs ``step`` places apart; sizes rise, so a pair too far apart ends its item
            step += 1
            i = i[i + step < len(self.token)]
            i = i[(self.token[i] == self.token[i + step]) & (self.size[i] >= self.similarity * self.size[i + step] - 1e-9)]
            gather(self.possible(i, i + step))
        for a, n in zip(start[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
            # a long run is mostly one group: only what is not of the largest group is held against all
            names, of, times = np.unique(self.root[a:a + n], return_inverse=True, return_counts=True)
            other = np.flatnonzero(of != np.argmax(times))
            block = max(1, 4_000_000 // n)
            for at in range(0, len(other), block):
                x = np.repeat(other[at:at + block], n)
                y = np.tile(np.arange(n), len(x) // n)
                apart = (of[x] != of[y]) & ((of[y] == np.argmax(times)) | (x < y))
                x, y = x[apart], y[apart]
                gather(self.possible(a + np.minimum(x, y), a + np.maximum(x, y)))
        codes = np.unique(np.concatenate([codes, *waiting]))
        return self.names[codes // max(1, len(self.names))], self.names[codes % max(1, len(self.names))]


def _missed(sets: DataFrame, similarity: float, sent) -> DataFrame:
    """Pairs (u, v) of different groups that may have the similarity: none that has it is left out.

    Two such sets share a shingle of their prefixes. Rows of a shingle that over ``SHORT_RUN`` documents may have carry parity
    bits, so that pairs are tested where they meet and few leave. Shards of over ``JOIN_MOST`` rows are counted by shingle; a
    shingle of over ``JOIN_ROWS`` sets is dealt as pairs of tiles: of the sets outside its largest group with all others.
    """
    tokens = store(sets.select(F.col("doc_id").alias("node"), "root", "size", "parity", "prefix", F.expr("length(prefix) div 8 AS length")), "prefixes")
    shards = max(1, -(-(tokens.agg(F.sum("length")).first()[0] or 0) // JOIN_ROWS))
    dealt_schema = pa.schema([("shard", pa.int32()), ("token", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("parity", pa.binary())])
    pair = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            of = np.repeat(np.arange(batch.num_rows), length)
            for a in range(0, len(of), 500_000):  # parity bits are repeated per shingle: bounded parts
                part = of[a:a + 500_000]
                some = batch.slice(part[0], part[-1] - part[0] + 1)
                tokens = np.frombuffer(b"".join(some.column("prefix").to_pylist()), "<u8")
                skip = a - int((np.cumsum(length) - length)[part[0]])
                tokens = tokens[skip:skip + len(part)]
                place = np.arange(a, a + len(part)) - (np.cumsum(length) - length)[part]
                rare = sent.value[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)] <= SHORT_RUN
                shard = (_mixed(tokens, 1)[:, 0] % np.uint64(shards)).astype(np.int32)
                yield rows(dealt_schema, shard=shard, token=tokens.view(np.int64), place=place.astype(np.int32), parity=batch.column("parity").take(pa.array(part, mask=rare)),
                           **{c: batch.column(c).to_numpy()[part] for c in ("node", "root", "size")})

    def leaf(held: pa.Table) -> pa.Table:
        u, v = _Run(held, similarity).pairs()
        return pa.table({"u": u, "v": v}, schema=pair)

    dealt = tokens.mapInArrow(deal, "shard int, token bigint, node bigint, root bigint, size int, place int, parity binary")
    large = dealt.groupBy("shard").count().filter(F.col("count") > JOIN_MOST).select("shard")
    hot = store(dealt.join(large, "shard", "left_semi").groupBy("token", "root").count(), "hot-shingles")
    sides = hot.groupBy("token").agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("main")).filter(F.col("n") > JOIN_ROWS)
    tiles = lambda n: F.ceil(n / JOIN_ROWS).cast("int")
    sides = store(sides.select("token", F.col("main.root").alias("main"), tiles(F.col("main.count")).alias("mains"), tiles(F.col("n") - F.col("main.count")).alias("others")), "hot-shingles")
    if sides.isEmpty():
        return store(dealt.groupBy("shard").applyInArrow(leaf, "u bigint, v bigint").distinct(), "missed-pairs")
    pairs = dealt.join(sides, "token", "left_anti").groupBy("shard").applyInArrow(leaf, "u bigint, v bigint")
    tile = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    own = dealt.join(sides.filter("others > 0"), "token").withColumn("is_main", F.col("root") == F.col("main"))
    own = own.withColumn("tile", tile(F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    meets = F.expr("""IF(is_main, transform(sequence(0, others - 1), a -> named_struct('a', a, 'b', tile, 'm', true)), concat(
        transform(sequence(0, mains - 1), b -> named_struct('a', tile, 'b', b, 'm', true)),
        transform(sequence(0, others - 1), b -> named_struct('a', least(b, tile), 'b', greatest(b, tile), 'm', false))))""")
    met = own.withColumn("task", F.explode(meets)).select("task", *dealt.columns)
    return store(pairs.union(met.groupBy("token", "task").applyInArrow(leaf, "u bigint, v bigint")).distinct(), "missed-pairs")


def _checked(docs: DataFrame, named: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the similarity."""
    wanted = named.select(F.col("u").alias("doc_id")).union(named.select(F.col("v").alias("doc_id"))).distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            yield rows(schema, doc_id=batch.column("doc_id"), shingles=[np.unique(shingle_hashes(t, width)).tobytes() for t in texts])

    held = store(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id bigint, shingles binary").distinct(), "shingle-sets")  # texts of one doc_id: any of them may link
    both = named.join(held.toDF("u", "first"), "u").join(held.toDF("v", "second"), "v")
    pair = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for a, b in zip(batch.column("first"), batch.column("second")):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                common = len(x) + len(y) - len(np.union1d(x, y))
                fine.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return both.mapInArrow(check, "u bigint, v bigint").distinct()
