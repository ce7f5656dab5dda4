"""Operator 4: removal of repeated passages by fixed-block anchors.

A window of ``window`` words holds at least one block of ``window // 2`` words that starts at a multiple of that length in its
document. These blocks are the reference index; every rolling window of the block's length in every document probes it.
The work is four passes of narrow rows:

1. blocks: the hashes of all blocks fill a bit table of fixed size, the only thing that is broadcast. It only saves
   shuffling: a false positive costs a row, never a result, and a full table would let every probe pass.
2. probes: the hashes that pass, reduced per task to (hash, least text, greatest text, is a block), a text being named by a
   hash of the whole; anchors are blocks that occur in two different texts or more. They fill a second bit table.
3. extension: around each anchor a document's hits are extended to all windows that hold it, hashed in 96 bits; a window
   whose least doc_id is smaller than its own document's is repeated. Windows side by side merge into maximal repeats.
4. whole texts that a smaller doc_id also has are found by a digest (so groups of copies need no windows), and texts lose
   the words of their repeats.

Words are runs of characters other than space and 0x09-0x0D. Null text has no words; documents of fewer words than a window
keep all. Rows with the same doc_id are one origin: none repeats the other, and each row loses what a smaller doc_id has of its own
text (spans are kept by doc_id and text). Texts of any length are taken whole. A null doc_id is larger than all others: its row loses what
others have, and nothing is lost to it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import activate, documents, remembered, rows, store

WINDOW = 50
FILTER_BITS = 27
SEGMENT_BITS = 19  # a segment of the bit table: 64 KB
FLUSH = 1 << 21
WHOLE = -1
TEXT_SEED = 42  # that of the SQL function xxhash64, so that rows and tasks name a text alike
NO_ID = (1 << 63) - 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = remembered("substrings", WordHashes())
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = remembered("substrings", {})


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if int(base) not in _powers or len(_powers[int(base)][0]) < n:
        size = max(n, 1 << 18)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _powers[int(base)] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (base, inverse))
    return _powers[int(base)]


def rolling(keys: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive keys."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(keys * up[:n], dtype=np.uint64)])
    x = (sums[width:] - sums[:-width]) * down[:n - width + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Part:
    """The words of some documents, one after the other, as hashes."""

    def __init__(self, texts: list[str]):
        activate("substrings")
        raw = [t.encode() for t in texts]
        words = [r.split() for r in raw]
        self.name = np.fromiter((xxhash.xxh64_intdigest(r, TEXT_SEED) for r in raw), np.uint64, len(raw)).view(np.int64)
        self.count = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.count) - self.count
        get = _hashes.__getitem__
        self.keys = np.fromiter((get(w) for some in words for w in some), np.uint64, int(self.count.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.at = np.arange(len(self.keys)) - self.first[self.doc]

    def windows(self, width: int, base: np.uint64 = _BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of ``width`` words inside one document."""
        h = rolling(self.keys, width, base)
        start = np.flatnonzero(self.at[:len(h)] + width <= self.count[self.doc[:len(h)]])
        return start, h[start]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a table of ``2**bits`` for each hash, both in one segment."""
    segment_bits = min(SEGMENT_BITS, bits)
    base = (h >> np.uint64(64 - bits + segment_bits)) << np.uint64(segment_bits) if bits > segment_bits else np.zeros_like(h)
    low = np.uint64((1 << segment_bits) - 1)
    return base | (h & low), base | ((h >> np.uint64(segment_bits)) & low)


def _is_set(filled: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _slots(h, bits)
    eight, seven = np.uint64(3), np.uint64(7)
    return ((filled[a >> eight] >> (a & seven).astype(np.uint8)) & (filled[b >> eight] >> (b & seven).astype(np.uint8)) & 1).astype(bool)


def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit table of packed hashes (segment, hashes): filled segment by segment on the executors; its size is fixed."""
    segment_bits = min(SEGMENT_BITS, bits)
    schema = pa.schema([("segment", pa.int64()), ("filled", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column("segment").to_pylist(), batch.column("hashes")):
                table = held.setdefault(s, np.zeros(1 << segment_bits, np.uint8))
                for slot in _slots(np.frombuffer(raw.as_py(), "<u8"), bits):
                    table[slot & np.uint64((1 << segment_bits) - 1)] = 1
        for s, table in held.items():
            yield rows(schema, segment=[s], filled=[np.packbits(table, bitorder="little").tobytes()])

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << segment_bits) // 8
    for r in hashes.repartition("segment").mapInArrow(fill, "segment bigint, filled binary").collect():
        out[r.segment * size:(r.segment + 1) * size] = np.frombuffer(r.filled, np.uint8)
    return out


def _by_segment(h: np.ndarray, bits: int) -> pa.RecordBatch:
    """Unique hashes packed by segment."""
    schema = pa.schema([("segment", pa.int64()), ("hashes", pa.binary())])
    h = np.unique(h)
    segment = (h >> np.uint64(64 - bits + SEGMENT_BITS)).astype(np.int64) if bits > SEGMENT_BITS else np.zeros(len(h), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(h)] if len(h) else [0]
    return rows(schema, segment=segment[cuts[:-1]], hashes=[h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])


def _scan(docs: DataFrame, each: Callable[[Part, np.ndarray], tuple[np.ndarray, ...]], flush: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """Work off documents in parts; what ``each`` gives is gathered and turned to rows every ``FLUSH`` entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch, texts in documents(batches):
            got = each(Part(texts), pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False))
            held.append(got)
            size += len(got[0])
            if size >= FLUSH:
                yield flush(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield flush(*map(np.concatenate, zip(*held)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def repeats(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, name (of the text), at: the starts of the windows of each text that a smaller doc_id also has."""
    spark = docs.sparkSession
    width = window // 2
    send = spark.sparkContext.broadcast

    def block_hashes(part: Part, _: np.ndarray) -> tuple[np.ndarray]:
        start, h = part.windows(width)
        return (h[part.at[start] % width == 0],)

    packed = "segment bigint, hashes binary"
    blocks = send(_bit_table(_scan(docs, block_hashes, lambda h: _by_segment(h, filter_bits), packed), filter_bits))

    def probes(part: Part, _: np.ndarray) -> tuple[np.ndarray, ...]:
        start, h = part.windows(width)
        passed = _is_set(blocks.value, h, filter_bits)
        start, h = start[passed], h[passed]
        return h, part.name[part.doc[start]], part.at[start] % width == 0

    def reduced(h: np.ndarray, text: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        schema = pa.schema([("hash", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("block", pa.bool_())])
        order = np.argsort(h, kind="stable")
        h, text, block = h[order], text[order], block[order]
        heads = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        return rows(schema, hash=h[heads].view(np.int64), least=np.minimum.reduceat(text, heads), most=np.maximum.reduceat(text, heads), block=np.logical_or.reduceat(block, heads))

    found = _scan(docs, probes, reduced, "hash bigint, least bigint, most bigint, block boolean")
    anchors = found.groupBy("hash").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("block").alias("block")).filter("block AND least < most").select("hash")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _by_segment(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), filter_bits)

    hits = send(_bit_table(anchors.mapInArrow(gather, packed), filter_bits))

    def extended(part: Part, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        start, h = part.windows(width)
        hit = np.zeros(len(part.keys) + window, np.int64)
        hit[start[_is_set(hits.value, h, filter_bits)]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        start, h = part.windows(window)
        holds = total[start + window - width + 1] > total[start]
        start, h = start[holds], h[holds]
        if not len(start):
            return h, np.zeros(0, np.int32), ids[:0], part.name[:0], np.zeros(0, np.int32)
        second = rolling(part.keys, window, _BASES[1])[start]
        return h, (second >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[part.doc[start]], part.name[part.doc[start]], part.at[start].astype(np.int32)

    def plain(h: np.ndarray, g: np.ndarray, doc: np.ndarray, name: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("name", pa.int64()), ("at", pa.int32())])
        return rows(schema, h=h.view(np.int64), g=g, doc_id=doc, name=name, at=at)

    windows = store(_scan(docs, extended, plain, "h bigint, g int, doc_id bigint, name bigint, at int"), "windows")
    least = windows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h", "g", "least")
    # read from files, both sides of the join are plain exchanges, and a window that very many texts hold is split among tasks
    return windows.join(store(least, "repeated-windows"), ["h", "g"]).filter("doc_id > least").select("doc_id", "name", "at")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, name of texts that a smaller doc_id also has as a whole."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    named = store(docs.filter("text IS NOT NULL").select(doc_id, F.xxhash64("text").alias("name"), F.sha2("text", 256).alias("digest")), "digests")
    least = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    return named.join(store(least, "repeated-texts"), "digest").filter("doc_id > least").select("doc_id", "name").distinct()


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:n]) > 0


def cleaned(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with the columns n_words, n_removed and kept (the kept words joined by one space) added.

    A document's repeat starts are one list, bounded by its own words; -1 stands for the whole of a copy.
    """
    found = repeats(docs, window, filter_bits).union(copies(docs).select("doc_id", "name", F.lit(WHOLE).alias("at")))
    spans = found.groupBy(F.col("doc_id").alias("_origin"), F.col("name").alias("_name")).agg(F.collect_set("at").alias("_starts"))
    own = F.coalesce(docs.doc_id.cast("long"), F.lit(NO_ID)) == F.col("_origin")
    joined = docs.join(spans, own & (F.xxhash64(docs.text) == F.col("_name")), "left").drop("_origin", "_name")
    names = [c for c in joined.columns if c not in ("_starts", "n_words", "n_removed", "kept")]
    schema = joined.select(names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(texts, batch.column("_starts")):
                words = text.encode().split()
                n_words.append(len(words))
                if starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    gone = np.full(len(words), len(words) >= window) if at.min() == WHOLE else _covered(at, window, len(words))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            out = batch.select(names)
            for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept", kept, pa.string())):
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return cleaned(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
