"""Operator 12: ranked lexical search over bit-sliced Bloom signatures.

The index has one Bloom signature per document, 16 to 32 bits for each of its keys. A key is a term with a level of its
frequency (at least 1, 2, 3, 4, 6, ... occurrences), so that a signature bounds frequencies too. Documents of one signature
width are stored in blocks, turned by 90 degrees: a slice holds one bit of all documents of the block. The slices of a key's bits,
anded, mark the documents that may have the key, some too many, none too few. Writing the index is the only pass that
splits all texts into terms; it also counts in how many documents each term is.

A search reads slices. For every level the weights of the query's terms are summed over the documents their slices mark, times
what that level adds to a score at most: an upper bound for every (item, document). The documents with the highest bounds are
scored exactly; the last of the best ``k`` is a floor. Then every document whose bound is not provably under it (a tie
under the floor's doc_id included) is scored exactly from its text. Nothing is capped: the floor alone excludes.

Terms are the maximal runs of letters and digits of ASCII and of everything beyond ASCII, A-Z lower-cased. Null and empty texts have
none. Rows without doc_id or item_id are left out, rows of one item_id are one item with the terms of all, rows of one
doc_id are documents of their own. Equal scores rank by doc_id. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import activate, documents, remembered, rows, store

LEVELS = (1, 2, 3, 4, 6, 9, 14, 22, 40)
HASHES = 3
BITS_PER_KEY = 16
BLOCK_DOCS = 256
BLOCK_BITS = 1 << 23
LEXICON = 400_000
PAIRS = 50_000
SEEDS = 2
_SEPARATED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_INDEX = "term binary, df bigint, width int, doc_ids binary, counts binary, slices binary, n_docs bigint, n_terms bigint"


class TermHashes(dict):
    """XXH64 of terms, remembered up to a bound."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[term] = xxhash.xxh64_intdigest(term)
        return h


_hashes = remembered("lexical", TermHashes())


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_SEPARATED).split()


def key_bits(h: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``HASHES`` signature bits (columns) of terms at a level, in a signature of 2**width bits."""
    salt = np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(level * HASHES)
    x = h[:, None] + salt * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - width)).astype(np.int64)


def signature(counts: Counter) -> tuple[int, np.ndarray]:
    """Width (log2) and set bits of a document's signature."""
    h = np.fromiter(map(_hashes.__getitem__, counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    held = [h[tf >= at] for at in LEVELS]
    width = max(6, (BITS_PER_KEY * sum(map(len, held)) - 1).bit_length())
    return width, np.concatenate([key_bits(x, level, width).ravel() for level, x in enumerate(held) if len(x)])


def _block(width: int, held: list[tuple[int, int, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    n = len(held)
    grid = np.zeros((1 << width, -(-n // 8) * 8), np.uint8)
    for k, (_, _, bits) in enumerate(held):
        grid[bits, k] = 1
    counts = np.array([c for _, c, _ in held], "<i8")
    return rows(schema, term=[None], df=[None], width=[width], doc_ids=[np.array([d for d, _, _ in held], "<i8").tobytes()], counts=[counts.tobytes()],
                slices=[np.packbits(grid, axis=1, bitorder="little").tobytes()], n_docs=[n], n_terms=[int(counts.sum())])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of whole texts: rows with a block of signatures, and rows with a term's count of documents."""
    schema = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("counts", pa.binary()),
                        ("slices", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def lexicon(seen: Counter) -> pa.RecordBatch:
        none = [None] * len(seen)
        return rows(schema, term=list(seen), df=list(seen.values()), **{c: none for c in schema.names[2:]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        activate("lexical")
        waiting: dict[int, list] = {}
        seen: Counter = Counter()
        for batch, texts in documents(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                seen.update(counts.keys())
                width, bits = signature(counts)
                held = waiting.setdefault(width, [])
                held.append((doc, len(found), bits))
                if len(held) >= min(BLOCK_DOCS, max(8, BLOCK_BITS >> width)):
                    yield _block(width, waiting.pop(width), schema)
            if len(seen) > LEXICON:
                yield lexicon(seen)
                seen = Counter()
        for width, held in waiting.items():
            yield _block(width, held, schema)
        if seen:
            yield lexicon(seen)

    return store(docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, _INDEX), "signatures")


class Queries:
    """Some items with their terms, weights and the size of the corpus; sent to the tasks."""

    def __init__(self, found: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = sorted({r.item_id for r in found})
        number = {i: k for k, i in enumerate(self.items)}
        weigh = lambda df: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        held = sorted((number[r.item_id], bytes(r.term), weigh(r.df)) for r in found)
        self.terms = sorted({t for _, t, _ in held})
        place = {t: k for k, t in enumerate(self.terms)}
        self.item = np.array([i for i, _, _ in held], np.int64)
        self.term = np.array([place[t] for _, t, _ in held], np.int64)
        self.weight = np.array([w for _, _, w in held], np.int64)
        self.hash = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], np.uint64)

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n * self.n_docs) // self.n_terms

    def bounds(self, width: int, n: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds (items x documents of the block) of the scores."""
        marked = np.full((len(self.terms), slices.shape[1]), 255, np.uint8)
        level = np.zeros((len(self.terms), len(n)), np.uint8)
        gains = np.zeros((len(LEVELS) + 1, len(n)), np.int64)
        for k in range(len(LEVELS)):
            marked &= np.bitwise_and.reduce(slices[key_bits(self.hash, k, width)], axis=1)  # a key of a level has those below
            if not marked.any():
                break
            level += np.unpackbits(marked, axis=1, count=len(n), bitorder="little")
            most = np.minimum(LEVELS[k + 1] - 1, n) if k + 1 < len(LEVELS) else n
            gains[k + 1] = (1_000_000_000 * most) // (1000 * most + 20 * self.norm(n))
        out = np.zeros((len(self.items), len(n)), np.int64)
        for a in range(0, len(self.item), 4096):
            part = slice(a, a + 4096)
            item = self.item[part]
            start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            worth = np.take_along_axis(gains, level[self.term[part]].astype(np.intp), axis=0) * self.weight[part, None]
            out[item[start]] += np.add.reduceat(worth, start, axis=0)
        return out

    def score(self, text: str, items: list[int]) -> list[int]:
        """The exact scores of a text for some items (by number)."""
        found = terms(text)
        counts, m = Counter(found), int(self.norm(np.array([len(found)]))[0])
        tf = np.fromiter((counts.get(t, 0) for t in self.terms), np.int64, len(self.terms))
        worth = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
        cuts = np.searchsorted(self.item, np.array([items, np.array(items) + 1]))
        return [int((self.weight[a:b] * worth[self.term[a:b]]).sum()) for a, b in cuts.T]


def _bounds(index: DataFrame, sent, pick) -> DataFrame:
    """(item, doc_id, bound) rows that ``pick(bounds, doc_ids)`` makes, given what it kept of earlier blocks; None: the end."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("bound", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, each = sent.value, pick()
        for batch in batches:
            for width, ids, counts, slices in zip(*(batch.column(c) for c in ("width", "doc_ids", "counts", "slices"))):
                ids, n = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, counts))
                grid = np.frombuffer(slices.as_buffer(), np.uint8).reshape(1 << width.as_py(), -1)
                item, doc, bound = each(queries.bounds(width.as_py(), n, grid), ids)
                if len(item):
                    yield rows(schema, item=item.astype(np.int32), doc_id=doc, bound=bound)
        item, doc, bound = each(None, None)
        yield rows(schema, item=item.astype(np.int32), doc_id=doc, bound=bound)

    blocks = index.filter("slices IS NOT NULL").select("width", "doc_ids", "counts", "slices")
    return blocks.mapInArrow(run, "item int, doc_id bigint, bound bigint")


def _highest(items: int, keep: int):
    """Keeps the documents of the ``keep`` highest bounds per item over all blocks of a task."""
    def start():
        held: list[list] = [[] for _ in range(items)]

        def each(bounds, ids):
            if bounds is None:
                out = [(i, -d, b) for i, heap in enumerate(held) for b, d in heap]
                return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            least = np.array([heap[0][0] if len(heap) == keep else 0 for heap in held])
            for i, k in np.argwhere(bounds > least[:, None]).tolist():
                entry = (int(bounds[i, k]), -int(ids[k]))
                if len(held[i]) < keep:
                    heapq.heappush(held[i], entry)
                elif entry > held[i][0]:
                    heapq.heapreplace(held[i], entry)
            return (np.zeros(0, np.int64),) * 3

        return each

    return start


def _not_excluded(floor: np.ndarray, last: np.ndarray):
    """Every document whose bound is over the item's floor, or on it with a doc_id up to ``last``."""
    def start():
        def each(bounds, ids):
            if bounds is None:
                return (np.zeros(0, np.int64),) * 3
            item, k = np.nonzero((bounds > floor[:, None]) | ((bounds == floor[:, None]) & (bounds > 0) & (ids <= last[:, None])))
            return item, ids[k], bounds[item, k]
        return each

    return start


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scored(docs: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """(item, doc_id, score) of the pairs, from the whole texts; scores of 0 go."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    wanted = store(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "candidates")  # at most the items of one block each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        activate("lexical")
        for batch, texts in documents(batches):
            for doc, items, text in zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist(), texts):
                score = np.array(sent.value.score(text, items), np.int64)
                good = score > 0
                yield rows(schema, item=np.array(items, np.int32)[good], doc_id=np.full(good.sum(), doc), score=score[good])

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(index: DataFrame, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item (item_id, text), blocks of items at a time."""
    spark = docs.sparkSession
    n_docs, n_terms = index.filter("slices IS NOT NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            for item, text in zip(batch.column("item_id").to_pylist(), texts):
                own = sorted(set(terms(text)))
                yield rows(schema, item_id=[item] * len(own), term=own)

    wanted = items.filter("item_id IS NOT NULL").selectExpr("cast(item_id AS bigint) AS item_id", "text").mapInArrow(split, "item_id bigint, term binary").distinct()
    lexicon = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = store(wanted.join(lexicon, "term"), "item-terms")
    blocks = max(1, -(-weighed.count() // PAIRS))
    results = None
    for b in range(blocks):
        found = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "term", "df").collect()
        if not found:
            continue
        queries = Queries(found, n_docs, n_terms)
        sent = spark.sparkContext.broadcast(queries)
        seeds = _bounds(index, sent, _highest(len(queries.items), SEEDS * k)).withColumnRenamed("bound", "score")
        best = _ranked(_scored(docs, _ranked(seeds, SEEDS * k), sent), k).filter(F.col("rank") == k).collect()
        floor, last = np.zeros(len(queries.items), np.int64), np.zeros(len(queries.items), np.int64)
        for r in best:
            floor[r.item], last[r.item] = r.score, r.doc_id
        exact = _scored(docs, _bounds(index, sent, _not_excluded(floor, last)), sent)
        names = F.array(*(F.lit(i) for i in queries.items))
        part = _ranked(exact, k).select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")
        part = store(part, "ranked")
        results = part if results is None else results.union(part)
    return results if results is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Build the index of ``docs`` and search it for every item."""
    return search(build_index(docs), docs, items, k)
