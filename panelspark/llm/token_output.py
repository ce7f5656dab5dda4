"""Operator 1: token ids as word-aligned Simple-8b blocks.

A 64-bit word holds a 4-bit selector and 60 bits of data: selector ``s`` packs ``COUNTS[s]`` ids of ``60 // COUNTS[s]`` bits.
Values of 60 bits or more are escapes: a zero takes their place and (position, value) pairs follow. For every ``BLOCK``
words the payload keeps how many ids come before, so any range of ids is decoded alone. Decoding handles all words of
one selector at once.

A file is Parquet with one record per chunk of consecutive documents: ``part`` (file order), ``before`` (ids of the part
before the chunk), ``doc_ids``, ``counts`` and ``payload``. Null text counts as empty; repeated doc_ids are kept, ordered by
the text's hash; an empty table gives no chunk.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import TASK_CHARS, documents, rows, store
from panelspark.llm.word_tokens import coder

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BLOCK = 1024
CHUNK_IDS = 1 << 16
_HEAD = struct.Struct("<4sQQQ")
_CHUNK = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
_DOC = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2**60."""
    high = (values >> np.uint64(30)).astype(np.int64)
    low = (values & np.uint64((1 << 30) - 1)).astype(np.int64)
    return np.where(high > 0, 30 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int8)


def pack(ids: np.ndarray) -> bytes:
    """The payload of ``ids`` (unsigned, up to 64 bits)."""
    values = np.asarray(ids, np.uint64).copy()
    n = len(values)
    escaped = np.flatnonzero(values >> np.uint64(60))
    exceptions = values[escaped].copy()
    values[escaped] = 0
    # widest[i]: the largest bit length in the window of c ids from i, for growing c; ids past the end are zeros
    need = np.concatenate([_bits(values), np.zeros(60, np.int8)])
    jump, choice = np.ones(n, np.int64), np.full(n, len(COUNTS) - 1)
    widest, size = need, 1
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        while size < c:
            step = min(size, c - size)
            widest = np.maximum(widest[:len(widest) - step], widest[step:])
            size += step
        fits = widest[:n] <= 60 // c
        if not fits.any():
            break
        jump[fits], choice[fits] = c, s
    at, starts, hops = 0, [], jump.tolist()
    while at < n:
        starts.append(at)
        at += hops[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts] if n else starts
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        c, width = int(COUNTS[s]), 60 // int(COUNTS[s])
        for k in range(c):
            words[here] |= padded[starts[here] + k] << np.uint64(k * width)
    offsets = starts[::BLOCK]
    return b"".join([_HEAD.pack(b"S8B1", n, len(words), len(escaped)), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
                     escaped.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()])


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are decoded."""
    magic, n, n_words, n_escaped = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.zeros(0, np.uint64)
    n_blocks = -(-n_words // BLOCK)
    offsets = np.frombuffer(payload, "<u8", n_blocks, _HEAD.size).astype(np.int64)
    words_at = _HEAD.size + 8 * n_blocks
    first = int(np.searchsorted(offsets, start, "right")) - 1
    last = int(np.searchsorted(offsets, stop, "left"))
    words = np.frombuffer(payload, "<u8", min(last * BLOCK, n_words) - first * BLOCK, words_at + 8 * first * BLOCK)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        c, width = int(COUNTS[s]), 60 // int(COUNTS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(c):
            out[to[here] + k] = (words[here] >> np.uint64(k * width)) & mask
    base = int(offsets[first])
    escapes_at = words_at + 8 * n_words
    where = np.frombuffer(payload, "<u8", n_escaped, escapes_at).astype(np.int64)
    a, b = np.searchsorted(where, [base, base + len(out)])
    out[where[a:b] - base] = np.frombuffer(payload, "<u8", n_escaped, escapes_at + 8 * n_escaped)[a:b]
    return out[start - base:stop - base]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, label: str = "tokens") -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write the chunks in ascending doc_id order.

    Rows are dealt by ranges of doc_id before they are encoded, so texts are read once for the bounds and encoded once.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = coder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        names, counts, held, n, before = [], [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"))
            return rows(_CHUNK, part=[part], before=[before], doc_ids=[names], counts=[counts], payload=[payload])

        for batch, texts in documents(batches, 2 * TASK_CHARS):  # the larger, the fewer words are looked up
            for name, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                names.append(name), counts.append(len(ids) // 4 + 1), held.extend((ids, end))
                n += counts[-1]
                if n >= CHUNK_IDS:
                    yield chunk()
                    names, counts, held, n, before = [], [], [], 0, before + n
        if names:
            yield chunk()

    ordered = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    schema = "part int, before bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"
    return store(ordered.mapInArrow(encode, schema), label, "none")


def read_tokens(chunks: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, from the decoded ids."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, before, names, counts, payload = (batch.column(c)[r].as_py() for c in _CHUNK.names)
                raw = memoryview(unpack(payload).astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                yield rows(_DOC, part=[part] * len(names), doc_id=names, within=starts + before, n_tokens=counts,
                           ids_crc32=[zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())])

    parts = chunks.select("part", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))  # one row per file
    found = chunks.mapInArrow(decode, "part int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(base, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
