"""Operator 10: bounded-space online best-fit packing.

Pieces arrive one by one; a fixed number of sequences is open. The open sequences' free spaces are bits of one integer, so
the tightest sequence that a piece fits is the lowest set bit at or above its length. When none fits and all places are
taken, the fullest open sequence closes. Pieces are dealt to groups of about ``GROUP_TOKENS`` tokens by a hash of the
document and piece, so a group is bounded whatever the input, and each group packs alone.

Null text is empty (one piece that holds the end id). Repeated doc_ids are packed as separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelspark.llm.common import documents, rows, store
from panelspark.llm.word_tokens import coder

GROUP_TOKENS = 1 << 26
OPEN = 256
_PIECE = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class BestFit:
    """An online packer: ``place(length)`` gives (sequence, offset)."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.free = 0  # bit f: some open sequence has f tokens free
        self.open: dict[int, list[int]] = {}
        self.count = self.made = 0

    def _take(self, space: int) -> int:
        held = self.open[space]
        sequence = held.pop()
        if not held:
            del self.open[space]
            self.free ^= 1 << space
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError("a piece holds between 1 token and a whole sequence")
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.count == self.places:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, sequence = self.capacity, self.made
            self.made += 1
        if space > length:
            self.open.setdefault(space - length, []).append(sequence)
            self.free |= 1 << (space - length)
            self.count += 1
        return sequence, self.capacity - space


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: doc_id, copy, piece, start, length, ids_crc32.

    ``copy`` tells rows with the same doc_id apart (a number of the row).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = coder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch, texts in documents(batches):
            out: dict[str, list] = {n: [] for n in _PIECE.names}
            for name, copy, ids in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), encoder.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for n, v in zip(_PIECE.names, (name, copy, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[n].append(v)
            yield rows(_PIECE, **out)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return numbered.mapInArrow(cut, "doc_id bigint, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(cut: DataFrame, capacity: int, places: int = OPEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces (any frame with doc_id, copy, piece, length)."""
    total = cut.agg(F.sum("length")).first()[0] or 0  # one number
    groups = max(1, -(-total // group_tokens))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)))
    schema = T.StructType(list(dealt.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def fill(held: pa.Table) -> pa.Table:
        held = held.sort_by([("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        packer, group = BestFit(capacity, places), held.column("pack_group")[0].as_py()
        placed = np.array([packer.place(n) for n in held.column("length").to_pylist()], np.int64).reshape(-1, 2)
        return held.append_column("sequence_id", pa.array(placed[:, 0] + (group << 40))).append_column("offset", pa.array(placed[:, 1].copy()))

    return dealt.groupBy("pack_group").applyInArrow(fill, schema).drop("pack_group")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    cut = store(pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
