"""Operator 2: byte-pair encoding by dynamic programming over prefixes, and decoding.

A vocabulary's merges give every token two halves and a rank. For each prefix of a piece the table holds the one token that
ends it: among the vocabulary's tokens that are suffixes of the prefix (an automaton names them, longest first) it is the
one that may stand after the last token of the prefix before it. Two tokens may stand side by side when no merge across
their border would have come before the merges that formed them. Following the table backwards from the end gives the
ids that merging in rank order gives.

Texts are cut at the special tokens and then into pieces by the vocabulary's pattern; nothing merges across a cut. A piece is
encoded once per worker while it is remembered. Null text is empty: no ids. Rows are independent, so repeated rows and
extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelspark.llm.common import activate, documents, remembered, rows

# The split pattern of byte-level vocabularies, with white space spelled out.
BLANK = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCoder:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.rank: dict[int, int] = {}  # of a pair of tokens, as left << 32 | right
        self.formed: dict[int, tuple[int, int, int]] = {}  # token: rank, left half, right half
        for r, (left, right) in enumerate(map(lambda m: m if isinstance(m, list) else m.split(" "), spec["model"]["merges"])):
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a << 32 | b] = r
            self.formed.setdefault(whole, (r, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            if len(token) == 1 or i in self.formed:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.limit = limit
        self.pairs: dict[int, bool] = remembered("bpe", {})
        self.known: dict[str, bytes] = remembered("bpe", {})

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before those that form them."""
        key = a << 32 | b
        before = None
        never = (-1, a, a)
        while True:
            r = self.rank.get(a << 32 | b)
            if r is not None and (before is None or r < before):
                result = False
                break
            (ra, _, right), (rb, left, _) = self.formed.get(a, never), self.formed.get(b, never)
            if ra < 0 and rb < 0:
                result = True
                break
            if ra > rb:  # undo the later merge; of equal ranks the right one came later
                before, a = ra, right
            else:
                before, b = rb + 1, left
        if len(self.pairs) > 2 * self.limit:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        last, length = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if n < end:
                left = last[end - n]
                if left < 0:
                    continue
                fine = pairs.get(left << 32 | token)
                if not (self._side_by_side(left, token) if fine is None else fine):
                    continue
            last[end], length[end] = token, n
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        activate("bpe")
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
                continue
            found = self.pattern.findall(part)
            new = set(found).difference(self.known)
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(found)
            for p in new:
                self.known[p] = np.array(self.piece(p.encode()), "<u4").tobytes()
            out.extend(map(self.known.__getitem__, found))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, PrefixCoder] = {}


def prefix_coder(path: str) -> PrefixCoder:
    """One coder per Python worker and vocabulary."""
    if path not in _coders:
        _coders[path] = PrefixCoder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, schema = prefix_coder(vocabulary), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch, texts in documents(batches):
            yield rows(schema, doc_id=batch.column("doc_id"), ids=[coder.encode(t) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of encoded documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, schema = prefix_coder(vocabulary), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in batches:
            yield rows(schema, doc_id=batch.column("doc_id"), text=[coder.decode(i or b"") for i in batch.column("ids").to_pylist()])

    return encoded.mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = prefix_coder(vocabulary)
        for batch, texts in documents(batches):
            ids = [coder.encode(t) for t in texts]
            yield rows(_OUT, doc_id=batch.column("doc_id"), n_tokens=[len(i) // 4 for i in ids], ids_sha256=[hashlib.sha256(i).hexdigest() for i in ids],
                       decoded_sha256=[hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
