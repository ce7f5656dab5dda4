"""Ids of whole texts by the tokenizers library, remembering the ids of words already met."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from panelspark.llm.common import activate, remembered

# A word of letters up to U+00FF (composed already, one lower-case form each), perhaps with one mark behind it.
PLAIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,]?)")
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f", np.uint8))


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different blank-separated words of the texts, the place of every word among them, and each text's first word (and the end)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # starts and ends in turn: the first and last bytes are blanks
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    kept = ~blank
    kept[ends] = True
    spaced = np.where(blank, np.uint8(32), data)[kept]  # every word with one blank behind it
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(spaced)]).dictionary_encode()
    distinct = coded.dictionary.buffers()[2]
    return distinct.to_pybytes().split(b" ")[:len(coded.dictionary)] if distinct else [], coded.indices.to_numpy(), bounds


class WordCoder:
    """Encodes texts with a tokenizer that drops white space.

    Such a tokenizer splits at every ASCII blank before it merges, so a text's ids are the ids of its blank-separated
    words, one after the other. Only words not yet met are given to the library. ``limit`` bounds the remembered words: at
    half of it those met since the last such moment become the earlier ones, so words that keep coming stay.

    Where the tokenizer lower-cases and cuts letters from marks, a plain word needs neither regular expressions nor
    normalisation: its lower-case letters go straight to the library's model. All other words take the whole way.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = remembered("tokens", {})
        self.earlier: dict[bytes, bytes] = remembered("tokens", {})
        self.merge = self.tokenizer.model.tokenize if self._cuts_letters() else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = dict(zip(plain, map(chr, plain))) | {b: chr(256 + i) for i, b in enumerate(rest)}  # the model's sign for each byte

    def _cuts_letters(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})

    def _plain(self, word: str) -> bytes | None:
        """The ids of a plain word."""
        found = PLAIN.fullmatch(word)
        if found is None:
            return None
        letters, sign = found.groups()
        return self._lower(letters.lower()) + (self._lower(sign) if sign else b"")

    def _lower(self, part: str) -> bytes:
        """The ids of lower-case letters or of a mark, remembered as those of a word."""
        word = part.encode()
        ids = self.known.get(word) or self.earlier.get(word)
        if ids is None:
            shown = part if part.isascii() else "".join(map(self.shown.__getitem__, word))
            ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
            self.known[word] = ids
        return ids

    def _learn(self, words: list[bytes]) -> None:
        if self.merge is not None:
            rest = []
            for word in words:
                ids = self._plain(word.decode())
                if ids is None:
                    rest.append(word)
                else:
                    self.known[word] = ids
            words = rest
        for at in range(0, len(words), 1000):
            part = words[at:at + 1000]
            done = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(done.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text begins (and the end).

        Each different word is looked up once; its ids are dealt to its places as arrays.
        """
        activate("tokens")
        distinct, place, bounds = split_words(texts)
        if len(self.known) > self.limit // 2:
            self.earlier.clear()
            self.earlier.update(self.known)
            self.known.clear()
        missed = [w for w in distinct if w not in self.known]
        again = {w: ids for w in missed if (ids := self.earlier.get(w)) is not None}
        self.known.update(again)
        self._learn(sorted(w for w in missed if w not in again))
        held = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first = np.cumsum(sizes) - sizes
        size = sizes[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(held), "<u4")[np.arange(ends[-1]) + np.repeat(first[place] - ends[:-1], size)]
        return ids, ends[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.flat(texts)
        raw, cuts = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder per Python worker and vocabulary."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
