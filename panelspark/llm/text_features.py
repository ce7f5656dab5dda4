"""Hashed text features and sparse designs that the classifiers share."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import remembered

LETTERS = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 20


class Slot(dict):
    """The slot of a feature name, remembered up to a bound."""

    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        s = self[name] = zlib.crc32(name.encode()) % SLOTS
        return s


slot_of = remembered("quality", Slot())


class WordSlots(dict):
    """The slots of a word and of its first 3, 4 and 5 letters, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        names = [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n)]
        s = self[word] = tuple(zlib.crc32(n.encode()) % SLOTS for n in names)
        return s


word_slots = remembered("toxicity", WordSlots())


def words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def bounded_sample(labels: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """``labels`` (doc_id, ...) with the text of ``docs``, at most ``most`` labels, chosen by a hash of doc_id.

    The choice is made on the narrow label rows; being bounded, it is broadcast and no text is shuffled.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Design:
    """Rows of distinct slots as flat arrays, restricted to the slots that tell the classes apart."""

    def __init__(self, slots: list[np.ndarray]):
        self.n = len(slots)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in slots])
        self.col = np.concatenate([*slots, np.zeros(0, np.int32)]).astype(np.int32)

    def informative(self, positive: np.ndarray, least_docs: int, chi2: float) -> np.ndarray:
        """Slots of at least ``least_docs`` rows whose chi-square against the 0/1 outcome reaches ``chi2``."""
        total = np.bincount(self.col, minlength=SLOTS)
        hit = np.bincount(self.col[positive[self.row]], minlength=SLOTS)
        n, p = self.n, float(positive.sum())
        expected = total * p / max(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (hit - expected) ** 2 * (1 / expected + 1 / (total - expected) + 1 / (p - expected) + 1 / (n - p - total + expected))
        return np.flatnonzero((total >= least_docs) & (np.nan_to_num(score) >= chi2))

    def kept(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the entries on ``slots``."""
        place = np.full(SLOTS, -1, np.int32)
        place[slots] = np.arange(len(slots), dtype=np.int32)
        at = place[self.col]
        return self.row[at >= 0], at[at >= 0]


def adam(start: np.ndarray, gradient, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Minimise by the gradient, from ``start``."""
    x, m, v = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def slot_lists(frame: DataFrame, column: str) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i4") for b in frame[column]]


def int_bytes(values) -> bytes:
    return np.fromiter(values, "<i4").tobytes()


