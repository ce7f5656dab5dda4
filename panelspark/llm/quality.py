"""Operator 7: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features for all grades, with ordered
thresholds (the first one free, the others by positive steps). The expected grade and the chance of reaching a grade
(tail probability) are read off; documents are selected by the latter.

Features are the words of a text, the shares of its word shapes in classes, how far its words repeat and its length class,
hashed to slots; those that tell grades apart are kept. The model is fitted on at most ``SAMPLE_ROWS`` rated rows (a
documented bound, chosen by a hash of doc_id) outside fold 1 of 3. Null and empty texts have the length class of no words.
Without ratings, or with one grade only, every document gets that grade (0 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import activate, annotated, documents, remainder, remembered, rows
from panelspark.llm.text_features import LETTERS, Design, adam, bounded_sample, int_bytes, sigmoid, slot_lists, slot_of

SAMPLE_ROWS = 10_000
LEAST_DOCS = 5
CHI2 = 15.0
RIDGE = 2e-4


class Shapes(dict):
    """The shape of a word: runs of upper, lower, digit and other characters, remembered up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
        s = self[word] = "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])[:8]
        return s


_shapes = remembered("quality", Shapes())


def features(text: str) -> set[int]:
    """The slots of a text."""
    activate("quality")
    found = text.split()
    n = len(found)
    names = {f"length {int(math.log2(n + 1))}"}
    if n:
        counts = Counter(map(_shapes.__getitem__, found))
        for shape, c in counts.items():
            names.add(f"shape {shape} {int(math.log2(c / n) - 0.5)}")
        names.add(f"distinct {round(10 * len(set(found)) / n)}")
        names.add(f"word length {round(len(text) / n)}")
        names.add(f"plain {round(10 * (counts['x'] + counts['Xx']) / n)}")
        lines = [line for line in text.split("\n") if line]
        names.add(f"distinct lines {round(10 * len(set(lines)) / max(1, len(lines)))}")
    slots = {slot_of[name] for name in names}
    slots.update(map(slot_of.__getitem__, set(LETTERS.findall(text.lower()))))
    return slots


def fit(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], dict[int, float]]:
    """(thresholds, weight by slot) from the ratings (doc_id, grade: 0, 1, ...) of documents outside the held-out fold."""
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            yield rows(schema, doc_id=batch.column("doc_id"), grade=batch.column("grade"), own=[int_bytes(features(t)) for t in texts])

    usable = ratings.filter("grade IS NOT NULL").filter(remainder(3) != 1).select("doc_id", F.col("grade").cast("int").alias("grade"))
    made = bounded_sample(usable, docs, sample_rows).mapInArrow(run, "doc_id bigint, grade int, own binary")
    least = F.min(F.struct("grade", "own")).alias("least")  # of rows with one doc_id: the same one in every run
    sample = made.groupBy("doc_id").agg(least).select("doc_id", "least.*").toPandas().sort_values("doc_id")
    y = sample["grade"].to_numpy(int)
    if not len(y):
        return [], {}
    top = int(y.max())
    if y.min() == top:
        return [-500.0] * top, {}
    own = Design(slot_lists(sample, "own"))
    slots = np.unique(np.concatenate([own.informative(y > k, LEAST_DOCS, CHI2) for k in range(top)]))
    row, col = own.kept(slots)
    goal = Objective(y, top, row, col, len(slots))
    share = [float(np.clip((y <= k).mean(), 1e-3, 1 - 1e-3)) for k in range(top)]
    start = np.log(np.array(share) / (1 - np.array(share)))
    x = adam(np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2)), np.zeros(len(slots))]), lambda x: goal(x)[1])
    return goal.thresholds(x).tolist(), dict(zip(slots.tolist(), x[top:].tolist()))


class Objective:
    """Mean negative log likelihood of the grades + ridge; parameters: first threshold, logs of the steps to the next, weights."""

    def __init__(self, y: np.ndarray, top: int, row: np.ndarray, col: np.ndarray, k: int):
        self.y, self.top, self.row, self.col, self.k = y, top, row, col, k

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        return x[0] + np.concatenate([[0.0], np.cumsum(np.exp(x[1:self.top]))])

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        y, top, n = self.y, self.top, len(self.y)
        t, w = self.thresholds(x), x[top:]
        z = np.bincount(self.row, w[self.col], minlength=n)
        upper = np.where(y < top, sigmoid(t[np.minimum(y, top - 1)] - z), 1.0)
        lower = np.where(y > 0, sigmoid(t[np.maximum(y - 1, 0)] - z), 0.0)
        inside = np.maximum(upper - lower, 1e-9)
        loss = -np.mean(np.log(inside)) + RIDGE * (w @ w) / 2
        du, dl = upper * (1 - upper) / (inside * n), lower * (1 - lower) / (inside * n)
        gt = -np.bincount(np.minimum(y, top - 1)[y < top], du[y < top], minlength=top) + np.bincount(y[y > 0] - 1, dl[y > 0], minlength=top)
        later = np.cumsum(gt[::-1])[::-1]  # a step moves all later thresholds
        return float(loss), np.concatenate([[later[0]], later[1:] * np.exp(x[1:top]), np.bincount(self.col, (du - dl)[self.row], minlength=self.k) + RIDGE * w])


def tails(text: str, thresholds: list[float], weights: dict[int, float]) -> list[float]:
    """P(grade >= 1), P(grade >= 2), ..."""
    z = sum(weights[s] for s in sorted(features(text) & weights.keys()))
    return [float(sigmoid(z - t)) for t in thresholds]


def graded(docs: DataFrame, model: tuple[list[float], dict[int, float]], grade: int = 1, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_prob (of reaching ``grade``) and selected (tail_prob >= ``least``)."""
    def each(texts: list[str]) -> list[tuple]:
        reached = [tails(t, *model) for t in texts]
        tail = [r[grade - 1] if len(r) >= grade else 0.0 for r in reached]
        return [(float(sum(r)), t, t >= least) for r, t in zip(reached, tail)]

    return annotated(docs, each, "expected_grade double, tail_prob double, selected boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the 0/1 labels: 0 poor, 1 well-formed but toxic, 2 well-formed and not toxic."""
    return labels.filter("quality IN (0, 1)").selectExpr("doc_id", "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade")


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, selected; learns from rated documents outside the held-out fold."""
    return graded(docs.select("doc_id", "text"), fit(docs, grades(labels))).select("doc_id", (remainder(3) == 1).alias("held_out"), "expected_grade", "tail_prob", "selected")
