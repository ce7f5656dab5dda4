"""Operator 9: language identification by string kernels.

The kernel of two texts is the number of character n-grams (1 to 3, lower-cased, blanks collapsed, hashed to ``SLOTS``) both
hold, over the root of the product of their own numbers. ``LANDMARKS`` training texts span the Nystroem space; kernel ridge
regression, one language against the rest, is solved in it. A score is linear in a text's presence vector, so landmarks and
coefficients fold into one matrix and batches are scored by a matrix product.

The model is fitted on at most ``PER_LANGUAGE`` texts of each language (a documented bound, chosen by a hash of doc_id)
outside fold 0 of 5. Null texts and texts without a letter are ``und`` with score 0, and so is everything when there is
nothing to learn from. Ties go to the language that sorts first. Texts of any length are scored whole; repeated rows score alike
and count once in the sample, texts under one doc_id are told apart by their hash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import annotated, remainder, store

SLOTS = 1 << 15
PER_LANGUAGE = 500
LANDMARKS = 256
RIDGE = 1e-2
BATCH = 64
UNKNOWN = "und"
MARGIN = 0.9
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, set(text)))


def mark(text: str, into: np.ndarray) -> None:
    """Set the slots of the text's n-grams in a presence vector."""
    points = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le"), "<u4").astype(np.uint32)
    for n in (1, 2, 3):
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ points[k:len(points) - n + 1 + k]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            into[h >> np.uint32(17)] = 1


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(out, texts):
        mark(text, row)
    return out


def packed(texts: list[str]) -> np.ndarray:
    """Presence vectors as bits, 4 KB a text."""
    return np.concatenate([np.zeros((0, SLOTS // 8), np.uint8), *(np.packbits(presence([t]).astype(bool), axis=1) for t in texts)])


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of the rows of two presence matrices."""
    size = np.sqrt(np.outer(x.sum(axis=1), z.sum(axis=1)))
    return (x @ z.T) / np.maximum(size, 1)


class Model:
    """Languages with the folded matrix ``weights`` (slots x languages) and ``bias``; fitted on texts or on ``packed`` ones."""

    def __init__(self, texts: list[str] | np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        x = texts if isinstance(texts, np.ndarray) else packed(texts)
        self.languages = sorted(set(languages))
        y = np.array([[float(lang == own) for own in self.languages] for lang in languages])
        every = max(1, len(x) // landmarks)
        z = unpacked(x[::every][:landmarks])
        values, vectors = np.linalg.eigh(kernel(z, z).astype(float))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.concatenate([kernel(unpacked(x[a:a + BATCH]), z) @ root for a in range(0, len(x), BATCH)])
        self.bias = y.mean(axis=0)
        coefficients = np.linalg.solve(phi.T @ phi + ridge * len(x) / landmarks * np.eye(phi.shape[1]), phi.T @ (y - self.bias))
        self.weights = ((z / np.sqrt(np.maximum(z.sum(axis=1), 1))[:, None]).T @ (root @ coefficients)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] + self.bias

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        s = self.scores(presence(texts))
        best = s.argmax(axis=1)
        return [(self.languages[b], float(min(1.0, max(0.0, s[i, b])))) for i, b in enumerate(best.tolist())]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Packed presence vectors and languages of at most ``per_language`` texts of each language.

    Rows are drawn by a hash of doc_id, half as many again as needed, before they are ranked, so a language that has most
    documents sends few. What reaches the driver is 4 KB a text, however long it is.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    share = F.lit(1.5 * per_language * (1 << 20)) / F.col("n")
    counts = store(known.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")  # a row per language: its size decides the join
    drawn = known.select("doc_id", "lang", F.xxhash64("text").alias("name")).join(counts, "lang")
    drawn = drawn.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share).drop("n").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "name")
    chosen = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    chosen = store(chosen, "language-sample")  # its size decides how it is joined
    texts = known.withColumn("name", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "name"])

    def each(some: list[str]) -> list[tuple]:
        return [(packed([t]).tobytes() if has_letter(t) else None,) for t in some]

    marked = annotated(texts, each, "marks binary").filter("marks IS NOT NULL").select("place", "lang", "doc_id", "name", "marks").distinct()
    found = marked.toPandas().sort_values(["place", "lang", "doc_id", "name"])
    return np.frombuffer(b"".join(found["marks"]), np.uint8).reshape(-1, SLOTS // 8), found["lang"].tolist()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of documents with text and lang; languages alternate in the order of the landmarks."""
    x, languages = sample(docs, per_language)
    return Model(x, languages) if languages else None


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score of every whole text, under ``names``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages

    def each(texts: list[str]) -> list[tuple]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if held.value is not None and has_letter(t)]
        for a in range(0, len(known), BATCH):
            some = known[a:a + BATCH]
            for i, p in zip(some, held.value.predict([texts[i] for i in some])):
                out[i] = p
        return out

    return annotated(docs, each, f"{names[0]} string, {names[1]} double")


def rejection_score(docs: DataFrame, model: Model | None) -> float:
    """The score under which a text is in no known language: ``MARGIN`` of the least score a rightly told text of ``docs`` has.

    ``docs`` are labelled documents that the model was not fitted on; all of them are scored. 0 where nothing tells.
    """
    if model is None:
        return 0.0
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    right = predicted(known, model, ("_told", "_score")).filter((F.col("_told") == F.col("lang")) & (F.col("_told") != UNKNOWN))
    return MARGIN * right.agg(F.coalesce(F.min("_score"), F.lit(0.0))).first()[0]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents outside the held-out fold."""
    model = fit(docs.filter(remainder(5) != 0))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")
