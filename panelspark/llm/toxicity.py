"""Operator 6: toxicity by a counterfactual-regularised classifier.

Logistic regression on the words a text holds and on their first letters (so that forms of a stem share weight). For every labelled text that names a group, twins are made in which each
identity term is swapped for the others of its kind (in four languages); the loss adds ``fairness`` times the squared change of the logit, so the
weight cannot rest on which group is named. ``neutral`` mentions of a group then score as the rest of the text does.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows (a documented bound, chosen by a hash of doc_id) of the folds
other than 1 of 3 and holds a few thousand weights. Null and empty texts score by the intercept; without labelled rows of
both classes the score is the share of the class there is (0 without any). Repeated rows score alike; of the rows of one doc_id
the least one trains. Texts of any length are scored whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import activate, annotated, documents, remainder, rows, store
from panelspark.llm.text_features import adam, bounded_sample, int_bytes, sigmoid, word_slots, words

SAMPLE_ROWS = 10_000
THRESHOLD = 0.7
FAIRNESS = 4.0
RIDGE = 0.01
LEAST_DOCS = 5
CHI2 = 30.0
# Identity terms by kind, in English, French, German and Spanish: fixed values. A term is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"), ("disabled", "able"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("fille", "garçon"), ("elle", "il"), ("elles", "ils"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"), ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("noirs", "blancs", "asiatiques"), ("noir", "blanc", "asiatique"), ("immigrés", "autochtones"), ("vieux", "jeunes"), ("homosexuel", "hétérosexuel"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("sie", "er"), ("ihre", "seine"),
    ("muslime", "christen", "juden", "hindus", "atheisten"), ("muslimisch", "christlich", "jüdisch", "hinduistisch", "atheistisch"),
    ("schwarze", "weiße", "asiatische"), ("einwanderer", "einheimische"), ("alte", "junge"), ("homosexuell", "heterosexuell"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("niña", "niño"), ("ella", "él"), ("ellas", "ellos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"), ("musulmán", "cristiano", "judío", "hindú", "ateo"),
    ("negros", "blancos", "asiáticos"), ("negro", "blanco", "asiático"), ("inmigrantes", "nativos"), ("viejos", "jóvenes"), ("homosexuales", "heterosexuales"),
)


def swapped(found: set[str], kinds=IDENTITIES, step: int = 1) -> set[str]:
    """The words of a twin text: every identity term replaced by the one ``step`` places on in its kind."""
    other = {t: kind[(i + step) % len(kind)] for kind in kinds for i, t in enumerate(kind)}
    return {other.get(w, w) for w in found}


def twins(found: set[str], kinds=IDENTITIES) -> list[set[str]]:
    """The different twins of a text: every other term of each kind is tried."""
    out: list[set[str]] = []
    longest = max((len(k) for k in kinds if found & set(k)), default=1)
    for step in range(1, longest):
        twin = swapped(found, kinds, step)
        if twin != found and twin not in out:
            out.append(twin)
    return out


def slots_of(found: set[str]) -> set[int]:
    activate("toxicity")
    return set().union(*map(word_slots.__getitem__, found))


def _design(labelled: DataFrame, kinds) -> DataFrame:
    """Per labelled text: its slots, and per twin the slots it gains (as ``slot``) and loses (as ``-1 - slot``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("own", pa.binary()), ("twins", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            found = [words(t) for t in texts]
            slots = [slots_of(w) for w in found]
            changed = [[(own, slots_of(t)) for t in twins(w, kinds)] for w, own in zip(found, slots)]
            yield rows(schema, doc_id=batch.column("doc_id"), toxic=batch.column("toxic"), own=[int_bytes(s) for s in slots],
                       twins=[[int_bytes([*(t - own), *(-1 - s for s in own - t)]) for own, t in each] for each in changed])

    made = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id bigint, toxic int, own binary, twins array<binary>")
    least = F.min(F.struct("toxic", "own", "twins")).alias("least")  # of rows with one doc_id: the same one in every run
    return made.groupBy("doc_id").agg(least).select("doc_id", "least.*")


def _informative(design: DataFrame, n: int, positive: int) -> np.ndarray:
    """Slots (sorted) of at least ``LEAST_DOCS`` texts whose chi-square against the label reaches ``CHI2``; counted on the executors."""
    schema = pa.schema([("slot", pa.int32()), ("total", pa.int64()), ("hit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, "<i4") for b in batch.column("own").to_pylist()]
            slot, at = np.unique(np.concatenate([*own, np.zeros(0, np.int32)]), return_inverse=True)
            toxic = np.repeat(batch.column("toxic").to_numpy(), [len(o) for o in own])
            yield rows(schema, slot=slot, total=np.bincount(at, minlength=len(slot)), hit=np.bincount(at, toxic, len(slot)).astype(np.int64))

    counts = design.mapInArrow(run, "slot int, total bigint, hit bigint").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    e = F.col("total") * F.lit(positive / n)
    parts = sum((F.try_divide(F.lit(1.0), x) for x in (e, F.col("total") - e, positive - e, n - positive - F.col("total") + e)), F.lit(0.0))
    kept = counts.filter((F.col("total") >= LEAST_DOCS) & ((F.col("hit") - e) * (F.col("hit") - e) * parts >= CHI2)).select("slot").collect()
    return np.sort(np.array([r.slot for r in kept], np.int32))


def _restricted(design: DataFrame, slots: np.ndarray) -> DataFrame:
    """The design on the kept slots, by their place: own, and the twins' changes (place, or -1 - place where lost)."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("own", pa.binary()), ("twins", pa.list_(pa.binary()))])

    def kept(raw: bytes) -> bytes:
        signed = np.frombuffer(raw, "<i4")
        slot = np.where(signed < 0, -1 - signed, signed)
        at = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
        good = slots[at] == slot if len(slots) else np.zeros(len(slot), bool)
        return np.where(signed < 0, -1 - at, at)[good].astype("<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(schema, doc_id=batch.column("doc_id"), toxic=batch.column("toxic"), own=[kept(b) for b in batch.column("own").to_pylist()],
                       twins=[[kept(t) for t in each] for each in batch.column("twins").to_pylist()])

    return design.mapInArrow(run, "doc_id bigint, toxic int, own binary, twins array<binary>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fairness: float = FAIRNESS, kinds=IDENTITIES) -> tuple[float, dict[int, float]]:
    """(intercept, weight by slot) from the labels (doc_id, toxic) of documents outside the held-out fold.

    The sample stays on the executors until it is cut to the slots that tell the classes apart.
    """
    usable = labels.filter("toxic IN (0, 1)").filter(remainder(3) != 1).select("doc_id", "toxic")
    design = store(_design(bounded_sample(usable, docs, sample_rows), kinds), "toxicity-sample")
    n, positive = design.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return -500.0, {}
    if positive in (0, n):
        return (500.0 if positive else -500.0), {}
    slots = _informative(design, n, positive)
    sample = _restricted(design, slots).toPandas().sort_values("doc_id")
    y = sample["toxic"].to_numpy(float)

    def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        held = [np.frombuffer(x, "<i4") for x in parts]
        return np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate([*held, np.zeros(0, np.int32)]).astype(np.int64)

    changes = [t for each in sample["twins"] for t in each]
    pair, change = flat(changes)
    goal = Objective(y, *flat(list(sample["own"])), pair, np.where(change < 0, -1 - change, change), np.where(change < 0, -1.0, 1.0), len(changes), len(slots), fairness)
    x = adam(np.concatenate([[np.log(y.mean() / (1 - y.mean()))], np.zeros(len(slots))]), lambda x: goal(x)[1])
    return float(x[0]), dict(zip(slots.tolist(), x[1:].tolist()))


class Objective:
    """Mean log loss + ridge + ``fairness`` x mean squared change of the score (before the sigmoid) between a text and its twins."""

    def __init__(self, y, row, col, pair, t_col, sign, pairs: int, k: int, fairness: float):
        """Entries (row, col) of the texts; entries (pair, t_col, sign) of what the twins gain (1) and lose (-1)."""
        self.y, self.row, self.col, self.pair, self.t_col, self.sign, self.pairs, self.k, self.fairness = y, row, col, pair, t_col, sign, pairs, k, fairness

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        w, n = x[1:], len(self.y)
        logit = x[0] + np.bincount(self.row, w[self.col], minlength=n)
        loss = np.mean(np.logaddexp(0, logit) - self.y * logit) + RIDGE * (w @ w) / 200
        miss = (sigmoid(logit) - self.y) / n
        g = np.concatenate([[miss.sum()], np.bincount(self.col, miss[self.row], minlength=self.k) + RIDGE * w / 100])
        if self.pairs:
            change = np.bincount(self.pair, self.sign * w[self.t_col], minlength=self.pairs)
            loss += self.fairness * np.mean(change ** 2)
            g[1:] += np.bincount(self.t_col, self.sign * (2 * self.fairness * change / self.pairs)[self.pair], minlength=self.k)
        return float(loss), g


def score_texts(texts: list[str], intercept: float, weights: dict[int, float]) -> list[float]:
    out = []
    for text in texts:
        slots = slots_of(words(text)) & weights.keys()
        out.append(float(sigmoid(intercept + sum(weights[s] for s in sorted(slots)))))
    return out


def scored(docs: DataFrame, model: tuple[float, dict[int, float]], threshold: float = THRESHOLD,
           names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted of every whole text, under ``names``."""
    def each(texts: list[str]) -> list[tuple]:
        return [(s, int(s >= threshold)) for s in score_texts(texts, *model)]

    return annotated(docs, each, f"{names[0]} double, {names[1]} int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the model learns from the labelled documents outside the fold."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")
