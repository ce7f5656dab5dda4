"""The kernel model against an explicit kernel ridge solve, and the pipeline's language stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import langid
from panelspark.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SAYINGS = {"en": "the quick brown fox jumps over the lazy dog and then it runs away from the hunter",
           "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann weg vom Jäger",
           "fr": "le rapide renard brun saute par dessus le chien paresseux et puis il se sauve"}


def texts_of(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        lang = sorted(SAYINGS)[k % 3]
        out.append((" ".join(rng.permutation(SAYINGS[lang].split())[:8]), lang))
    return out


def test_weights_are_a_kernel_ridge_solution():
    """With every text a landmark the folded matrix equals the ridge solution in the space the kernel spans, solved densely."""
    texts, languages = map(list, zip(*texts_of(30)))
    model = langid.Model(texts, languages, landmarks=30, ridge=0.1)
    x = langid.presence(texts).astype(float)
    phi = x / np.sqrt(x.sum(axis=1))[:, None]
    y = np.array([[float(a == b) for b in sorted(set(languages))] for a in languages])
    gram = phi @ phi.T
    alpha = np.linalg.solve(gram + 0.1 * np.eye(30), y - y.mean(axis=0))
    new = langid.presence([t for t, _ in texts_of(12, seed=2)])
    want = (new / np.sqrt(new.sum(axis=1))[:, None]) @ phi.T @ alpha + y.mean(axis=0)
    assert np.abs(model.scores(new) - want).max() < 1e-3


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(rows)], SCHEMA)


def test_stage_rejects_by_score(spark, sf):
    good = texts_of(120)
    odd = [("@@@ 11 ### a 22 $$$ %% z 99 ((( )))" * 20, None), ("12 34", None), (None, "en"), ("", None)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs_of(spark, good + odd), sf).collect()}
    assert kept == set(range(120))


def test_stage_keeps_letters_without_labels(spark, sf):
    rows = [("words here", None), ("日本", None), ("12 34 !!", None), (None, None)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs_of(spark, rows), sf).collect()}
    assert kept == {0, 1}


def test_stage_keeps_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.count() >= 0.995 * docs.filter("text rlike '\\\\p{L}'").count()


def test_rejection_score_is_the_least_of_all_labelled_texts(spark):
    """More labelled texts than a sample takes; the weakest one is the last a sample would choose."""
    rows = [("the quick brown fox jumps over the lazy dog", "en")] * 1000
    last = spark.range(len(rows)).orderBy(F.xxhash64("id").desc()).first()[0]
    model = langid.Model(*map(list, zip(*texts_of(90))))
    weak = "the dog and 1234567890 +-*/ @@ ## 44 55 66"
    assert model.predict([weak])[0][0] == "en" and model.predict([weak])[0][1] < 0.8 * model.predict([rows[0][0]])[0][1]
    docs = docs_of(spark, [*rows[:last], (weak, "en"), *rows[last + 1:], ("12 34", "und"), ("der schnelle braune Fuchs", "en")])
    assert abs(langid.rejection_score(docs, model) - langid.MARGIN * model.predict([weak])[0][1]) < 1e-6
    assert langid.rejection_score(docs.filter("lang = 'und'"), model) == 0
