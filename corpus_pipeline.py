"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, substring dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns documents (the last one:
packed pieces). ``run`` writes each stage's result as Parquet in the shared folder and rereads it. SQL cannot express the
stages, so there is no ORACLE_SQL; the tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import langid, packing, simhash, substrings, toxicity
from panelspark.llm.common import remainder, store, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows: those without text or letters go, and those it scores under the rejection score.

    Fitted on four folds of the labelled documents, the score on the fifth. Without any label all documents with letters stay.
    """
    model = langid.fit(docs.filter(remainder(5) != 0))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = langid.rejection_score(docs.filter(remainder(5) == 0), model)
    found = langid.predicted(docs, model, ("_lang_pred", "_score"))
    return found.filter((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_score") >= least)).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, names=("_score", "_predicted")).filter("_predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Rows with one doc_id are one document and stay or go together.
    """
    gone = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document has; untouched texts stay as they are, emptied ones go."""
    cut = substrings.cleaned(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    kept = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", best_fit)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
