"""From raw documents to packed sequences: toxicity, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from layerkit.llm import nbsvm, packing, simhash, toxicity
from layerkit.llm.common import prepare, table
from layerkit.llm.queries import QUALITY_CUT, TOXIC_CUT
from layerkit.session import stage

# The stages fit models, hash and search; SQL has no words for them.
ORACLE_SQL = None


def _scored(docs: DataFrame, score, model) -> tuple[DataFrame, str]:
    """``docs`` with the score in a column of its own name."""
    taken = {c.lower() for c in docs.columns}
    own = "score"
    while own in taken:
        own += "_"
    return score(docs, model, own), own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on the labelled ones among them, does not find toxic."""
    prepare(spark)
    scored, own = _scored(docs, toxicity.score, toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic"))
    return scored.where(F.col(own) < TOXIC_CUT).drop(own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, finds good."""
    prepare(spark)
    scored, own = _scored(docs, nbsvm.score, nbsvm.fit(docs, table(spark, sf_dir, "labels"), "quality"))
    return scored.where(F.col(own) >= QUALITY_CUT).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by the fingerprints and links of operator 5."""
    prepare(spark)
    return simhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
