"""Corpus pipeline: language ID, exact dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. A document is named by its doc_id: rows that repeat one share its fate, rows without one are never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import decontaminate, exact_dedup, language, near_dups, packing
from quarrystone.llm.common import read_table, stored, without

#: Least share of a document's letters in its main language.
LEAST_SHARE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or no language for most of their letters."""
    model = language.train(docs.where(language.fold() != 0))
    found = language.predict(docs, model)
    return without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return without(docs, exact_dedup.exact_groups(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the document with the smallest doc_id stays."""
    return without(docs, near_dups.jaccard_components(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language models, sketches and token packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
