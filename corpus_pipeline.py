"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

All stages but the last return the columns of ``documents``.  A run writes each stage's result to the
shared folder and reads it again.

Defined cases: null and empty texts, and texts without a letter, go in the language stage; rows without an id pass all filters and are packed under a null id;
of repeated rows one stays; rows that share an id are decided each by its own text; an empty table gives empty stages; long texts are read whole; extra
columns pass through the filters, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm import decontam, jaccard_join, langid, packing, toxicity
from chunkwell.llm.common import materialise, table
from chunkwell.llm.queries import RANKS, TOKENIZER

#: Near duplicates on word shingles: five words, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language codes in fewer bits than plain bytes take, go."""
    return langid.keep_known(docs, langid.fit(docs))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: of those with its smallest id, the one with the smallest hash of the text."""
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a benchmark item occurs go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs, TOKENIZER, RANKS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers, the components and the packing can't be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
