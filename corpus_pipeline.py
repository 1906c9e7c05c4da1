"""A corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Every stage takes whole texts and any further columns. Rows that repeat are rows of their own until near duplicates, where
one of each stays. Null and empty texts go with the quality rules; a stage that meets them all the same (called by itself)
keeps them as texts without words. An empty table passes every stage as an empty one. Null doc_ids stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import neardup, packing, pii, quality, toxicity
from plumbline.llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: 50 words or more, little repetition, few symbols; null and empty texts go."""
    return quality.accepted(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of the labels outside the held-out rows.

    Without labels of both classes nothing is toxic. Null and empty texts have no evidence and stay.
    """
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8), that of the least doc_id.

    Texts without words are like no other and stay; of rows with equal doc_id and text one stays.
    """
    return neardup.deduplicated(docs, size=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars of the masked text; every row stays."""
    return pii.masked(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens; an empty text is its end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", clean), ("toxicity", civil), ("near_duplicates", distinct), ("pii", private), ("packing", packed)]
#: Trained models, probabilistic candidates and greedy packing can't be put in SQL; tests/llm check every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
