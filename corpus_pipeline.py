"""Corpus cleaning: quality, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, read back from Parquet. All but the last
return the columns of ``documents``: the classifier's rejects, all but one of each group of equal texts, and all but one
of each component of near copies (five-word shingles, similarity 0.8 or more) are gone, and personal data is masked in
the texts that remain. The last stage gives the packed pieces. Nulls, empty texts, ties, repeated rows and empty tables
are handled as the operators' docstrings say; without labels the first stage keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, ngram_join, packing, pii, quality
from tallyframe.llm.common import documents, read_table, staged


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be good and clean."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, span model and tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k}")
    return docs
