"""A training corpus from raw documents: five stages, each one of the ``llm`` operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
rows as parquet into the shared checkpoint folder and reads them back as the next one's
``docs``; they go when that one has ended.  All stages but the last return the columns of ``documents``; each works on
all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordermill.llm import common, jaccard, langid, mixing, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link (five-word shingles, Jaccard at least 0.8) one stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to the name of its kind in brackets."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

# SQL has neither the tokenizer nor the trained models; tests/llm checks columns, row counts and ids only
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.discard(*before)  # what the stage has read
        before = [docs]
    return docs
