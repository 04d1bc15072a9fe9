"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from lumenfold.llm import decontaminate, exact_dedup, near_copies, packing, simhash, toxicity
from lumenfold.llm.common import Workspace, table
from pyspark.sql import DataFrame, SparkSession


def mild(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.keep_mild(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_distinct(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links, the document with the smallest doc_id; of these, none with four in five five-word shingles of another."""
    return near_copies.without_near_copies(simhash.keep_one_of_each(docs))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark windows in one of twenty words or more."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", mild),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: A trained classifier and a tokenizer cannot be said in SQL; each stage's operator has its own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
