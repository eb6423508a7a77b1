"""A corpus in five stages: quality, exact copies, near copies, personal data, packed sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, ngram_join, packing, pii, quality
from lectern.llm.shared import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality scorer rejects; null and blank texts score 0 and go."""
    return quality.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space; see exact_dedup.kept for ties and repeated ids."""
    return exact_dedup.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents with a Jaccard similarity of 0.8 or more over 5-word shingles."""
    return ngram_join.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms masked in the texts; n_chars follows, no row goes."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text is empty."""
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("PII", private), ("packing", packed)]

#: SQL expresses neither the trained scorer nor the tokenizer; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written as Parquet under the shared checkpoint folder and read
    again by the next one; the last hand-over stays there, as the result is read from it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
