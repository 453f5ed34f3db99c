"""A corpus pipeline of the training-data operators: rules, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as Parquet and rereads it as the
next stage's docs. All stages take nulls in any column, empty and very long texts, repeated rows and ids, extra columns, and
tables without rows, which stay without rows. Rows are decided one by one and never by doc_id alone, so rows that share an id
but not a text do not meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm.common import stash, table
from factlake.llm.exact_dedup import drop_copies
from factlake.llm.mixing import mix
from factlake.llm.ngram_join import drop_near_copies
from factlake.llm.packing import pack_documents
from factlake.llm.quality_rules import keep_good

#: Shingles and least Jaccard similarity of near copies; op6's own contract (4 words, 85) binds only its query.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the document and host rules keep. A null or short text fails; rows without source are one host; repeated rows are
    judged and kept each."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without their blanks (null is empty): the longest text, then the smallest
    doc_id (null last), then the smallest fingerprint of all columns; of rows equal in all columns any one."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest doc_id (null last), then the smallest fingerprint of all columns; of
    rows equal in all columns any one. Rows without words stay."""
    return drop_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the last repetition of a row may be its first words alone. Rows without words are taken
    by no mix, equal rows are interchangeable, and null is a source of its own, the last."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and place; repeated rows and rows without doc_id have pieces of their own."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

#: Near copies, mixing by seeded hashes and tokenizers have no SQL form; tests/llm/test_methods.py holds each stage against plain
#: Python, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
