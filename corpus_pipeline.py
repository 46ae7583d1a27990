"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of documents.  Rejected documents, copies and contaminated documents
are gone after their stage; personal data are replaced in the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselens.llm import contextual_pii, near_copies, packing, quality_rules, tiling, vptree
from clauselens.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rules and go.  Repeated rows are
    judged alike and stay repeated.  An empty table gives no rows.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest key.

    Groups are joined by fingerprints at most two bits apart (vantage-point trees), and
    by exact similarity of 0.8 in 5-word shingles, which fingerprints alone would miss.

    Null and empty texts are one group.  Equal rows of one key stay once.  Rows
    without a key stand behind the others of their group.  An empty table gives no rows.
    """
    return vptree.one_of_each(docs, also=near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    Null and empty texts cover none and stay, as do all rows if the benchmark is
    empty.  Repeated rows are judged alike.  An empty table gives no rows.
    """
    return tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kinds of personal data in place of these, and ``n_chars`` counted again.

    Null texts stay null, empty ones empty.  Repeated rows are changed alike and
    stay repeated.  An empty table gives no rows.
    """
    return contextual_pii.redact(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens, one row for each.

    Null and empty texts are their end id alone.  Repeated rows are packed once each.  An empty table gives no rows.
    """
    return packing.piece_digests(packing.pack(docs))


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("private_data", private_data), ("packing", packed),
]

# Hashed weights, fingerprints, the pattern graph and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
