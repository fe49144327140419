"""The corpus pipeline: from raw documents to packed training sequences, each stage working on all that the one before kept.

Texts stay whole; a stage either drops documents or changes texts, and all but the last return the columns of ``documents``.
Documents with NULL ids go through every stage by their own text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.minhash import near_duplicates
from plantscope.llm.packing import pack_documents
from plantscope.llm.quality import keep_good
from plantscope.llm.registry import table
from plantscope.llm.secrets import mask_secrets
from plantscope.llm.suffixes import without_repeats
from plantscope.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules accept; the others go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Rows equal in every column go down to one; rows that share an id but differ in text or elsewhere all stay (they are
    different documents, and which one stayed must not depend on the order rows arrive in). Documents without id stay.
    """
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return left.where("doc_id is not null").dropDuplicates().unionByName(left.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty bytes or more that an earlier document holds as well."""
    return without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 2048."""
    return pack_documents(docs, remember=False)  # workers stay for the stages of a next run, which need the memory


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("repeated passages", repeats),
    ("secret scan", secrets),
    ("packing", packing),
]
#: Neither the weighed rules, nor the character models, nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
