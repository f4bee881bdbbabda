"""From raw documents to packed training sequences: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. A stage's rows are written and read again before the next begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import materialize, table
from gridloom.llm.exact_dedup import keep_first
from gridloom.llm.packing import packed_documents
from gridloom.llm.pii import sanitised
from gridloom.llm.quality import keep_good
from gridloom.llm.simhash import keep_nearest_first


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do the lines above the limits."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_nearest_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks in place of personal data and of terms that disclose it."""
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies), ("personal data", personal_data), ("packing", packing)]

#: SQL has no tokeniser and no connected components; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
