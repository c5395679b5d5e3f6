"""Corpus pipeline: classify by quality, keep one of near copies, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, packing, quality, secrets
from weftline.llm.common import materialize, table
from weftline.llm.queries import VOCABULARY


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    column = "_score"
    while column in docs.columns:
        column += "_"
    return quality.score(docs, model, column=column).where(F.col(column) >= quality.THRESHOLD).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard_join.keep_one(docs, row=jaccard_join.file_row(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text."""
    own = [c for c in docs.columns if c.lower() == "secrets"]  # a column of the input keeps its name and values
    found = secrets.find(docs.withColumnsRenamed({c: "_own_secrets" for c in own}), rewrite=True, dictionary=public_tokenizers.path(VOCABULARY))
    changed = F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*(F.col("_own_secrets" if c in own else c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("secrets", redact), ("packing", pack)]

#: Stages run models, set joins and tokenizers that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
