"""A corpus pipeline over the table documents: quality, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A stage
is written as Parquet and read again before the next one works on all that it kept. Null or empty texts, repeated
rows and rows without a doc_id are handled as the operators' docstrings say; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapforge.llm import common, exact, minhash, packing, passages, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the training fold of labels, looked up in docs."""
    return quality.accepted(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")), threshold=0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space the longest stays."""
    return exact.without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.one_of_each(docs, percent=75)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are taken out; a document without other words goes."""
    left = passages.removed_passages(docs, least=50)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, each ended by id 0, in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024, payload="ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-duplicates", near_stage),
    ("repeated passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a trained network, chaining or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
