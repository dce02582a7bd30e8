"""Training-corpus pipeline: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import curriculum, order_minhash, pieces, private, quality
from granary.session import materialize
from granary.sources.tables import Tables


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier predicts as good; all of them if there are no labels to learn from.

    The trees learn from the labelled documents among ``docs`` that are not held out.
    """
    forest = quality.train(docs, Tables(spark, folder).labels)
    if not len(forest.roots):
        return docs
    return quality.good_documents(docs, forest)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.without_near_duplicates(docs)


def redact_private(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return private.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return curriculum.mixed(docs, curriculum.training_plan(docs))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every document (as digests) and their number."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", redact_private),
    ("mix", mix_sources),
    ("encode", encode),
]

#: trained trees, sketches and codecs are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
