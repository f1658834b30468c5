"""The training-data pipeline: stages over ``documents``, each written and read again.

Every stage takes the documents the one before it kept, whole; the first four return the columns of
``documents`` (whatever their names), the last the packed pieces. The folder of the input may be any that
Spark reads.

Edge cases, as tested: a NULL or empty text is scored as an empty text, is no copy of anything, and packs into one
piece with the end id. Rows with a NULL key are never copies, and their labels are not learned from. Repeated
rows are judged one by one until the third stage, where of those with one key and one set of shingles the first by text
stays; rows with one key and other texts are judged by their own texts. Without labels, or with labels of one class,
the first two stages keep everything. Ties at a threshold stay. Empty tables give an empty result. Very long texts
are read whole; the last stage cuts them into pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dimweave.llm import quality, toxicity
from dimweave.llm.common import saved, table
from dimweave.llm.mixing import sample
from dimweave.llm.ngram_join import one_of_each_group
from dimweave.llm.queries import MIX_FRACTION, packed_pieces


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of documents linked by their word shingles."""
    return one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities."""
    return sample(docs, MIX_FRACTION)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the sequences."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

# The stages train models and hash texts, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
