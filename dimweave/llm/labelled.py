"""Labelled rows of the training fold, the only rows a classifier learns labels from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimweave.llm.common import is_training_row, saved, ship_package, text_of

PER_CLASS = 4_000


def label_shares(labels: DataFrame, label: str, key: str = "doc_id") -> dict[int, int]:
    """How many training rows each class has."""
    return {r["label"]: r["count"] for r in _training(labels, label, key).groupBy("label").count().collect()}


def _training(labels: DataFrame, label: str, key: str) -> DataFrame:
    """``key, label`` of the training fold; a key labelled more than once has the rounded mean, ties are 1."""
    usable = labels.where(is_training_row(F.col(key)) & F.col(key).isNotNull() & F.col(label).isNotNull())
    return usable.groupBy(key).agg(F.when(F.avg(label) >= 0.5, 1).otherwise(0).alias("label"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """``text, label`` of at most ``per_class`` training rows of each class, chosen by a hash of the key."""
    rows = _training(labels, label, key)
    order = [F.xxhash64(key), F.col(key)]
    chosen = rows.where("label = 1").orderBy(*order).limit(per_class).unionByName(rows.where("label = 0").orderBy(*order).limit(per_class))
    return _labelled(_texts(docs, key, text_col), chosen, key).select("text", "label")


def training_features(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[str], list[float]], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``x, label`` of all training rows, ``x`` the features of the text.

    Labels may be as many as the documents, so a join of them can be a shuffle. The texts stay where they lie: they become
    features before the join, with or without a label, and the join moves a key and numbers a row.
    """
    texts = _texts(docs, key, text_col)
    schema = T.StructType([texts.schema["doc_key"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=schema.names)

    return _labelled(texts.mapInArrow(measure, schema), _training(labels, label, key), key).select("x", "label")


def _texts(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """``doc_key, text`` of the training fold."""
    ship_package(docs.sparkSession)
    return docs.where(is_training_row(F.col(key))).select(F.col(key).alias("doc_key"), text_of(text_col).alias("text"))


def _labelled(docs: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``docs`` with the labels of their keys. The chosen keys are written first, so Spark knows their size when it joins them."""
    chosen = saved(chosen.withColumnRenamed(key, "chosen_key"), "labelled")
    return docs.join(chosen, F.col("doc_key") == F.col("chosen_key"))
