"""Scores of whole texts in Arrow batches, so other columns keep their type and their NULLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimweave.llm.common import ship_package, text_of

OUTPUT = ("score", "predicted")
Scorer = Callable[[list[str]], np.ndarray]


def score_texts(docs: DataFrame, scorer: Callable[[], Scorer], cut: float, keep: Sequence[str], text_col: str) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` (1 from ``cut`` on); ``scorer`` makes a task's function of texts."""
    ship_package(docs.sparkSession)
    keep = [c for c in keep if c not in OUTPUT]
    schema = T.StructType([*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("score", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            scores = pa.array(of(batch.column(len(keep)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=schema.names)

    chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text_of(text_col).alias("text"))
    rated = chosen.mapInArrow(rate, schema)
    return rated.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_texts(docs: DataFrame, scorer: Callable[[], Scorer], wanted: Callable[[np.ndarray], np.ndarray], text_col: str) -> DataFrame:
    """The rows of ``docs`` whose scores are ``wanted``, with all their columns."""
    ship_package(docs.sparkSession)
    place = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(wanted(of(texts)), pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
