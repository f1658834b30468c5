"""Token ids of a corpus in binary files of directly addressable codes, in ascending key order.

``write_token_files`` sorts the documents by key over the cluster (range partitions), encodes every
whole text, appends the end id and writes chunks of whole documents. A chunk is one row of a Parquet
folder, so any store Spark reaches can hold it: ``part, chunk`` (its place), ``keys``, ``ends`` (where
each document's ids end within the chunk) and ``ids``, the binary file of ``dac``.
``read_token_files`` opens each chunk and reads every document's ids by its address.

Edge cases: a NULL text is encoded as empty, so it holds the end id alone. NULL keys come first; rows
with equal keys are ordered by text, and equal rows are all kept. A document longer than a chunk is a
chunk of its own. An empty table gives empty files. Only the key column is stored, other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dimweave.llm.common import saved, ship_package, text_of
from dimweave.llm.dac import DAC, encode
from dimweave.llm.tokens import chunks, encoder

CHUNK_TOKENS = 1 << 19


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> None:
    ship_package(docs.sparkSession)
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, chunk = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, ends, held = [], [], []

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            ids = encode(np.frombuffer(b"".join(held), "<u4"))
            columns = [
                pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([keys], pa.list_(kind)),
                pa.array([ends], pa.list_(pa.int64())), pa.array([ids], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            at, names, kind = 0, batch.column(0).to_pylist(), batch.column(0).type
            for group in chunks(batch.column(1).to_pylist()):
                for ids in coder.encode(group):
                    tokens = len(ids) // 4 + 1
                    if ends and ends[-1] + tokens > chunk_tokens:
                        yield flush(kind)
                        keys, ends, held, chunk = [], [], [], chunk + 1
                    keys.append(names[at])
                    ends.append((ends[-1] if ends else 0) + tokens)
                    held += (ids, end)
                    at += 1
        if ends:
            yield flush(kind)

    ordered = (
        docs.select(F.col(key).alias("key"), text_of(text_col).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
    )
    ordered.mapInArrow(pack, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, ids``: per document how many ids lie before it, and its ids as little-endian unsigned 32-bit bytes."""
    ship_package(spark)
    files = spark.read.parquet(path)
    key_type = files.schema["keys"].dataType.elementType
    sizes = files.select("part", "chunk", F.element_at("ends", -1).alias("n"))
    within = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the writing job: the only place where the order of all parts matters
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "chunk", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("chunk_start"))
    starts = starts.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("at"))
    # written first: Spark then knows how small it is, and need not shuffle the files to join them
    placed = files.join(saved(starts, "starts"), ["part", "chunk"])
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ends, ids, at in zip(*batch.columns):
                codes, ends, at = DAC(ids.as_py()), ends.as_py(), at.as_py()
                begins = [0, *ends[:-1]]
                data = [codes.between(b, e).astype("<u4").tobytes() for b, e in zip(begins, ends)]
                columns = [keys.values, pa.array([at + b for b in begins], pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return placed.select("keys", "ends", "ids", "at").mapInArrow(read, schema).withColumnRenamed("key", key)
