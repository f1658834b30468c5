"""Token counts without ids: pieces are counted once per distinct pre-token.

1. Every task counts its pre-tokens (see ``tokens``), Spark sums them: the vocabulary of the corpus.
2. The pieces of each distinct pre-token are counted once, by the tokenizers library, and written.
3. Per document, the frequencies of its pre-tokens are joined to the piece counts and summed. The
   most frequent pre-tokens, at most ``head``, are sent to the workers, which sum them in place: those of
   more than ``HEAD_BYTES`` as a 128-bit digest, so the table has a fixed bound whatever the corpus, and a
   long url or line that many documents hold is in it too. Every other frequency goes through a shuffle
   join on the pre-token. No pre-token outside the head is frequent, so no key is hot. A pre-token that the
   vocabulary lacks is an error.

Edge cases: a NULL text counts as empty (0 bytes, 0 tokens). Rows are counted one by one, also equal
ones and those with a NULL key. An empty table gives an empty result. The result has the ``keep``
columns and then ``n_bytes, n_tokens``; an input column of one of these names is left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimweave.llm.common import at_most, saved, ship_package, text_of
from dimweave.llm.tokens import chunks, encoder, pieces_of

OUTPUT = ("n_bytes", "n_tokens")
HEAD = 400_000
HEAD_BYTES = 48
_FLUSH = 400_000


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``pretoken, n, pieces``: every distinct pre-token of the whole texts, its count and its ids' number."""

    def counted_batch(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pretoken", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(tokenizer_path).split
        held: Counter[str] = Counter()
        for batch in batches:
            for group in chunks(batch.column(0).to_pylist()):
                for text in group:
                    for part in pieces_of(text):
                        held.update(split(part))
                if len(held) > _FLUSH:
                    yield counted_batch(held)
                    held.clear()
        yield counted_batch(held)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer_path).lengths
        for batch in batches:
            found = pa.array(lengths(batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["pretoken", "n", "pieces"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "pretoken string, n long")
    summed = counted.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(pieces, "pretoken string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = (), text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``keep`` columns, UTF-8 bytes and number of tokens of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    vocab = saved(vocabulary(docs, tokenizer_path, text_col), "vocabulary")
    long = F.octet_length("pretoken") > HEAD_BYTES
    named = F.when(long, F.md5(F.col("pretoken").cast("binary"))).otherwise(F.col("pretoken"))
    first = at_most(vocab, "n", head).select(named.alias("name"), long.alias("long"), "pieces").toPandas()
    parts = [first[first["long"] == kind] for kind in (False, True)]
    top = spark.sparkContext.broadcast([(p["name"].tolist(), p["pieces"].to_numpy(dtype="int32")) for p in parts])

    keep = [c for c in keep if c not in OUTPUT]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    kept = T.StructType([T.StructField(names[c], docs.schema[c].dataType) for c in keep])
    schema = T.StructType([T.StructField("row", T.LongType()), *kept, T.StructField("n_bytes", T.LongType()), T.StructField("pretoken", T.StringType()), T.StructField("n", T.LongType())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(tokenizer_path).split
        short, by_digest = (dict(zip(strings, numbers.tolist())) for strings, numbers in top.value)

        def pieces_of_long(unit: str) -> int | None:
            raw = unit.encode()
            return by_digest.get(hashlib.md5(raw, usedforsecurity=False).hexdigest()) if len(raw) > HEAD_BYTES else None

        known = short.get
        row = TaskContext.get().partitionId() << 40

        def rows_of(kept: list[pa.Array], rows: list[int], n_bytes: list[int | None], words: list[str], times: list[int]) -> pa.RecordBatch:
            new = [pa.array(n_bytes, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *kept, *new], names=schema.names)

        for batch in batches:
            at = 0
            for group in chunks(batch.column(len(keep)).to_pylist()):
                own = [c.slice(at, len(group)) for c in batch.columns[:-1]]
                at += len(group)
                sums, rows, words, times = [], [], [], []
                for i, text in enumerate(group):
                    total, rest = 0, Counter()
                    for part in pieces_of(text):
                        units = split(part)
                        found = list(map(known, units))
                        if None in found:
                            if by_digest:
                                found = [pieces_of_long(u) if p is None else p for u, p in zip(units, found)]
                            rest.update(u for u, p in zip(units, found) if p is None)
                            total += sum(p for p in found if p is not None)
                        else:
                            total += sum(found)
                    sums.append(total)
                    rows += [row + i] * len(rest)
                    words += rest
                    times += rest.values()
                # the row's own sum, under a name that differs from row to row and joins nothing: no pre-token has a space within
                own_rows = list(range(row, row + len(group)))
                yield rows_of(own, own_rows, [len(t.encode()) for t in group], [f"{r} ." for r in own_rows], sums)
                yield rows_of([pa.nulls(len(rows), c.type) for c in own], rows, [None] * len(rows), words, times)
                row += len(group)

    per_doc = docs.select(*(F.col(c).alias(names[c]) for c in keep), text_of(text_col).alias("text")).mapInArrow(frequencies, schema)
    joined = per_doc.join(vocab.select("pretoken", "pieces"), "pretoken", "left")
    lost = F.raise_error(F.concat(F.lit("pre-token without a piece count: "), F.col("pretoken"))).cast("long")
    counted = F.when(F.col("n_bytes").isNotNull(), F.col("n")).when(F.col("pieces").isNull(), lost).otherwise(F.col("n") * F.col("pieces"))
    summed = joined.groupBy("row").agg(
        *(F.max_by(names[c], F.col("n_bytes").isNotNull()).alias(names[c]) for c in keep),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(counted).alias("n_tokens"),
    )
    return summed.select(*(F.col(names[c]).alias(c) for c in keep), "n_bytes", "n_tokens")
