"""Approximate nearest neighbours by inner product: collision counting over single-projection sorted arrays.

Vectors are scaled by the longest norm and given one more coordinate that makes all of them unit
vectors; with the query scaled alike, the largest inner product is the smallest distance. ``lines``
random directions are drawn once from a seed (nothing is fitted). The rows are dealt into blocks of
about ``block_rows``; a block sorts its projections on every line. For a query, a window centred on
its own projection opens on each line; a vector collides on the lines whose window holds it. The
window grows by ``GROWTH`` (virtual rehashing: no index is built anew; later queries start from the width that
was enough for those before) until ``share`` of the block,
and at least ``LEAST_VERIFIED`` of its vectors, collide on ``threshold`` of the lines; those vectors are verified by their exact
inner product in double precision. When the window holds the whole block, all of it is verified.

All queries, in chunks of at most ``query_rows``, meet all blocks; a block returns its ``k`` best per
query, and a query's best ``k`` of all blocks are its result. Every row is indexed.

Edge cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, nor
do rows without an id, nor vectors of another dimension than most have (of two dimensions equally
frequent, the smaller). Rows with one id count once, with the smallest vector. A query's own id is
never its neighbour. With fewer than ``k`` other vectors all are returned. Equal scores are ordered by
id. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dimweave.llm.common import saved, ship_package

LINES = 96
THRESHOLD = 0.5
SHARE = 0.3
LEAST_VERIFIED = 640
FIRST_WINDOW = 0.64
GROWTH = 1.08
BLOCK_ROWS = 8_192
QUERY_ROWS = 32_768
_AT_ONCE = 16


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (doubles) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v"))
    plain = plain.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    one = plain.groupBy("id").agg(F.min("v").alias("v"))
    sizes = plain.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return one.where(F.size("v") == (sizes["dim"] if sizes else 0))


def _unit(x: np.ndarray, longest: float) -> np.ndarray:
    scaled = x / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    return np.hstack([scaled, rest[:, None]])


class Block:
    """Sorted projections of some vectors on all lines, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, directions: np.ndarray):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        at = (_unit(vectors, longest) @ directions).astype("f4").T  # lines, rows
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        # places below 65,536 fit 16 bits (``nearest`` deals no larger blocks): half the memory to count through
        self.kind = "u2" if len(ids) < 1 << 16 else "u4"
        self.place = np.empty(at.shape, dtype=self.kind)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(ids), dtype=self.kind), at.shape), axis=1)
        self.spread = float(at.std()) or 1.0
        self.directions = directions

    def collisions(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """How many windows of ``width`` around each query's projections (queries, lines) hold each row."""
        shape = (len(at), len(self.ids))
        counts = np.zeros(shape, dtype="u1" if len(self.sorted) < 256 else "u2")
        from_low, inside = np.empty(shape, dtype=self.kind), np.empty(shape, dtype=bool)
        for line, (values, place) in enumerate(zip(self.sorted, self.place)):
            low = np.searchsorted(values, at[:, line] - width, "left")
            size = np.searchsorted(values, at[:, line] + width, "right") - low
            # low <= place < low + size: as unsigned numbers, place - low is below size for those alone
            np.subtract(place[None, :], low[:, None].astype(self.kind), out=from_low)
            np.less(from_low, size[:, None].astype(self.kind), out=inside)
            np.add(counts, inside.view("u1"), out=counts, casting="unsafe")
        return counts

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float, share: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, scores) of the best ``k`` of the block."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        at = (unit @ self.directions[:-1]).astype("f4")  # a query's added coordinate is 0
        wanted = min(len(self.ids), max(k + 1, LEAST_VERIFIED, int(np.ceil(share * len(self.ids)))))
        least = max(1, int(np.ceil(threshold * len(self.sorted))))
        widest = float(np.abs(self.sorted).max()) + float(np.abs(at).max()) + 1
        found, opening = [], FIRST_WINDOW * self.spread
        for first in range(0, len(queries), _AT_ONCE):
            left = np.arange(first, min(first + _AT_ONCE, len(queries)))
            width = np.full(len(left), opening, dtype="f4")
            enough = []
            while len(left):
                collide = self.collisions(at[left], width) >= least
                ready = (collide.sum(axis=1) >= wanted) | (width >= widest)
                enough += width[ready].tolist()
                for i, hit in zip(left[ready], collide[ready]):
                    found.append((i, *self.verify(np.flatnonzero(hit), query_ids[i], queries[i], k)))
                left, width = left[~ready], width[~ready] * np.float32(GROWTH)
                # many steps without enough: the block is far from the query, so open the windows fast
                width = np.where(width > 4 * self.spread, 2 * width, width)
            # the next queries' windows open at the median of those that were enough here
            opening = float(np.median(enough))
        return found

    def verify(self, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > k:
            # the product of a matrix adds up in another order: rows that rounding could lift stay
            about = self.vectors[rows] @ query
            slack = 1e-12 * self.longest * np.sqrt(query @ query)
            rows = rows[about >= np.partition(about, len(rows) - k)[len(rows) - k] - slack]
        scores = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def nearest(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", lines: int = LINES, threshold: float = THRESHOLD, share: float = SHARE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on the key column."""
    ship_package(rows.sparkSession)
    usable = saved(usable_vectors(rows, key, vector), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    about = usable.agg(F.count("*").alias("n"), F.max(squares).alias("longest"), F.max(F.size("v")).alias("dim")).first()
    queries = usable.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    blocks = max(1, -(-about["n"] // block_rows))
    query_chunks = max(1, -(-queries.count() // query_rows))
    longest = float(about["longest"] or 1.0) ** 0.5
    directions = np.random.default_rng(seed).standard_normal(((about["dim"] or 0) + 1, lines))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def search(_: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            asked = asked.sort_values("id")
            index = Block(block["id"].to_numpy(), np.stack(block["v"].to_list()), longest, directions)
            ids = asked["id"].to_numpy()
            for i, near, scores in index.search(ids, np.stack(asked["v"].to_list()), k, threshold, share):
                out.append(pd.DataFrame({"query_id": ids[i], "vec_id": near, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    held = usable.select(dealt(blocks).alias("block"), every(query_chunks).alias("chunk"), "id", "v")
    asked = queries.select(every(blocks).alias("block"), dealt(query_chunks).alias("chunk"), "id", "v")
    key_type = usable.schema["id"].dataType.simpleString()
    found = held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(search, f"query_id {key_type}, vec_id {key_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
