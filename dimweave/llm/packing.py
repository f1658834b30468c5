"""Packing documents into sequences: best-fit decreasing, certified by lower bounds, repacked where a gap is left.

1. Every whole text is encoded and cut into pieces of at most ``capacity`` ids (the end id appended;
   only a longer document has more than one piece). The pieces and their ids are written once.
2. The pieces' lengths (never their ids) are dealt into partitions of about ``per_part`` pieces. Each
   packs its pieces by best-fit decreasing and computes lower bounds of its bin count from
   dual-feasible functions. Equal counts certify the partition as optimal.
3. A partition with a gap gives the pieces of all its open bins to an exchange, a certified one those
   of its emptiest bin only (their empty space lies in different partitions). The exchanged bins are
   dealt anew, the pieces of each deal packed again, and the new bins kept if they are fewer. This
   goes on until the exchange fits one deal, nothing is left to exchange or ``rounds`` are over.

Edge cases: a NULL or empty text is one piece that holds the end id alone. Equal rows and NULL keys
are packed row by row. Ties are broken by row, so a run repeats. An empty table gives empty results.
The result names its columns itself; ``keep`` columns of the same name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimweave.llm.common import saved, ship_package, text_of
from dimweave.llm.tokens import chunks, encoder

OUTPUT = ("row", "piece", "start", "length", "ids", "sequence_id", "offset")
PER_PART = 32_768
ROUNDS = 6


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A count no packing can go below: the greatest bound of three families of dual-feasible functions.

    The identity gives the volume bound. The threshold family counts a length above capacity - t as
    the whole capacity, drops lengths below t and keeps the others. The rounding family maps x to
    floor((k + 1) x / capacity) / k, and to x / capacity where that product is whole.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    half = sizes[sizes <= capacity // 2]
    for t in half[np.unique(np.linspace(0, len(half) - 1, 64).astype(int))] if len(half) else []:
        kept = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((kept * counts).sum()) // capacity))
    for k in range(1, 12):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * capacity), so all is whole
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, offset in it, empty space of each bin); longest first, into the fullest bin that has room."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r is there
    order = np.argsort(-np.asarray(lengths), kind="stable")
    for i, w in zip(order.tolist(), np.asarray(lengths)[order].tolist()):
        enough = open_rooms >> w
        if enough:
            r = w + (enough & -enough).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(r)
        bins[i], offsets[i], room[b] = b, capacity - r, r - w
        if r > w:
            by_room[r - w].append(b)
            open_rooms |= 1 << (r - w)
    return bins, offsets, np.array(room, dtype=np.int64)


@dataclass(frozen=True)
class Packed:
    """``pieces``: row, keep columns, piece, start, length, ids (little-endian unsigned 32-bit bytes).
    ``places``: row, piece, sequence_id, offset. ``certified``: part, pieces, bins, bound of the first round."""

    pieces: DataFrame
    places: DataFrame
    certified: DataFrame

    def sequences(self) -> DataFrame:
        """Every piece with its ids and its place."""
        return self.pieces.join(self.places, ["row", "piece"])


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    ship_package(docs.sparkSession)
    keep = [c for c in keep if c not in OUTPUT]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    schema = T.StructType([
        T.StructField("row", T.LongType()), *(T.StructField(names[c], docs.schema[c].dataType) for c in keep),
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for group in chunks(batch.column(len(keep)).to_pylist()):
                which, piece, start, data = [], [], [], []
                for i, ids in enumerate(coder.encode(group)):
                    ids += end
                    for p, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        which.append(at + i)
                        piece.append(p)
                        start.append(begin // 4)
                        data.append(ids[begin:begin + 4 * capacity])
                kept = [c.take(pa.array(which, pa.int64())) for c in batch.columns[:-1]]
                new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([row + w for w in which], pa.int64()), *kept, *new], names=schema.names)
                at += len(group)
            row += at

    chosen = docs.select(*(F.col(c).alias(names[c]) for c in keep), text_of(text_col).alias("text"))
    out = chosen.mapInArrow(cut, schema)
    return out.select("row", *(F.col(names[c]).alias(c) for c in keep), "piece", "start", "length", "ids")


_BINS = "part long, row long, piece int, length long, bin long, offset long, bins long, bound long, release boolean"


def _pack_group(pdf: pd.DataFrame, capacity: int, first: bool, round_no: int) -> pd.DataFrame:
    """One deal: pack its pieces, keep the old bins if the new ones are not fewer, choose what to exchange next."""
    pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
    lengths = pdf["length"].to_numpy()
    part = int(pdf["part"].iloc[0])
    bins, offsets, room = best_fit_decreasing(lengths, capacity)
    bound, fewer = lower_bound(lengths, capacity), True
    if first or len(room) < pdf["bin"].nunique():
        # unique over parts and rounds: round, part and bin have places of their own
        named = (round_no << 58) + (part << 26) + bins
        pdf = pdf.assign(bin=named, offset=offsets)
        if len(room) > bound:
            release = room[bins] >= lengths.min()
        else:
            release = bins == int(room.argmax())
            release &= room.max() > 0
    else:
        fewer = False
        release = np.zeros(len(pdf), dtype=bool)
    return pdf.assign(bins=len(room) if fewer else pdf["bin"].nunique(), bound=bound, release=release)


def place_pieces(lengths: DataFrame, capacity: int, per_part: int = PER_PART, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``lengths`` has row, piece, length (1 to capacity). Returns (places, certificates of the first round)."""

    def packed(frame: DataFrame, first: bool, round_no: int) -> DataFrame:
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            return _pack_group(pdf, capacity, first, round_no)

        return saved(frame.groupBy("part").applyInPandas(pack, _BINS), "bins")

    def parts_of(rows: int) -> int:
        return max(1, -(-rows // per_part))

    none = F.lit(None).cast("long")
    parts = parts_of(lengths.count())
    dealt = lengths.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).alias("part"), "row", "piece", "length",
        none.alias("bin"), none.alias("offset"), none.alias("bins"), none.alias("bound"), F.lit(False).alias("release"),
    )
    state = packed(dealt, True, 0)
    certificates = state.groupBy("part").agg(F.count("*").alias("pieces"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    done, before = [state.where(~F.col("release"))], parts
    pool = state.where("release")
    for round_no in range(1, rounds + 1):
        moved = pool.count()
        parts = parts_of(moved)
        if not moved or before == 1:
            break
        state = packed(pool.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(parts))), False, round_no)
        done.append(state.where(~F.col("release")))
        pool, before = state.where("release"), parts
    done.append(pool)
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    return places.select("row", "piece", F.col("bin").alias("sequence_id"), "offset"), certificates


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, keep: Sequence[str] = ("doc_id",), text_col: str = "text", per_part: int = PER_PART, rounds: int = ROUNDS) -> Packed:
    pieces = saved(cut_into_pieces(docs, tokenizer_path, end_id, capacity, keep, text_col), "pieces")
    places, certificates = place_pieces(pieces.select("row", "piece", "length"), capacity, per_part, rounds)
    return Packed(pieces, places, certificates)
