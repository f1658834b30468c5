"""Spelling variants: words one edit apart, and the common form each rare spelling stands for.

1. Words are counted over whole texts, a task's counts combined before the shuffle.
2. A word is a multiset of letters, read as a binary vector: one dimension for the first a, one for the
   second a, and so on. One replaced letter moves two dimensions, one inserted or deleted letter one, so
   near words have a Hamming distance of two at most. PartEnum: the dimensions are dealt into ``PARTS``
   partitions, and each choice of all but two partitions enumerated gives a signature of the vector's
   dimensions there; two near vectors agree in one of them at least. One edit also leaves either the first
   or the last half of the shorter word as it was, so every signature is taken with the length and with
   either half: a word stands under its signatures as the shorter (or equal) and as the longer word.
3. An equi-join of the signatures gives candidates, the edit distance of the two words decides. All are
   compared, and both sides are partitioned by a 64-bit signature that few words share.
4. A word's form is its near word of the largest count, if that is ``ratio`` times its own or more; the
   root is reached by following forms, doubling the distance each round (counts grow tenfold at each step,
   so chains are short).

Edge cases: NULL and empty texts have no words. A NULL key counts as the empty text in ``damaged`` words.
Repeated rows count again. Very long texts and words are read whole. Ties between forms go to the smallest
word in code-point order. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import saved, ship_package, text_of
from dimweave.llm.similarity import mixed

PARTS = 4
_HELD = 300_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CHOICES = tuple(itertools.combinations(range(PARTS), PARTS - 2))


def damaged(run: str, key: str, one_in: int) -> str:
    """``run``, without one letter if the crc32 of key and run is a multiple of ``one_in`` (0: never)."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if not one_in or h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, key: str = "doc_id", text_col: str = "text", letters: str = "a-zÀ-ÿ", least: int = 7, one_in: int = 0) -> DataFrame:
    """``word, n``: the maximal runs of ``letters`` (A-Z lower-cased) of ``least`` code points or more.

    With ``one_in``, a run in some documents loses a letter first (see ``damaged``).
    """
    ship_package(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{letters}]{{{least},}}")  # a shorter run is no word, damaged or not
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(runs.findall(text.as_py().encode().lower().decode()))
                for run, n in found.items():
                    word = damaged(run, name, one_in)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= _HELD:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(look, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def signatures_of(words: list[str]) -> np.ndarray:
    """A row of 64-bit signatures for each word: first those as the shorter (or equal) word, then those as the longer one."""
    size = np.fromiter(map(len, words), dtype="i8", count=len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), dtype="u4").astype("u8")
    owner = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, owner))
    letter, owner = letter[order], owner[order]
    new = np.r_[True, (letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1])] if len(letter) else np.zeros(0, dtype=bool)
    line = np.arange(len(letter))
    again = line - np.maximum.accumulate(np.where(new, line, 0))  # how often the word had this letter before
    part = ((letter + again.astype("u8")) % np.uint64(PARTS)).astype("i8")
    cells = np.zeros(len(words) * PARTS, dtype="u8")
    np.add.at(cells, owner * PARTS + part, mixed(letter * _SPREAD + again.astype("u8")))
    cells = mixed(cells.reshape(len(words), PARTS) + np.arange(1, PARTS + 1, dtype="u8") * _SPREAD)
    vectors = [mixed(cells[:, list(kept)] * np.arange(1, PARTS - 1, dtype="u8")).sum(axis=1) + np.uint64(i) for i, kept in enumerate(_CHOICES)]
    out = []
    for shorter in (0, 1):  # by how much the pair's other word is shorter
        for end in (0, 1):
            halves = ((w[:(len(w) - shorter) // 2] if end == 0 else w[len(w) - (len(w) - shorter) // 2:]).encode() for w in words)
            half = np.fromiter(map(xxhash.xxh64_intdigest, halves), dtype="u8", count=len(words))
            named = mixed(half + (size - shorter).astype("u8") * _SPREAD + np.uint64(end))
            out += [mixed(named ^ mixed(v * _SPREAD)) for v in vectors]
    return np.stack(out, axis=1).view("i8")


def _signed(words: DataFrame, longer: bool) -> DataFrame:
    """``signature, word, n, longer``: each word under its signatures as the shorter word, with ``longer`` as the longer one too."""
    per_role = 2 * len(_CHOICES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = signatures_of(batch.column(0).to_pylist())[:, : per_role * (1 + longer)]
            rows = pa.array(np.repeat(np.arange(len(made)), made.shape[1]))
            role = np.tile(np.arange(made.shape[1]) >= per_role, len(made))
            columns = [pa.array(made.reshape(-1)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(role)]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "word", "n", "longer"])

    return words.select("word", "n").mapInArrow(look, "signature long, word string, n long, longer boolean")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of words one edit apart, from both sides."""
    a = _signed(words, longer=False).select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = _signed(words, longer=True).select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    candidates = a.join(b, "signature").where(F.col("longer") | (F.col("a") < F.col("b")))
    pairs = candidates.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()
    pairs = saved(pairs, "near-words")
    names = ("word", "n", "other", "other_n")
    return pairs.toDF(*names).unionByName(pairs.select("b", "n_b", "a", "n_a").toDF(*names))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (word, form): the last form reached."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = saved(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variant_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word (word, n), which are distinct."""
    ship_package(words.sparkSession)
    words = saved(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    held = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    )
    held = saved(held, "forms")
    out = held.join(_roots(held.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
