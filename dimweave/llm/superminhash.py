"""Near-duplicate groups by SuperMinHash signatures, banding, verification and connected components.

1. One pass over the texts gives every row its set of shingles (``WORDS`` words), named by a digest, and
   each distinct set its signature of ``BANDS * ROWS`` slots. SuperMinHash draws for each shingle one
   random permutation of the slots instead of independent values: in step j the shingle offers the value
   j + fraction to the slot its permutation has at place j, and a slot keeps the least offer. The
   fractions of a slot are correlated with those of the others, which lowers the variance of the
   signature. A set stops at the first step whose offers could no longer win a slot, so long sets need
   few steps a shingle.
2. ``ROWS`` slots in a row are a band. Sets that agree in a whole band stand in one list; sets that link
   (coefficient ``percent`` or more) meet in some list, but for a chance of 3 in 10 million at 0.85 (less
   above).
3. In each list the first set leads and every other one is compared with it, on the full sets of shingles.
   The links give groups. The sets of lists that still hold several groups may link across them. They
   are listed again, under their rarest shingles: under so many that two linked sets share one of them, and
   with their places, which bound how much two sets can have in common from there on. (The ``COMMON`` most
   frequent shingles among these sets count as frequent, the others as rare; any order gives the same links.)
   Variants of one text that lie just below the limit differ in rare shingles, so few of their pairs pass.
   In the lists of shingles the first 32 sets lead, then the next 8,192, and so on: each is compared
   with the later sets of other groups that the bound and the parity sketches let through, until a list is one group or all its
   pairs are compared or ruled out. No pair is left out that could join two groups.
4. Union-find runs as connected components over the verified links.

Edge cases: a text with fewer words than a shingle is one shingle of all of them. NULL and empty texts and
texts of white space have an empty set and link with nothing: each is its own component. Very long texts
are read whole, their shingles in blocks of ``BLOCK``. Rows with a NULL key get their size, a NULL
component, are kept, and link with nothing. Rows with one key are one document, each with its own set.
Exact copies are one set, compared once. An empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import at_most, forget_kept, saved, ship_package, text_of
from dimweave.llm.components import connected_components
from dimweave.llm.similarity import brief, candidates, groups_across, linked, links_of, mixed, mixed_lists, needed, rows_with_groups, shingles, sketch, texts_of

WORDS = 3
PERCENT = 85
BANDS = 32
ROWS = 6
BLOCK = 8192
COMMON = 1_000_000
COMMON_FROM = 8
_SEEN = 1_000_000
_FRACTION = np.uint64(48)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15
_SECOND = np.uint64(0xD1B54A32D192ED03)


def _offer(values: np.ndarray, rows: np.ndarray, signature: np.ndarray) -> None:
    """Lower the signatures by the offers of a block of shingles; ``rows`` says whose they are."""
    m = signature.shape[1]
    order = np.broadcast_to(np.arange(m, dtype="u2"), (len(values), m)).copy()
    flat = signature.reshape(-1)
    owners = np.unique(rows)
    for j in range(m):
        lively = owners[signature[owners].max(axis=1) >> _FRACTION >= j]
        if len(lively) < len(owners):
            if not len(lively):
                return
            stay = np.isin(rows, lively)
            values, rows, order, owners = values[stay], rows[stay], order[stay], lively
        drawn = mixed(values + np.uint64((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        other = j + (mixed(drawn ^ _SECOND) % np.uint64(m - j)).astype("i8")
        line = np.arange(len(values))
        slot = order[line, other]
        order[line, other] = order[:, j]
        np.minimum.at(flat, rows * m + slot, (drawn >> np.uint64(16)) | (np.uint64(j) << _FRACTION))


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` ranks for each set of 64-bit shingles: step (upper 16 bits) and fraction (lower 48).

    Independent of the order of the shingles and of the other sets; an empty set has no offers.
    """
    signature = np.full((len(sets), slots), _EMPTY, dtype="u8")
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))  # sets of a block then stop at about the same step
    if not sets:
        return signature
    values = np.concatenate([sets[i] for i in by_size]).astype("u8")
    rows = np.repeat(np.array(by_size, dtype="i8"), [len(sets[i]) for i in by_size])
    for start in range(0, len(values), BLOCK):
        _offer(values[start:start + BLOCK], rows[start:start + BLOCK], signature)
    return signature


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name for each run of ``rows`` slots, the band's number included."""
    n, m = signature.shape
    cut = signature.reshape(n, m // rows, rows)
    name = np.broadcast_to(np.arange(1, m // rows + 1, dtype="u8"), cut.shape[:2])
    for i in range(rows):
        name = mixed(name * np.uint64(_STEP) + cut[:, :, i])
    return name.view("i8")


def _look(docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """``key, n, class, sketch, bands`` of every row; the last two with the first row of a class in a task."""
    key_type = docs.schema[key].dataType

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        seen = set()
        for batch in batches:
            sizes, classes, new, at = [], [], [], []
            for i, (text, none) in enumerate(zip(batch["text"], batch["none"])):
                own = shingles(text, words)
                name = xxhash.xxh64_intdigest(own.tobytes())
                sizes.append(len(own))
                classes.append(name - (1 << 63))
                if len(own) and not none and name not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(name)
                    new.append(own)
                    at.append(i)
            named, sketches = (np.full(len(batch), None, dtype=object) for _ in range(2))
            for i, own, names in zip(at, new, bands(signatures(new, BANDS * ROWS), ROWS)):
                named[i], sketches[i] = names, sketch(own)
            yield pd.DataFrame({"key": batch["key"], "none": batch["none"], "n": sizes, "class": classes, "sketch": sketches, "bands": named})

    plain = F.coalesce(F.col(key), F.lit(0).cast(key_type)).alias("key")
    rows = docs.select(plain, F.col(key).isNull().alias("none"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(look, f"key {key_type.simpleString()}, none boolean, n long, class long, sketch binary, bands array<long>")
    return out.withColumn("key", F.when(~F.col("none"), F.col("key"))).drop("none")


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles found in ``COMMON_FROM`` texts or more, at most ``COMMON`` of them; counted where the texts lie first."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, words) for t in batch["text"]]
            shingle, times = np.unique(np.concatenate([np.zeros(0, dtype="u8"), *own]), return_counts=True)
            often = times > 1
            yield pd.DataFrame({"shingle": shingle[often].view("i8"), "times": times[often]})

    counted = texts.select("text").mapInPandas(look, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    often = at_most(saved(counted.where(F.col("times") >= COMMON_FROM), "common"), "times", COMMON)
    return np.sort(often.select("shingle").toPandas()["shingle"].to_numpy(dtype="i8").view("u8"))


def _rare_lists(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``list, class, at, brief``: each of ``members`` (class, key) under its first shingles, the rare ones before the frequent ones.

    ``at`` is the set's size (upper half) and the shingle's place in its order (lower half).
    """
    last = members.sparkSession.sparkContext.broadcast(_frequent(texts, words))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = last.value
        for batch in batches:
            found, names, at, briefs = [], [], [], []
            for text, name in zip(batch["text"], batch["class"]):
                own = shingles(text, words)
                if xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) != name:
                    continue  # another row with the representative's key
                first = len(own) - needed(len(own), percent) + 1
                often = np.isin(own, late, assume_unique=True)
                found.append(np.concatenate([own[~often], own[often]])[:first])
                names.append(name)
                at.append((len(own) << 32) + np.arange(first))
                briefs += [brief(sketch(own))] * first
            if found:
                yield pd.DataFrame({"list": np.concatenate(found).view("i8"), "class": np.repeat(names, [len(f) for f in found]), "at": np.concatenate(at), "brief": briefs})

    keyed = members.join(texts, F.col("key") == F.col("text_key")).select("class", "text")
    return keyed.mapInPandas(look, "list long, class long, at long, brief binary")


def groups_of_leaders(lists: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, component`` by the links of each list's classes with its first; ``links(pairs)`` gives the pairs (a, b) that do."""
    head = lists.groupBy("list").agg(F.min("class").alias("b"), F.count("*").alias("size")).where("size > 1").select("list", "b")
    pairs = lists.join(head, "list").where("class <> b").select(F.col("class").alias("a"), "b").distinct()
    return saved(connected_components(links(saved(pairs, "with-first"))), "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row: the smallest key reachable by links, and whether it is the row's own."""
    ship_package(docs.sparkSession)
    looked = saved(_look(docs, key, text_col, words), "signatures")
    rows = looked.select("key", "n", "class")
    known = looked.where("n > 0 AND key IS NOT NULL").groupBy("class", "n").agg(F.min("key").alias("key"), F.max("sketch").alias("sketch"))
    classes = saved(known, "classes")
    lists = looked.where("bands IS NOT NULL").select("class", F.explode("bands").alias("list")).distinct()

    def links(pairs: DataFrame) -> DataFrame:
        return links_of(pairs, classes, docs, key, text_col, words, percent)

    lists = saved(lists, "lists")
    groups = groups_of_leaders(lists, links)
    members = saved(classes.select("class", "key").join(mixed_lists(lists, groups, 2).select("class"), "class", "left_semi"), "members")
    if not members.isEmpty():
        texts = texts_of(docs, key, text_col, members.select("key"))
        rare = saved(_rare_lists(members, texts, words, percent), "rare-lists")

        def links_across(pairs: DataFrame, _groups: DataFrame) -> DataFrame:
            return linked(candidates(pairs, classes, percent), texts, words, percent)

        groups = groups_across(rare, groups, links_across, percent)
    out = rows_with_groups(rows, classes, groups, key).drop("class")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
