"""Exact similarity self-join on word shingles, and its groups, by a token-group matrix.

A document's set is its distinct shingles of ``WORDS`` words; two documents link when the Jaccard
coefficient of their sets is at least ``percent`` per cent. Documents with one set are one class, and
only classes are compared. No link between classes that would join two groups is lost:

1. One pass over the texts gives every document's set size and set digest, and the shingles frequent
   in some stretch of the texts. The most frequent of these, ``COMMON`` at most, are set last in the
   order of shingles (shared passages are then seldom looked up); the others are ordered by hash. Any
   fixed order gives the same links.
2. A second pass lists each class under its first shingles, so many that two linked classes must share
   one of them, with its size and the shingle's place in its order. Lists longer than ``LONG`` whose
   shingle is not set last yet set it last, and the pass is repeated. In a shingle's list the first
   class leads: each other class is compared with it, if the shingles from their places on could be
   enough. That is one comparison per entry of the list at most, whatever its length.
3. The linked classes form groups of similar documents. In lists that hold followers of several groups,
   a follower (the query) is held against the later followers of other groups, as long as the lists
   stay mixed; the sizes and places of the two in the list and their parity sketches bound their overlap first. Then the token-group
   matrix rules: the asked classes of a group are cut into chunks of about ``CHUNK``, a chunk stores the union of
   their shingles, and the query's overlap with the union bounds its overlap with any of them. Only
   chunks whose bound suffices are opened, and the query compared with their classes. New links join
   groups before the next followers of a list are held against the others, so a family of documents costs
   its length a few times. Links within one group need no comparison, for they change nothing.

Comparisons count common shingles exactly (64-bit hashes of the words).

Edge cases: a text with fewer words than a shingle is one shingle of all of them. Very long texts are read whole. NULL and empty texts and
texts of white space have an empty set and link with nothing: each is its own component. Rows with NULL
keys get their size, a NULL component, and link with nothing. Rows with one key are one document in the
result of a link, each with its own set. An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimweave.llm.common import at_most, column_name, forget_kept, saved, ship_package, text_of
from dimweave.llm.components import connected_components
from dimweave.llm.similarity import brief, candidates, enough, groups_across, keys_of, linked, links_of, needed, rows_with_groups, shingles, sketch, texts_of

WORDS = 5
PERCENT = 80
COMMON = 1_000_000
COMMON_FROM = 8
LONG = 64
REPEATS = 2
CHUNK = 32
_LOCAL = 2
_STRETCH = 2_000_000


def _sets(docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """``key, n, class, sketch`` of every row (the sketch with the first of a set in a task), and ``shingle, times`` of shingles frequent in a stretch of distinct sets."""
    key_type = docs.schema[key].dataType.simpleString()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        held, size, seen, sketched = [], 0, set(), set()

        def frequent() -> pd.DataFrame:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= _LOCAL
            return pd.DataFrame({"key": None, "none": None, "n": None, "class": None, "sketch": None, "shingle": shingle[often].view("i8"), "times": times[often]})

        for batch in batches:
            sizes, classes, sketches = [], [], []
            for text, none in zip(batch["text"], batch["none"]):
                own = shingles(text, words)
                name = xxhash.xxh64_intdigest(own.tobytes())
                sizes.append(len(own))
                classes.append(name - (1 << 63))
                sketches.append(None)
                if len(own) and not none and name not in sketched:
                    sketched.add(name)
                    sketches[-1] = sketch(own)
                if len(own) and name not in seen:
                    seen.add(name)
                    held.append(own)
                    size += len(own)
                    if size > _STRETCH:
                        yield frequent()
                        held, size = [], 0
            yield pd.DataFrame({"key": batch["key"], "none": batch["none"], "n": sizes, "class": classes, "sketch": sketches, "shingle": None, "times": None})
        if held:
            yield frequent()

    plain = F.coalesce(F.col(key), F.lit(0).cast(docs.schema[key].dataType)).alias("key")
    rows = docs.select(plain, F.col(key).isNull().alias("none"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(look, f"key {key_type}, none boolean, n long, class long, sketch binary, shingle long, times long")
    return out.withColumn("key", F.when(~F.col("none"), F.col("key")))


def _index(docs: DataFrame, key: str, text_col: str, words: int, percent: int, last: np.ndarray) -> DataFrame:
    """``shingle, class, at``: every class under its first shingles in the common order.

    ``at`` is the set's size (upper half) and the shingle's place in the order (lower half).
    """
    common = docs.sparkSession.sparkContext.broadcast(last)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        late, seen = common.value, set()
        for batch in batches:
            found, classes, counts, places = [], [], [], []
            for text in batch["text"]:
                own = shingles(text, words)
                name = xxhash.xxh64_intdigest(own.tobytes())
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                first = len(own) - needed(len(own), percent) + 1
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    isin = late[at] == own
                    own = np.concatenate([own[~isin], own[isin]])
                found.append(own[:first])
                classes.append(name - (1 << 63))
                counts.append(first)
                places.append((len(own) << 32) + np.arange(first))
            if found:
                yield pd.DataFrame({
                    "shingle": np.concatenate(found).view("i8"),
                    "class": np.repeat(np.array(classes, dtype="i8"), counts),
                    "at": np.concatenate(places),
                })

    rows = docs.where(F.col(key).isNotNull()).select(text_of(text_col).alias("text"))
    return rows.mapInPandas(look, "shingle long, class long, at long")


def _followers(index: DataFrame, percent: int) -> DataFrame:
    """``shingle, class, at, lead, fits, many``: in the list of each shingle, every class but the first, with the first.

    ``fits`` says that the shingles from this one on could be enough for the two to link; ``many`` that
    the list may have more than this follower. The lists come sorted and are read once, as a stream: a
    long list takes no memory.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            shingle, name, at = (batch[c].to_numpy() for c in ("shingle", "class", "at"))
            if not len(shingle):
                continue
            new = np.ones(len(shingle), dtype=bool)
            new[1:] = shingle[1:] != shingle[:-1]
            again = np.zeros(len(shingle), dtype=bool)
            again[1:] = ~new[1:] & (name[1:] == name[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            lead, lead_at = name[first], at[first]
            if before is not None and shingle[0] == before[0]:
                end = int(np.argmax(shingle != before[0])) or len(shingle)
                lead[:end], lead_at[:end] = before[2], before[3]
                new[0], again[0] = False, name[0] == before[1]
            keep = ~new & ~again & (name != lead)
            before = shingle[-1], name[-1], lead[-1], lead_at[-1]
            if keep.any():
                n, n_lead, left, left_lead = at >> 32, lead_at >> 32, (at >> 32) - (at & 0xFFFFFFFF), (lead_at >> 32) - (lead_at & 0xFFFFFFFF)
                fits = np.minimum(left, left_lead) >= enough(n, n_lead, percent)
                own = shingle[keep]
                many = np.zeros(len(own), dtype=bool)
                many[1:] = own[1:] == own[:-1]
                many[:-1] |= many[1:].copy()
                many |= (own == shingle[0]) | (own == shingle[-1])  # the list may go on in another batch
                yield pd.DataFrame({"shingle": own, "class": name[keep], "at": at[keep], "lead": lead[keep], "fits": fits[keep], "many": many})

    ordered = index.repartition("shingle").sortWithinPartitions("shingle", "class")
    return ordered.mapInPandas(read, "shingle long, class long, at long, lead long, fits boolean, many boolean")


def _token_sets(named: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``class, n, tokens`` of the classes of the pairs ``named``: the lower 32 bits of their shingles, written."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, words) for t in batch["text"]]
            right = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) == c for s, c in zip(own, batch["class"])]
            # where two shingles meet in the lower bits, a bound only grows
            yield batch.drop(columns="text").assign(tokens=[s.astype("u4").view("i4") for s in own])[right]

    sides = [named.select(F.col(side).alias("class"), F.col(f"n_{side}").alias("n"), F.col(f"key_{side}").alias("key")) for side in "ab"]
    keyed = sides[0].unionByName(sides[1]).distinct()
    rows = keyed.join(texts, F.col("key") == F.col("text_key")).select("class", "n", "text")
    return saved(rows.mapInPandas(tokens, "class long, n long, tokens array<int>").dropDuplicates(["class"]), "token-sets")


def _through_matrix(named: DataFrame, groups: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of ``named`` (a, b, their keys and sizes) whose chunk of b's group qualifies for a.

    The matrix holds a row for each chunk of the asked classes of a group: the union of their tokens. A class that
    asks a chunk can have no more in common with any class in it than with the union; chunks where that is too
    little stay closed.
    """
    asked = named.join(groups.select(F.col("node").alias("b"), "component"), "b", "left")
    asked = saved(asked.select(*named.columns, F.coalesce("component", "b").alias("group")), "asked")
    members = asked.select(F.col("b").alias("class"), "group").distinct()
    sizes = members.groupBy("group").count()
    chunk = F.pmod(F.xxhash64("class"), F.ceil(F.col("count") / CHUNK)).cast("int")
    placed = saved(members.join(sizes, "group").select("class", "group", chunk.alias("chunk")), "chunks")
    sets = _token_sets(named, texts, words)
    rows = sets.join(placed, "class")
    unions = rows.groupBy("group", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"), F.max("n").alias("largest"))

    asked = asked.join(placed.select(F.col("class").alias("b"), "chunk"), "b")
    queries = asked.select("a", "group", "chunk").distinct().join(sets.select(F.col("class").alias("a"), "n", "tokens"), "a")
    least = F.ceil(F.col("n") * percent / 100)
    # tokens of the query that are one in 32 bits may all be common: count them on top
    common = F.size(F.array_intersect("tokens", "union")) + (F.size("tokens") - F.size(F.array_distinct("tokens")))
    opened = queries.join(unions, ["group", "chunk"]).where((F.col("largest") >= least) & (common >= least)).select("a", "group", "chunk")
    return asked.join(saved(opened, "opened"), ["a", "group", "chunk"], "left_semi").select(*named.columns)


def _groups(docs: DataFrame, key: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``key, n, class`` of every row; ``class, n, key``: the representatives; ``node, component``: the classes that link)."""
    ship_package(docs.sparkSession)
    looked = saved(_sets(docs, key, text_col, words), "sets")
    rows = looked.where(F.col("n").isNotNull()).select("key", "n", "class")
    known = looked.where("n > 0 AND key IS NOT NULL").groupBy("class", "n").agg(F.min("key").alias("key"), F.max("sketch").alias("sketch"))
    classes = saved(known, "classes")
    often = looked.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_FROM)
    often = at_most(saved(often, "common"), "times", COMMON).select("shingle").toPandas()["shingle"].to_numpy(dtype="i8")
    last = np.sort(often.view("u8"))

    for _ in range(REPEATS + 1):
        followers = saved(_followers(_index(docs, key, text_col, words, percent, last), percent), "followers")
        long = followers.groupBy("shingle").count().where(F.col("count") >= LONG)
        long = at_most(saved(long, "long"), "count", COMMON).select("shingle").toPandas()["shingle"].to_numpy(dtype="i8")
        more = np.setdiff1d(long.view("u8"), last)
        if not len(more):
            break
        last = np.union1d(last, more)
    stars = followers.where("fits").select(F.col("class").alias("a"), F.col("lead").alias("b")).distinct()
    links = links_of(saved(stars, "stars"), classes, docs, key, text_col, words, percent)
    groups = saved(connected_components(links), "groups")

    def links_across(pairs: DataFrame, now: DataFrame) -> DataFrame:
        named = candidates(pairs, classes, percent)
        texts = texts_of(docs, key, text_col, keys_of(named))
        return linked(_through_matrix(named, now, texts, words, percent), texts, words, percent)

    @F.pandas_udf("binary")
    def brief_of(whole: pd.Series) -> pd.Series:
        return whole.map(brief)

    lists = followers.where("many").select(F.col("shingle").alias("list"), "class", "at")
    briefs = saved(classes.select("class", brief_of("sketch").alias("brief")), "briefs")
    groups = groups_across(lists, groups, links_across, percent, briefs)
    return rows, classes, groups


def similarity_groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id``: the set size, and the smallest key reachable by links, of every row."""
    return rows_with_groups(*_groups(docs, key, text_col, words, percent), key).drop("class")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the smallest key, with the columns of ``docs``.

    Rows without a key stay. Rows that share a key are judged by their own texts: of those with one set of
    shingles, the first by text stays if its group has no smaller key. Column names of ``docs`` are never clashed with.
    """
    grouped = saved(rows_with_groups(*_groups(docs, key, text_col, words, percent), key).where(F.col(key).isNotNull()), "grouped")
    row_key, row_class, place = (column_name(docs, name) for name in ("row_key", "row_class", "row_place"))
    repeated = saved(grouped.groupBy(F.col(key).alias(row_key)).count().where("count > 1").select(row_key), "repeated")
    gone = grouped.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(row_key))
    elsewhere = saved(gone.unionByName(repeated).distinct(), "gone")
    out = docs.join(elsewhere, F.col(key) == F.col(row_key), "left_anti")

    @F.pandas_udf("long")
    def class_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh64_intdigest(shingles(t, words).tobytes()) - (1 << 63))

    stays = grouped.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(row_key), F.col("class").alias(f"{row_class}_"))
    stays = stays.join(repeated, row_key, "left_semi").distinct()
    again = docs.join(repeated, F.col(key) == F.col(row_key), "left_semi").withColumn(row_class, class_of(text_of(text_col)))
    again = again.join(stays, (F.col(key) == F.col(row_key)) & (F.col(row_class) == F.col(f"{row_class}_")), "left_semi")
    first = Window.partitionBy(key, row_class).orderBy(F.col(text_col).asc_nulls_first(), F.xxhash64(*docs.columns))
    again = again.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return out.unionByName(again.select(*docs.columns))
