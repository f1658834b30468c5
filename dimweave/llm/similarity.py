"""Word shingles, and the exact comparison of pairs of texts, as the similarity joins share them.

A class is a set of shingles, named by its digest; a class is represented by the smallest key of a text
that has it. Pairs of classes are compared on the full sets of their representatives' texts. Before that a
pair must pass the classes' parity sketches: bit i of a sketch says whether the set has an odd number of
shingles that end in i. A shingle of only one of two sets turns one bit at most, so the bits in which the
sketches differ are a lower bound of the shingles not in common, and no pair that links is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import saved, text_of
from dimweave.llm.components import connected_components

SIEVE_BITS = 1 << 26
LEADERS = 32
GROWTH = 256
FEW_KEYS = 100_000
BRIEF_BITS = 256
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; bytes.lower and bytes.split know A-Z and \\x20, \\x09-\\x0D only."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype="u8")
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype="u8", count=len(found))
    k = min(words, len(found))
    n = len(found) - k + 1
    rolled = np.full(n, k, dtype="u8")
    for j in range(k):
        rolled = rolled * _FACTOR + hashed[j:j + n]
    return np.unique(mixed(rolled))


def needed(size: int, percent: int) -> int:
    """Common shingles that a set of ``size`` must have with any set it links with."""
    return -(-percent * size // 100)


def enough(size_a, size_b, percent: int):
    """Common shingles that make sets of these sizes link (numbers, arrays or columns)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def sketch(own: np.ndarray) -> bytes:
    """The parity sketch of a set of shingles: a power of two of bits, 2 to 4 a shingle and ``BRIEF_BITS`` at least."""
    bits = max(BRIEF_BITS, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def brief(whole: bytes) -> bytes:
    """A sketch folded to ``BRIEF_BITS`` bits: again the parity sketch of the set, with as many bits."""
    return np.bitwise_xor.reduce(np.frombuffer(whole, dtype="u1").reshape(-1, BRIEF_BITS // 8), axis=0).tobytes()


def may_link(size_a: int, size_b: int, sketch_a: bytes, sketch_b: bytes, percent: int) -> bool:
    """Whether the sketches of two sets leave room for a link."""
    bits = 8 * min(len(sketch_a), len(sketch_b))
    differ = 0
    for whole in (sketch_a, sketch_b):
        value = int.from_bytes(whole, "little")
        while value:  # the longer sketch is folded to the length of the other
            differ ^= value & ((1 << bits) - 1)
            value >>= bits
    return differ.bit_count() <= size_a + size_b - 2 * enough(size_a, size_b, percent)


def texts_of(docs: DataFrame, key: str, text_col: str, keys: DataFrame) -> DataFrame:
    """``text_key, text`` of the rows whose key is in ``keys`` (one column of a written table), written.

    Up to ``FEW_KEYS`` keys are broadcast. For more, the texts are sieved where they lie by a bit table of the keys' hashes,
    of ``SIEVE_BITS`` bits whatever the number of keys, so only wanted texts (and a few others) are shuffled to the join.
    """
    spark = docs.sparkSession
    (name,) = keys.columns
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("text_key"), text_of(text_col).alias("text"))
    if keys.count() <= FEW_KEYS:
        few = F.broadcast(keys.withColumnRenamed(name, "wanted_key"))
        return saved(keyed.join(few, F.col("text_key") == F.col("wanted_key"), "left_semi"), "texts")
    wanted = saved(keys.distinct().withColumnRenamed(name, "wanted_key"), "wanted")
    hashed = F.xxhash64("wanted_key")
    word = F.pmod(hashed, F.lit(SIEVE_BITS // 64))
    bits = wanted.select(word.alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(wanted_key), 58) AS int))").alias("bit"))
    filled = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    sieve = np.zeros(SIEVE_BITS // 64, dtype="u8")
    sieve[filled["word"].to_numpy(dtype="i8")] = filled["bits"].to_numpy(dtype="i8").view("u8")
    held = spark.sparkContext.broadcast(sieve)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            bit = table[h % len(table)] >> (h.view("u8") >> np.uint64(58))
            yield batch.filter(pa.array((bit & np.uint64(1)).astype(bool)))

    rows = keyed.select("text_key", "text", F.xxhash64("text_key").alias("h"))
    sifted = rows.mapInArrow(sift, rows.schema).drop("h")
    return saved(sifted.join(wanted, F.col("text_key") == F.col("wanted_key")).drop("wanted_key"), "texts")


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, key_a, key_b) of classes whose representatives' texts link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name_b = own_b = None
        for batch in batches:
            a, b = [], []
            for x, y, text_a, text_b in zip(*batch.columns):
                x, y = x.as_py(), y.as_py()
                own_a = shingles(text_a.as_py(), words)
                if y != name_b or own_b is None:
                    own_b = shingles(text_b.as_py(), words)
                name_b = None
                if any(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) != c for own, c in ((own_a, x), (own_b, y))):
                    continue  # another row with the representative's key
                name_b = y
                common = len(np.intersect1d(own_a, own_b, assume_unique=True))
                if 100 * common >= percent * (len(own_a) + len(own_b) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    first = pairs.join(texts.withColumnRenamed("text", "text_a"), F.col("key_a") == F.col("text_key")).drop("text_key")
    both = first.join(texts.withColumnRenamed("text", "text_b"), F.col("key_b") == F.col("text_key"))
    return saved(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "links")


def links_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b; a written table) of classes that link, written."""
    named = candidates(pairs, classes, percent)
    return linked(named, texts_of(docs, key, text_col, keys_of(named)), words, percent)


def keys_of(named: DataFrame) -> DataFrame:
    """``k``: the keys of the representatives of both sides."""
    return named.select(F.col("key_a").alias("k")).unionByName(named.select(F.col("key_b").alias("k")))


def candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, key_a, n_a, b, key_b, n_b`` of the pairs (a, b) whose set sizes and sketches allow a link, written.

    ``classes``: class, n, key, sketch. The sizes are compared before the second sketch is joined.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            stay = [may_link(*row, percent) for row in zip(*columns)]
            yield batch.filter(pa.array(stay, pa.bool_())).select(names)

    for side in "ab":
        named = classes.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "sketch")))
        pairs = pairs.join(named, side)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    names = ["a", "key_a", "n_a", "b", "key_b", "n_b"]
    both = pairs.where(fits).select(*names, "sketch_a", "sketch_b")
    return saved(both.mapInArrow(sift, both.select(*names).schema), "pairs")


def rows_with_groups(rows: DataFrame, classes: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``key, n_shingles, component_id, class`` of every row (key, n, class): the smallest key of its class's group.

    ``groups`` (node, component) names the groups of the classes that have links. A row without a key
    has a NULL component; a row with an empty set is its own.
    """
    grouped = classes.join(groups, classes["class"] == groups["node"], "left").select("class", "n", "key", F.coalesce("component", "class").alias("group"))
    # groups are small next to the rows: first one key per group, then one row per class
    heads = grouped.groupBy("group").agg(F.min("key").alias("component_id"))
    named = saved(grouped.join(heads, "group").select("class", "n", "component_id"), "components")
    out = rows.join(named, ["class", "n"], "left")
    own = F.when(F.col("key").isNull(), None).otherwise(F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), "class")


def next_pairs(lists: DataFrame, first: int, after: int, percent: int) -> DataFrame:
    """(a, b): in each list (list, class, at, group), its sets at places ``first`` to ``after`` with later sets of other groups.

    Left out are pairs that cannot have enough in common after their places in ``at``, or by their sketches
    where the lists have them (``brief``). A list comes sorted and is read once as a stream; only its leaders are held.
    """
    sketched = "brief" in lists.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place, leaders = None, 0, []
        for batch in batches:
            found_a, found_b = [], []
            name, node, group, at = (batch[c].to_numpy() for c in ("list", "class", "group", "at"))
            size, left = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
            bits = np.frombuffer(b"".join(batch["brief"]), dtype="u8").reshape(len(name), -1) if sketched else np.zeros((len(name), 1), dtype="u8")
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else []
            for start, end in zip(starts, [*starts[1:], len(name)]):
                if name[start] != now:
                    now, place, leaders = name[start], 0, []
                own = slice(start, end)
                nodes, groups, sizes, rest, sketches = node[own], group[own], size[own], left[own], bits[own]
                leaders += [(place + i, nodes[i], groups[i], sizes[i], rest[i], sketches[i]) for i in range(max(0, first - place), min(len(nodes), after - place))]
                for where, leader, its_group, its_size, its_rest, its_sketch in leaders:
                    later = max(0, where + 1 - place)
                    common = enough(sizes[later:], its_size, percent)
                    other = later + np.flatnonzero((groups[later:] != its_group) & (np.minimum(rest[later:], its_rest) >= common))
                    if len(other):
                        differ = np.bitwise_count(sketches[other] ^ its_sketch).sum(axis=1, dtype="i8")
                        other = other[differ <= sizes[other] + its_size - 2 * common[other - later]]
                        found_a.append(nodes[other])
                        found_b.append(np.full(len(other), leader))
                place += len(nodes)
            if found_a:
                yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return lists.repartition("list").sortWithinPartitions("list", "class").mapInPandas(read, "a long, b long")


def mixed_lists(lists: DataFrame, groups: DataFrame, least_size: int) -> DataFrame:
    """The rows of the lists that hold several groups and at least ``least_size`` classes, with ``group``; written."""
    named = lists.join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = named.select(*lists.columns, F.coalesce("component", "class").alias("group"))
    several = named.groupBy("list").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size"))
    several = several.where((F.col("low") != F.col("high")) & (F.col("size") >= least_size)).select("list")
    return saved(named.join(several, "list"), "mixed-lists")


def joined_groups(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the links ``found`` (a, b; a written table) added."""
    if found.isEmpty():
        return groups
    members = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return saved(connected_components(members.unionByName(found)), "groups")


def groups_across(lists: DataFrame, groups: DataFrame, links: Callable[[DataFrame, DataFrame], DataFrame], percent: int, briefs: DataFrame | None = None) -> DataFrame:
    """``groups`` joined by the links between classes of one list (list, class, at) that lie in different groups.

    ``links(pairs, groups)`` gives the pairs (a, b) that link. In each list the first ``LEADERS`` classes
    lead, then ``GROWTH`` times as many, and so on, each compared with the later classes of other groups,
    until a list is one group or its classes have all led: no pair of a list is left out that the places and
    the sketches allow and that could join two groups. A list that links soon costs its length a few times.
    The sketches are a column ``brief`` of the lists, or come from ``briefs`` (class, brief).
    """
    first, many = 0, LEADERS
    shared = mixed_lists(lists, groups, 2)
    if briefs is not None:
        shared = shared.join(briefs, "class")
    columns = [c for c in shared.columns if c != "group"]
    while not shared.isEmpty():
        pairs = saved(next_pairs(shared, first, first + many, percent).distinct(), "across")
        if not pairs.isEmpty():
            groups = joined_groups(groups, links(pairs, groups))
        first, many = first + many, GROWTH * many
        shared = mixed_lists(shared.select(*columns), groups, first + 2)
    return groups
