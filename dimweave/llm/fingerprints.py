"""Document fingerprints of closed syncmers, in DataFrame functions only.

The words of the whole text (runs without white space) are hashed. A k-mer of ``k`` consecutive words
is an anchor when the smallest of its inner s-mers (``s`` consecutive words) is its first or its last.
That depends on the k words alone, so the same passage yields the same anchors wherever it stands:
``anchors`` gives them with their word positions, for positional matching. The fingerprint keeps the
``size`` smallest distinct anchor hashes, in hexadecimal; two fingerprints' likeness is the share of
common hashes among the smallest ``size`` of both together, an estimate of the Jaccard coefficient of
their anchor sets.

Edge cases: a NULL text is empty; very long texts are read whole. A text of fewer than ``k`` words, or without a closed syncmer (it may
have exactly ``k`` words), has one anchor, the hash of its words; one without words has none and an
empty fingerprint. Two empty fingerprints have likeness 1, an
empty and another one 0. Equal texts have equal fingerprints. Repeated rows are kept. In
``edited_fingerprints`` rows are ordered by key, NULL keys last, equal keys by text; with one row the
next document is the row itself. An empty table gives an empty result. Input columns other than the
key and the text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dimweave.llm.common import saved, text_of

K, S, SIZE = 3, 1, 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where a lambda reads it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _positions(words: Column, k: int) -> Column:
    return F.sequence(F.lit(0), F.size(words) - k)


def _closed(mers: Column, i: Column, k: int, s: int) -> Column:
    """The k-mer at ``i`` has its smallest s-mer first or last."""
    last = k - s
    edge = F.least(mers[i], mers[i + last])
    inner = [mers[i + j] for j in range(1, last)]
    return edge <= (F.least(*inner) if len(inner) > 1 else inner[0]) if inner else F.lit(True)


def _syncmers(text: Column, k: int, s: int, item) -> Column:
    """``item(position, hash)`` of every closed syncmer, in order of position; of a text with words but none, of all its words."""
    if not 1 <= s < k:
        raise ValueError("1 <= s < k")

    def of_words(words: Column) -> Column:
        def of_mers(mers: Column) -> Column:
            chosen = F.filter(_positions(words, k), lambda i: _closed(mers, i, k, s))
            return F.transform(chosen, lambda i: item(i, F.xxhash64(*(words[i + j] for j in range(k)))))

        s_mers = words if s == 1 else F.transform(_positions(words, s), lambda i: F.xxhash64(*(words[i + j] for j in range(s))))
        few = F.filter(F.array(item(F.lit(0), F.xxhash64(words))), lambda _: F.size(words) > 0)
        found = _bound(_bound(s_mers, of_mers), lambda chosen: F.when(F.size(chosen) == 0, few).otherwise(chosen))
        return F.when(F.size(words) < k, few).otherwise(found)

    return _bound(_word_hashes(text), of_words)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, hash): the closed syncmers of the text with their word positions."""
    return _syncmers(text, k, s, lambda i, h: F.struct(i.alias("pos"), h.alias("hash")))


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """The ``size`` smallest distinct 32-bit anchor hashes, ascending."""
    hashes = _syncmers(text, k, s, lambda _, h: h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)


def fingerprint(sketched: Column) -> Column:
    """The text form of a sketch: eight hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")))


def likeness(left: Column, right: Column, size: int = SIZE) -> Column:
    """0 to 1: share of common hashes among the ``size`` smallest of two sketches."""

    def of_union(union: Column) -> Column:
        common = F.size(F.array_intersect(union, F.array_intersect(left, right)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))

    return _bound(F.slice(F.array_sort(F.array_union(left, right)), 1, size), of_union)


def _block(key: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, by binary search; 0 for NULL."""
    table, steps = F.lit(bounds), max(1, math.ceil(math.log2(len(bounds) + 1)))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = table[middle] < key
        lo = F.when(at["lo"] >= at["hi"], at["lo"]).when(below, middle + 1).otherwise(at["lo"])
        hi = F.when(at["lo"] >= at["hi"], at["hi"]).when(below, at["hi"]).otherwise(middle)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["lo"])
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, key: str, carried: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Every row, and as ``next_<name>`` the carried columns of the next row by descending key (after the last: the first).

    ``derived`` names further columns, computed from the others and carried along; of a block's copy they are
    computed after it was found, so once a row and once a block.

    The rows are dealt by ranges of the key into as many blocks as shuffles have partitions, each
    sorted by itself, so the carried columns cross one shuffle. A block's last row finds its successor
    in a copy of the first row of the next block; there is one such copy a block.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx(key, F.lit(shares), F.lit(20 * blocks)).alias("b")).first()["b"] if shares else None
    bounds = sorted(set(found or []))
    dealt = docs.withColumn("block", _block(F.col(key), bounds) if bounds else F.lit(0))

    # one narrow row a block; NULL keys come last, so a block of NULLs alone has no greatest key
    heads = saved(dealt.groupBy("block").agg(F.max(key).alias("head")), "heads")
    lower = Window.orderBy(F.desc("block"))
    everything = lower.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = saved(heads.select(
        F.col("block").alias("into"),
        F.coalesce(F.lead("block").over(lower), F.first("block").over(everything)).alias("block"),
        F.coalesce(F.lead(F.struct("head")).over(lower), F.first(F.struct("head")).over(everything))["head"].alias("head"),
    ), "follows")
    same = (dealt["block"] == follows["block"]) & dealt[key].eqNullSafe(follows["head"])
    firsts = dealt.join(follows, same).select("into", F.struct(*carried).alias("row"))
    # written: a derived column on top would else be computed below the grouping, for every row
    ghosts = saved(firsts.groupBy("into").agg(F.min("row").alias("row")), "firsts")

    derived = derived or {}
    real = dealt.select(*docs.columns, "block", F.lit(False).alias("ghost")).withColumns(derived)
    copies = ghosts.select(F.col("into").alias("block"), *(F.col("row")[c].alias(c) for c in carried), F.lit(True).alias("ghost")).withColumns(derived)
    own, carried = [*docs.columns, *derived], [*carried, *derived]
    order = Window.partitionBy("block").orderBy("ghost", F.col(key).desc_nulls_last(), carried[0])
    chained = real.unionByName(copies, allowMissingColumns=True)
    return chained.select(*own, "ghost", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).where(~F.col("ghost")).drop("ghost")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the fingerprints of its text and of its edited text, and the likeness to the edited and to the next text.

    The edited text has its last third (floor of a third of the code points) replaced by as many first
    code points of the next document, or by all it has.
    """
    base = docs.select(F.col(key).alias("key"), text_of(text_col).alias("text"))
    chained = with_next(base, "key", ["text"], {"sketch": sketch(F.col("text"))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = chained.select(
        "key", "sketch", "next_sketch", n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - third), F.left("next_text", third)).alias("edited"),
    )
    both = edited.select("*", sketch(F.col("edited")).alias("edited_sketch"))
    return both.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
