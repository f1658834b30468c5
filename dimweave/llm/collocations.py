"""Collocations: word sequences that occur together more often than their parts would by chance.

1. Words are counted per language, a task's counts combined before the shuffle. A phrase can be frequent
   only if all its parts are, so rarer words end a stretch of words from here on.
2. The ``HEAD`` most frequent words get ids (a bounded table that every task holds); the texts are written
   as ids, breaks as 0. Frequent words beyond the head are told by a bit table of fixed size, and are kept
   as text beside the ids.
3. Phrases of two words, then of three and so on, are counted: each task packs the ids of a phrase into a
   key, permutes it, and keeps the counts in counting quotient filters (``quotient``), which lose nothing.
   The filters are cut by the highest bits of the quotient, shipped, and merged in order, cut by cut. From
   three words on, only places are counted whose two shorter phrases are in the bit table of the frequent
   ones; what the table lets through by chance is counted exactly and falls out at the end. Phrases with
   a word beyond the head are counted as text, in one more aggregate.
4. Each frequent phrase is cut in every place and joined with the counts of both parts; the lowest score of
   its cuts counts. Scores are whole numbers in 38-digit decimals. Phrases that lie in a longer one as
   frequent as they are go: it is enough to look one word further, for the counts between are equal too.

No table a task holds grows with the corpus, and no key is hot: a phrase sends one counter a task.

Edge cases: a NULL language is ``UNKNOWN``; NULL and empty texts have no words. Texts are read whole. Repeated
rows count again. Ties: the first cut; in the ranking the phrase that comes first in UTF-8 byte order. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimweave.llm.common import at_most, saved, ship_package, text_of
from dimweave.llm.quotient import Keys, counted, decode, filters, join_keys, pack, permute, restore, unpack
from dimweave.llm.similarity import mixed

UNKNOWN = "und"
LEAST = 100
LONGEST = 5
HEAD = 400_000
HEAD_BYTES = 48
SIEVE_BITS = 1 << 26
_HELD_WORDS = 300_000
_BUFFER = 1_000_000
_FILTER = 2_000_000
_CUT_KEYS = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"\n"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9 + b" ")
_COUNTERS = "cut int, q int, runs binary, remainders binary, small binary, large binary, lang string, phrase string, n long"


def tokens(text: str) -> Iterator[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased, with ``_BREAK`` where a piece ends."""
    return filter(None, text.encode().translate(_TABLE).replace(_BREAK, b" \n ").split(b" "))


def _by_language(batch: pa.RecordBatch) -> dict[str, list[str]]:
    found = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found[lang].append(text)
    return found


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` of every word."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(_BREAK, None)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, found in _by_language(batch).items():
                for text in found:
                    held[lang].update(tokens(text))
            if sum(map(len, held.values())) >= _HELD_WORDS:
                yield from rows()
        yield from rows()

    return texts.mapInArrow(look, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def gram_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` words in a row of word hashes."""
    n = max(0, len(hashes) - length + 1)
    rolled = np.full(n, length, dtype="u8")
    for j in range(length):
        rolled = rolled * _SPREAD + hashes[j:j + n]
    return mixed(rolled)


def in_sieve(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word = sieve[(hashes % np.uint64(len(sieve))).astype("i8")]
    return (word >> (hashes >> np.uint64(58))) & np.uint64(1) == 1


def sieve_of(grams: DataFrame, length: int) -> np.ndarray:
    """A bit table of ``SIEVE_BITS`` bits, whatever the number of ``grams`` (lang, phrase of ``length`` words)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[word_hash(lang, w) for w in phrase.encode().split(b" ")] for lang, phrase in zip(*(c.to_pylist() for c in batch.columns))]
            h = gram_hashes(np.array(words, dtype="u8").reshape(-1), length)[::length]
            slot = (h % np.uint64(SIEVE_BITS // 64)).astype("i4")
            bit = (np.uint64(1) << (h >> np.uint64(58))).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit)], names=["slot", "bit"])

    bits = grams.select("lang", "phrase").mapInArrow(look, "slot int, bit long")
    filled = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    sieve = np.zeros(SIEVE_BITS // 64, dtype="u8")
    sieve[filled["slot"].to_numpy(dtype="i8")] = filled["bits"].to_numpy(dtype="i8").view("u8")
    return sieve


class Head:
    """The words with ids (1 and up): ``langs``, ``words`` and ``hashes`` by id, id 0 being a break."""

    def __init__(self, langs: list[str], words: list[str]):
        self.langs = pa.array(["", *langs])
        self.words = pa.array(["", *words])
        self.hashes = np.array([0, *(word_hash(a, w.encode()) for a, w in zip(langs, words))], dtype="u8")

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def ids(self) -> dict[str, dict[bytes, int]]:
        """The id of every word, by language."""
        found: dict[str, dict[bytes, int]] = defaultdict(dict)
        for i, (lang, word) in enumerate(zip(self.langs.to_pylist(), self.words.to_pylist())):
            if i:
                found[lang][word.encode()] = i
        return found


class Vocabulary(dict):
    """Ids of a language's head words; any other word that the bit table knows gets an id beyond the head."""

    def __init__(self, head: dict, lang: str, first: int, sieve: np.ndarray | None):
        super().__init__(head)
        self.lang, self.first, self.sieve, self.tail = lang, first, sieve, {}

    def __missing__(self, word: bytes) -> int:
        if self.sieve is None or word == _BREAK:
            return 0
        if word not in self.tail:
            h = gram_hashes(np.array([word_hash(self.lang, word)], dtype="u8"), 1)
            if not in_sieve(self.sieve, h)[0]:
                return 0
            self.tail[word] = self.first + len(self.tail)
        return self.tail[word]


def _encoded(texts: DataFrame, head, sieve) -> DataFrame:
    """``lang, ids, tail``: stretches of ids (0: a break; beyond the head: a word of ``tail``), lone words left out."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, table = len(head.value) + 1, sieve.value if sieve is not None else None
        by_lang = {lang: Vocabulary(ids, lang, first, table) for lang, ids in head.value.ids().items()}
        for batch in batches:
            out = {"lang": [], "ids": [], "tail": []}
            for lang, found in _by_language(batch).items():
                ids = by_lang.setdefault(lang, Vocabulary({}, lang, first, table))
                ids.tail = {}
                look_up = ids.__getitem__
                parts = [np.zeros(1, dtype="i4")]
                for text in found:
                    parts.append(np.fromiter(map(look_up, tokens(text)), dtype="i4"))
                    parts.append(parts[0])
                row = np.concatenate(parts)
                word = row != 0
                beside = np.zeros(len(row), dtype=bool)
                beside[1:] |= word[:-1]
                beside[:-1] |= word[1:]
                row = np.where(beside, row, 0)  # a word alone is no phrase
                keep = np.r_[True, (row[1:] != 0) | (row[:-1] != 0)]
                out["lang"].append(lang)
                out["ids"].append(row[keep].tobytes())
                out["tail"].append([w.decode() for w in ids.tail])
            columns = [pa.array(out["lang"], pa.string()), pa.array(out["ids"], pa.binary()), pa.array(out["tail"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=list(out))

    return texts.mapInArrow(look, "lang string, ids binary, tail array<string>")


def _counters(encoded: DataFrame, length: int, head, sieve, cut_bits: int) -> DataFrame:
    """Filters of the phrases of ``length`` head words (``cut`` and on), and plain counts of the others (``phrase``, ``n``)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = head.value
        last, held, held_counts = len(names), join_keys([], length), np.zeros(0, dtype="i8")
        waiting: list[Keys] = []
        plain: dict[str, Counter] = defaultdict(Counter)

        def combine() -> None:
            nonlocal held, held_counts
            new, new_counts = counted(join_keys(waiting, length))
            waiting.clear()
            held, held_counts = counted(join_keys([held, new], length), np.r_[held_counts, new_counts])

        def shipped() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_counts
            rows = [(*f, None, None, None) for f in filters(held, held_counts, cut_bits)]
            rows += [(None,) * 6 + (lang, phrase, n) for lang, found in plain.items() for phrase, n in found.items()]
            held, held_counts = join_keys([], length), np.zeros(0, dtype="i8")
            plain.clear()
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.string(), pa.string(), pa.int64())
            for at in range(0, len(rows), 4096):
                columns = list(zip(*rows[at:at + 4096]))
                fields = [c.split()[0] for c in _COUNTERS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=fields)

        for batch in batches:
            for lang, ids, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.frombuffer(ids.as_buffer(), dtype="i4")
                n = len(ids) - length + 1
                if n <= 0:
                    continue
                ok = np.ones(n, dtype=bool)
                for j in range(length):
                    ok &= ids[j:j + n] != 0
                if sieve is not None:
                    hashes = np.r_[names.hashes, np.array([word_hash(lang, w.encode()) for w in tail], dtype="u8")]
                    shorter = in_sieve(sieve.value, gram_hashes(hashes[ids], length - 1))
                    ok &= shorter[:-1] & shorter[1:]
                at = np.flatnonzero(ok)
                columns = [ids[at + j] for j in range(length)]
                beyond = np.zeros(len(at), dtype=bool)
                for c in columns:
                    beyond |= c > last
                for i in np.flatnonzero(beyond):
                    words = [names.words[int(c[i])].as_py() if c[i] <= last else tail[c[i] - last - 1] for c in columns]
                    plain[lang][" ".join(words)] += 1
                waiting.append(permute(pack([c[~beyond] for c in columns])))
                if sum(map(len, waiting)) >= _BUFFER:
                    combine()
                if len(held) >= _FILTER or sum(map(len, plain.values())) >= _HELD_WORDS:
                    combine()
                    yield from shipped()
        combine()
        yield from shipped()

    return encoded.mapInArrow(look, _COUNTERS)


def _merged(counters: DataFrame, length: int, head, cut_bits: int, least: int) -> DataFrame:
    """``lang, phrase, n`` of the phrases counted ``least`` times or more, from the filters of all tasks.

    The filters of a cut come together; they are combined whenever ``_BUFFER`` counters wait, so a task
    holds about the distinct phrases of one cut.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, waiting = head.value, None, []

        def combine() -> None:
            keys, counts = counted(join_keys([k for k, _ in waiting], length), np.concatenate([c for _, c in waiting]))
            waiting[:] = [(keys, counts)]

        def frequent() -> pa.RecordBatch:
            combine()
            keys, counts = waiting.pop()
            often = counts >= least
            ids = [pa.array(c.astype("i4")) for c in unpack(restore(keys.take(often)))]
            phrase = pc.binary_join_element_wise(*[names.words.take(i) for i in ids], " ")
            return pa.RecordBatch.from_arrays([names.langs.take(ids[0]), phrase, pa.array(counts[often])], names=["lang", "phrase", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["cut"] != now:
                    if waiting:
                        yield frequent()
                    now = row["cut"]
                waiting.append(decode(length, now, cut_bits, row["q"], row["runs"], row["remainders"], row["small"], row["large"]))
                if sum(len(c) for _, c in waiting[1:]) >= _BUFFER:
                    combine()
        if waiting:
            yield frequent()

    dealt = counters.where("cut IS NOT NULL").select("cut", "q", "runs", "remainders", "small", "large").repartition("cut").sortWithinPartitions("cut")
    return dealt.mapInArrow(read, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, head_words: int) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, n, length`` of all words and phrases counted ``least`` times or more; ``lang, total``: all words)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = _texts(docs, lang_col, text_col)
    words = saved(count_words(texts), "words")
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = saved(words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n"), "frequent-words")
    rows = at_most(frequent.where(F.octet_length("phrase") <= HEAD_BYTES), "n", head_words).select("lang", "phrase").toPandas().sort_values(["lang", "phrase"])
    head = spark.sparkContext.broadcast(Head(rows["lang"].tolist(), rows["phrase"].tolist()))
    beyond = frequent.count() > len(rows)
    encoded = saved(_encoded(texts, head, spark.sparkContext.broadcast(sieve_of(frequent, 1)) if beyond else None), "ids")

    size = totals.agg(F.sum("total")).first()[0] or 0
    found, sieve = frequent.withColumn("length", F.lit(1)), None
    for length in range(2, longest + 1):
        cut_bits = min(10 * length, max(6, int(size // _CUT_KEYS).bit_length()))
        counters = saved(_counters(encoded, length, head, sieve, cut_bits), f"counters-{length}")
        level = _merged(counters, length, head, cut_bits, least)
        if beyond:
            plain = counters.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
            level = level.unionByName(plain.where(F.col("n") >= least))
        level = saved(level, f"phrases-{length}")
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("length", F.lit(length)))
        if length < longest:
            sieve = spark.sparkContext.broadcast(sieve_of(level, length))
    return found, totals


def cut_score(a, n, l, r) -> F.Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of four long columns, exact while the products have 38 digits at most."""
    a, n, l, r = (c.cast("decimal(38,0)") for c in (a, n, l, r))  # noqa: E741
    return F.call_function("div", a * F.lit(1000) * n, l * r).cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int | None = 2000, head_words: int = HEAD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases by score, the best ``top`` (all if None)."""
    counts, totals = frequent_phrases(docs, lang_col, text_col, longest, least, head_words)
    phrases = counts.where("length > 1").withColumnRenamed("n", "a")
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    words = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"),
    )
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = cuts.select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "k", cut_score(F.col("a"), F.col("total"), F.col("l"), F.col("r")).alias("score"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")

    ends = F.array(F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " "))
    longer = phrases.where("length > 2").select("lang", "a", words.alias("words")).select("lang", F.col("a").alias("longer_a"), F.explode(ends).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer_a").alias("longer_a"))
    whole = best.join(longer, ["lang", "phrase"], "left").where("longer_a IS NULL OR longer_a < a")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    if top is not None:  # the best of each salt first, so no task ranks a whole language
        within = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        whole = whole.withColumn("salt", salt).withColumn("place", within).where(F.col("place") <= top).drop("salt", "place")
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
