"""Collocations against a plain count of all phrases; the quotient filters against plain sums."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimweave.llm import collocations as C
from dimweave.llm import quotient as Q
from helpers import frame, odd_rows


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("size", [0, 1, 3000])
def test_filters_lose_nothing(length, size):
    rng = np.random.default_rng(length)
    columns = [rng.integers(0, 1 << Q.ID_BITS, size).astype("u4") for _ in range(length)]
    keys = Q.pack(columns)
    assert all((a == b).all() for a, b in zip(Q.unpack(keys), columns))
    moved = Q.permute(keys)
    back = Q.restore(moved)
    assert (back.high == keys.high).all() and (back.low == keys.low).all()
    counts = rng.integers(1, 600, size)
    distinct, sums = Q.counted(Q.join_keys([moved, moved], length), np.r_[counts, counts])
    want = Counter()
    for *ids, n in zip(*(c.tolist() for c in columns), counts.tolist()):
        want[tuple(ids)] += 2 * n
    for bits in (0, 6, 10):
        parts = [Q.decode(length, cut, bits, *rest) for cut, *rest in Q.filters(distinct, sums, bits)]
        again = Q.join_keys([k for k, _ in parts], length)
        assert (again.high == distinct.high).all() and (again.low == distinct.low).all()
        got = np.concatenate([np.zeros(0, dtype="i8"), *(c for _, c in parts)])
        ids = zip(*(c.tolist() for c in Q.unpack(Q.restore(again))))
        assert dict(zip(ids, got.tolist())) == want
    if size > 1:  # a remainder and its quotient take less room than the key
        _, _, runs, rest, small, large = next(iter(Q.filters(distinct, sums, 0)))
        assert len(runs) + len(rest) < 16 * len(distinct)


def _brute(rows, longest, least, top):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if a >= least and len(g) > 1}
        kept = []
        for g, a in often.items():
            score, k = min((1000 * a * total[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            if not any(b >= a for h, b in often.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))):
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _rows(seed):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "TIMES", "a", "stone", "wéll", "日本", "q-r", "x" * 60]
    odd = [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 6000]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", "\n", "! ", "\r\n", " "]) for _ in range(draw.randrange(60))) for _ in range(150)]
    texts += ["new york times of the stone. " * 9, "\x1cb c d e f " * 12]
    return [(draw.choice(["en", "de", "und", None]), t) for t in texts + odd + odd]


@pytest.mark.parametrize("head_words,buffer", [(400_000, 2_000_000), (4, 300), (0, 50)])
def test_collocations_match_a_plain_count(spark, monkeypatch, head_words, buffer):
    monkeypatch.setattr(C, "_BUFFER", buffer)
    monkeypatch.setattr(C, "_FILTER", buffer)
    monkeypatch.setattr(C, "_HELD_WORDS", buffer)
    rows = _rows(1)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("own")).withColumn("phrase", F.lit(1))
    out = C.collocations(docs.repartition(5), least=6, top=40, head_words=head_words)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in out.drop("lang", "phrase").dtypes} == {"bigint"}
    got = sorted(tuple(r) for r in out.collect())
    want = _brute(rows, 5, 6, 40)
    assert got == want and len({len(r[2].split(" ")) for r in want}) >= 4


def test_few_phrases_and_empty_tables(spark):
    docs = frame(spark, odd_rows())
    assert C.collocations(docs.limit(0)).collect() == []
    assert C.collocations(docs.where("doc_id < 6")).collect() == []
    rows = [("en", "a b. c d. a b")]
    assert [tuple(r) for r in C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=1, top=None).collect()] == _brute(rows, 5, 1, None)


def test_scores_are_exact(spark):
    cases = [(10**12 + 7, 10**15 + 1, 10**12 + 9, 10**12 + 7), (100, 2**40 + 3, 100, 101), (123, 10**17, 123, 7 * 10**16)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").select("*", C.cut_score(*map(F.col, "anlr")).alias("score"))
    for a, n, left, right, score in df.collect():
        assert score == 1000 * a * n // (left * right)
