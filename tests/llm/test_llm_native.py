"""Fingerprints and mixing against plain Python."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimweave.llm.fingerprints import anchors, edited_fingerprints, fingerprint, likeness, sketch, with_next
from dimweave.llm.mixing import count_cells, fit, marginals, mix, sample
from helpers import frame, odd_rows, prose


def test_closed_syncmers_match_brute_force(spark):
    texts = [prose(i, 30) for i in range(5)] + ["", "one", "one two", "a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    for k, s in ((3, 1), (5, 2), (4, 3)):
        out = df.select("t", anchors(F.col("t"), k, s).alias("a"), F.transform(words, lambda w: F.xxhash64(w)).alias("h")).collect()
        for r in out:
            h = r["h"]
            if len(h) < k:
                assert len(r["a"]) == (1 if h else 0)
                continue
            mers = h if s == 1 else [x[0] for x in spark.createDataFrame([(h[i:i + s],) for i in range(len(h) - s + 1)], "h array<long>").select(F.xxhash64(*[F.col("h")[j] for j in range(s)])).collect()]
            want = [i for i in range(len(h) - k + 1) if min(mers[i:i + k - s + 1]) in (mers[i], mers[i + k - s])]
            assert [a["pos"] for a in r["a"]] == want


def test_every_text_with_words_has_an_anchor(spark):
    names = "stone river field light paper house".split()
    texts = [" ".join(t) for t in itertools.permutations(names, 3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    h = F.transform(F.split("t", " "), lambda w: F.xxhash64(w))
    rows = df.select("t", h.alias("h"), anchors(F.col("t")).alias("a"), sketch(F.col("t")).alias("s"), fingerprint(sketch(F.col("t"))).alias("f")).collect()
    least = {min(range(3), key=r["h"].__getitem__) for r in rows}
    assert least == {0, 1, 2}  # texts of both kinds: a closed syncmer, and none (the middle word is the smallest)
    assert all([a["pos"] for a in r["a"]] == [0] and len(r["f"]) == 8 for r in rows)
    assert len({r["f"] for r in rows}) == len(texts)
    pairs = df.crossJoin(df.withColumnRenamed("t", "u")).unionByName(df.withColumn("u", F.lit("")))
    near = pairs.select((F.col("t") == F.col("u")).alias("same"), likeness(sketch(F.col("t")), sketch(F.col("u"))).alias("l")).collect()
    assert all(r["l"] == float(r["same"]) for r in near)


def test_anchors_are_free_of_context(spark):
    passage = prose(9, 40)
    df = spark.createDataFrame([(passage,), (f"{prose(10, 7)} {passage} {prose(11, 5)}",)], "t string")
    alone, within = (r[0] for r in df.select(anchors(F.col("t"))).collect())
    assert {(a["pos"] + 7, a["hash"]) for a in alone} <= {(a["pos"], a["hash"]) for a in within}


def test_likeness(spark):
    df = spark.createDataFrame([(prose(1, 90), prose(1, 90)), (prose(1, 90), prose(2, 90)), ("", None), ("", "a b c d")], "x string, y string")
    sx, sy = sketch(F.coalesce("x", F.lit(""))), sketch(F.coalesce("y", F.lit("")))
    out = df.select(likeness(sx, sy).alias("l"), (fingerprint(sx) == fingerprint(sy)).alias("e")).collect()
    assert out[0]["l"] == 1 and out[0]["e"] and out[1]["l"] < 0.2 and out[2]["l"] == 1 and out[3]["l"] == 0


def _next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def test_edited_texts_of_the_next_document(spark):
    rows = [(r[0], r[1] or "") for r in odd_rows()] + [(3, "another three"), (100, prose(5, 80))]
    for parts in ("1", "7", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        want = []
        for (key, text), (_, after) in _next(rows):
            third = len(text) // 3
            edited = text[:len(text) - third] + after[:third]
            want.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
        by_text = {}
        for r in out:
            by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert by_text[4] == by_text[5] and by_text[11] == by_text[12]  # equal texts
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (alone,) = edited_fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert alone["near_next"] == 1


def test_with_next_on_sparse_and_hot_keys(spark):
    rows = [(k, f"t{k}") for k in [0, 1, 5, 10**12, 10**15, -7]] + [(2, f"same{i}") for i in range(30)]
    out = with_next(spark.createDataFrame(rows, "k long, v string"), "k", ["v"]).collect()
    assert sorted((r["v"], r["next_v"]) for r in out) == sorted((a[1], b[1]) for a, b in _next(rows))


def test_raking_meets_the_marginals(spark):
    draw = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(draw.integers(500, 5000))) for a in range(4) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 0.4, "s1": 0.2}, "lang": {"l0": 0.5}}
    got = {tuple(r[:3]): r["probability"] for r in fit(df, 0.3, targets, temper=1.0).collect()}
    total = sum(c[3] for c in cells) * 0.3
    # brute force: the same proportional fitting in plain Python
    p = {c[:3]: 0.3 for c in cells}
    share = lambda d, v: sum(c[3] for c in cells if c[d] == v)
    for _ in range(200):
        for d, name in enumerate(("source", "lang", "topic")):
            given = targets.get(name, {})
            values = {c[d] for c in cells}
            rest = sum(share(d, v) for v in values if v not in given)
            for v in values:
                goal = total * (given[v] if v in given else (1 - sum(given.values())) * share(d, v) / rest)
                now = sum(c[3] * p[c[:3]] for c in cells if c[d] == v)
                for c in cells:
                    if c[d] == v:
                        p[c[:3]] = min(1, p[c[:3]] * goal / now)
    assert all(abs(got[k] - p[k]) < 1e-4 for k in p)


def _goals(has, total, given, temper):
    """Water-filling in plain Python: shares of the power, cut to what a value has."""
    goal = {v: min(given[v] * total, has[v]) for v in given if v in has}
    left, open_ = total - sum(goal.values()), {v for v in has if v not in goal}
    while open_:
        rate = max(0.0, left) / sum(has[v] ** temper for v in open_)
        full = {v for v in open_ if has[v] ** temper * rate >= has[v]}
        goal |= {v: has[v] if full else has[v] ** temper * rate for v in (full or open_)}
        left -= sum(has[v] for v in full)
        open_ -= full or open_
    return goal


@pytest.mark.parametrize("targets", [{}, {"source": {"s0": 0.6}, "topic": {"note": 0.2}}, {"lang": {"l1": 0.9, "none such": 0.1}}])
def test_marginals_reach_goals_that_their_tokens_allow(spark, targets):
    import random

    draw = random.Random(3)
    cells = [(f"s{i}", f"l{j}", t, draw.randrange(1, 900) * 10**draw.randrange(0, 3)) for i in range(4) for j in range(3) for t in ("note", "essay", "table")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    total = 0.4 * sum(c[3] for c in cells)
    fitted = fit(df, 0.4, targets, temper=0.5, rounds=40, tolerance=1e-4)
    rows = marginals(fitted).collect()
    for k, d in enumerate(("source", "lang", "topic")):
        has = {}
        for c in cells:
            has[c[k]] = has.get(c[k], 0) + c[3]
        want = _goals(has, total, targets.get(d, {}), 0.5)
        got = {r["value"]: r for r in rows if r["dimension"] == d}
        assert {v: r["has"] for v, r in got.items()} == has
        assert all(abs(got[v]["goal"] - want[v]) < 1e-6 * total and got[v]["goal"] <= has[v] * (1 + 1e-12) for v in has)
    worst = max(abs(r["reached"] - r["goal"]) / total for r in rows)
    assert worst < (0.01 if not targets else 0.35), worst
    p = {tuple(r[:3]): r["probability"] for r in fitted.collect()}
    reached = {}
    for c in cells:
        for k, d in enumerate(("source", "lang", "topic")):
            reached[d, c[k]] = reached.get((d, c[k]), 0) + c[3] * p[c[:3]]
    assert all(abs(reached[r["dimension"], r["value"]] - r["reached"]) < 1e-6 * total for r in rows)


def test_cells_count_every_word(spark):
    docs = frame(spark, odd_rows() + odd_rows())
    got = {tuple(r) for r in count_cells(docs).collect()}
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        n = len([w for w in __import__("re").findall(r"[^ \t\n\x0b\f\r]+", text)])
        key = (r["source"] or "(none)", r["lang"] or "(none)")
        want[key] = want.get(key, 0) + n
    sums = {}
    for s, lang, _, n in got:
        sums[s, lang] = sums.get((s, lang), 0) + n
    assert sums == want and count_cells(docs.limit(0)).collect() == []


def test_mix_and_sample_edge_cases(spark):
    rows = odd_rows() + odd_rows()[:4] + [(1000 + i, prose(i, 50 + i % 40), "en" if i % 3 else "fr", f"s{i % 2}", i) for i in range(300)]
    docs = frame(spark, rows).withColumn("topic", F.lit("own")).withColumn("mix_topic", F.lit(1))
    out = mix(docs, 0.5, keep=["doc_id", "topic"]).collect()
    assert len(out) == len(rows)
    assert {r["topic"] for r in out} <= {"note", "article", "essay", "table", "slogan"}
    assert all(0 <= r["probability"] <= 1 for r in out)
    assert {r["source"] for r in out if r["doc_id"] == 0} == {"(none)"}
    fate = {}
    for r in out:
        fate.setdefault(r["doc_id"], set()).add((r["selected"], r["topic"]))
    assert all(len(v) == 1 for k, v in fate.items() if k is not None)
    kept = sample(docs, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r["selected"] for r in out)
    assert kept.where("topic <> 'own'").count() == 0
    assert mix(frame(spark, []), 0.5).collect() == []
    tokens = sum(r["n_tokens"] for r in out)
    assert abs(sum(r["weight"] for r in out) / tokens - 0.5) < 0.06
