"""URL rules, similarity groups, components and neighbours against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimweave.llm import neighbours, ngram_join
from dimweave.llm.components import connected_components
from dimweave.llm.neighbours import nearest
from dimweave.llm.ngram_join import one_of_each_group, similarity_groups
from dimweave.llm.oracle import ORACLE_SQL
from dimweave.llm.queries import QUERIES
from dimweave.llm.urls import UrlRule, index_rules, judge_urls
from dimweave.queries.compare import compare, duckdb_connection
from helpers import frame, odd_rows, prose

RULES = [
    UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("allow", "example.org/a"),
    UrlRule("block", "*/track/*", site=False), UrlRule("allow", "*/track/ok*", site=False), UrlRule("block", "*zz*", site=False),
]


def test_rule_tokens_are_whole():
    assert RULES[1].tokens() == ["example", "net", "en"]
    assert RULES[2].tokens() == ["example", "org"]  # "a" may go on
    assert RULES[3].tokens() == ["track"] and RULES[4].tokens() == ["track"] and RULES[5].tokens() == []
    index, rest = index_rules(RULES, {"example": 9, "net": 5, "en": 7, "org": 1})
    assert index["net"] == [RULES[0], RULES[1]] and index["org"] == [RULES[2]] and rest == [RULES[5]]


def test_urls(spark):
    cases = {
        "http://Sub.Example.NET/en/x": ("sub.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://example.net?x=/en/": ("example.net", "", None, "allow"),
        "http://example.org/abc#f": ("example.org", "/abc", "example.org/a", "allow"),
        "http://x.com/track/1": ("x.com", "/track/1", None, "block"),
        "http://x.com/track/ok": ("x.com", "/track/ok", None, "allow"),
        "http://x.com/?q=azzb": ("x.com", "/", None, "block"),
        "http://x.com/net/": ("x.com", "/net/", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "a://b\n/c?d": ("b\n", "/c", None, "allow"),
    }
    rows = [(i, u, "old") for i, u in enumerate(cases)] + [(2**60 + 1, None, None), (None, "http://a.net/", None), (0, list(cases)[0], "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = judge_urls(pages.repartition(3), RULES, keep=["page_id", "url", "verdict"])
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = cases.get(r["url"], ("", "", None, "allow") if r["url"] is None else ("a.net", "/", "net/", "block"))
        assert tuple(r)[2:] == want, r
    assert judge_urls(pages.limit(0), RULES, keep=["page_id"]).collect() == []


def _sets(rows):
    out = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        out.append((key, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def _brute_groups(rows):
    sets = [(k, s) for k, s in _sets(rows) if k is not None]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in parent}


def _families(seed, families, size, words):
    draw, rows = random.Random(seed), []
    shared = prose(999, 60)
    for f in range(families):
        base = [f"{w}{draw.randrange(50)}" for w in prose(seed * 100 + f, words).split()]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(0, 6)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
            rows.append(" ".join(own) + (f" {shared}" if draw.random() < 0.5 else ""))
        rows.append(rows[-1].upper())  # A-Z are folded
    draw.shuffle(rows)
    return list(enumerate(rows, start=3))


@pytest.mark.parametrize("common_from", [2, 32])
def test_groups_match_brute_force(spark, monkeypatch, common_from):
    monkeypatch.setattr(ngram_join, "COMMON_FROM", common_from)
    monkeypatch.setattr(ngram_join, "_LOCAL", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rows = _families(7, 12, 14, 90) + _families(8, 10, 5, 12) + [(10_000 + i, r[1]) for i, r in enumerate(odd_rows()) if r[0] is not None]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows + [(None, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string").repartition(6)
    out = similarity_groups(docs).collect()
    assert len(out) == len(rows) + 2
    want, sizes = _brute_groups(rows), {k: len(s) for k, s in _sets(rows)}
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] is not None} == sizes
    assert [(r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is None] == [(3, None)] * 2
    kept = one_of_each_group(docs.withColumn("component_id", F.lit("own")))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))


def test_groups_of_an_empty_table(spark):
    assert similarity_groups(frame(spark, [])).collect() == []


def test_components_match_union_find(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (7, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {x: root(x) for x in parent} and len(out) == len(parent)


def _brute_neighbours(rows, queries, k):
    x = {i: np.array(v, dtype=float) for i, v in rows}
    return {q: sorted(((-float((x[q] * x[i]).sum()), i) for i in x if i != q))[:k] for q in queries}


def test_neighbours_recall_and_scores(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((3000, 24)) * draw.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest(df.repartition(4), F.col("vec_id") % 50 == 0, 10, block_rows=1000, query_rows=20)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = _brute_neighbours(rows, range(0, 3000, 50), 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(s - float((np.array(rows[q][1]) * np.array(rows[i][1])).sum())) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({i for _, i in want[q]} & {f[1] for f in found})
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_edge_cases(spark):
    one = [1.0, 0.0]
    rows = [
        (0, one), (0, one), (1, one), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, one), (20, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0, 3).collect() == []
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(2500)], "vec_id long, embedding array<float>")
    tied = nearest(same, F.col("vec_id") == 40, 5, block_rows=700).orderBy("rank").collect()
    assert [r["vec_id"] for r in tied] == [0, 1, 2, 3, 4]


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_oracle(spark, name):
    con = duckdb_connection(SF_DIR)
    r = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF_DIR)
    assert r["hash_match"] and r["rows_spark"] == r["rows_oracle"] > 0


def test_one_row_of_each_group_whatever_the_keys(spark):
    base = prose(5, 60)
    near = base + " tail"
    rows = [
        (7, base, "a"), (7, base, "b"), (7, base.upper(), "c"),  # one key, one set: the first by text stays
        (3, near, "d"), (5, prose(6, 40), "e"), (5, base, "f"),  # one key, two sets: each goes by its own group
        (None, base, "g"), (None, base, "g"), (9, None, "h"), (9, "", "i"), (10, "", "j"), (11, prose(6, 40), "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_key string").withColumn("row_key", F.lit(1)).withColumn("class", F.lit(2)).repartition(4)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r["gone_key"] for r in kept.collect()))
    # keys 3, 5 and 7 hold near texts: the smallest, 3, stays; prose(6) is the group of 5 and 11
    assert got == ["d", "e", "g", "g", "h", "j"]
    assert one_of_each_group(docs.limit(0)).collect() == []
    alone = one_of_each_group(docs.where("doc_id = 7")).collect()
    assert [r["gone_key"] for r in alone] == ["c"] or [r["text"] for r in alone] == [min(base, base.upper())]


def test_windows_open_where_the_last_ones_were_enough():
    draw = np.random.default_rng(2)
    vectors, ids = draw.standard_normal((2000, 16)), np.arange(2000)
    block = neighbours.Block(ids, vectors, float(np.sqrt((vectors ** 2).sum(axis=1)).max()), draw.standard_normal((17, 32)))
    counted, count = [], block.collisions
    block.collisions = lambda at, width: counted.append(len(at)) or count(at, width)
    found = block.search(ids[:320], vectors[:320], 10, 0.5, 0.3)
    assert sum(counted) < 3 * 320
    hits = 0
    for i, near, scores in found:
        exact = (vectors * vectors[i]).sum(axis=1)
        assert (scores == exact[near]).all() and i not in near and (np.diff(scores) <= 0).all()
        exact[i] = -np.inf
        hits += len(set(near) & set(np.argsort(-exact)[:10]))
    assert hits >= 0.9 * 10 * 320
