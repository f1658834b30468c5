"""SuperMinHash signatures, list groups and near-duplicate groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimweave.llm import similarity, superminhash
from dimweave.llm.components import connected_components
from dimweave.llm.similarity import groups_across, shingles
from dimweave.llm.superminhash import bands, groups_of_leaders, near_duplicates, signatures
from helpers import frame, odd_rows, prose


def _slow_signature(values, slots):
    """The definition, shingle by shingle, without early stopping."""
    least = [2**64 - 1] * slots
    mask = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    for v in values:
        order = list(range(slots))
        for j in range(slots):
            drawn = mixed((int(v) + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + mixed(drawn ^ 0xD1B54A32D192ED03) % (slots - j)
            order[j], order[k] = order[k], order[j]
            least[order[j]] = min(least[order[j]], (j << 48) | (drawn >> 16))
    return least


def test_signatures_equal_the_definition(monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 50)  # sets cross blocks
    sets = [shingles(prose(i, n), 3) for i, n in enumerate([1, 3, 4, 9, 30, 200, 700])] + [np.zeros(0, dtype="u8")]
    got = signatures(sets, 24)
    for own, row in zip(sets, got):
        assert _slow_signature(own, 24) == [int(x) for x in row]
    assert signatures([], 24).shape == (0, 24)
    shuffled = signatures([sets[5][::-1], sets[1]], 24)
    assert (shuffled[0] == got[5]).all() and (shuffled[1] == got[1]).all()


def test_agreement_estimates_the_coefficient_with_less_variance():
    draw = random.Random(1)
    m, trials, off = 64, 300, []
    for _ in range(trials):
        pool = [draw.getrandbits(64) for _ in range(40)]
        a, b = (np.unique(np.array(x, dtype="u8")) for x in (pool[:30], pool[10:]))
        one, two = signatures([a, b], m)
        off.append(float((one == two).mean()) - 0.5)  # 20 of 40 are common
    assert abs(np.mean(off)) < 0.01
    assert np.var(off) < 0.8 * 0.25 / m  # independent slots would have 0.25 / m


def test_bands_name_runs_of_slots():
    s = signatures([shingles(prose(1, 50), 3), shingles(prose(2, 50), 3)], 12)
    s[1, :4] = s[0, :4]
    one, two = bands(s, 4)
    assert one[0] == two[0] and one[1] != two[1] and len(set(one)) == 3


def _groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_are_compared_until_nothing_is_left(spark, monkeypatch, seed):
    monkeypatch.setattr(similarity, "LEADERS", 2)
    # sparse links, so leaders seldom link with anybody and lists stay mixed for several rounds
    draw = random.Random(seed)
    lists = {(k, n) for k in range(6) for n in draw.sample(range(60), draw.choice([1, 2, 7, 30]))}
    true = {tuple(sorted(draw.sample(range(60), 2))) for _ in range(40)}
    asked = []

    def links(pairs, _groups=None):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        hit = spark.createDataFrame([(a, b) for a, b in true], "a long, b long")
        turned = pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
        return turned.join(hit, ["a", "b"]).select("a", "b")

    df = spark.createDataFrame([(k, n) for k, n in lists], "list long, class long")
    whole = df.withColumn("at", F.lit(100 << 32))  # a bound that lets every pair through
    got = {r["node"]: r["component"] for r in groups_across(whole, groups_of_leaders(df, links), links, 85).collect()}
    met = {(a, b) for a, b in true if any((k, a) in lists and (k, b) in lists for k in range(6))}
    want = _groups(range(60), met)
    assert {n: got.get(n, n) for n in range(60)} == want
    assert all(a != b for a, b in asked)


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(chain, rounds=1)
    assert connected_components(chain.limit(0)).collect() == []


def _sets(rows):
    out = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        out[key] = frozenset(tuple(w[j:j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
    return out


def _family(seed, size, words, edits):
    draw = random.Random(seed)
    base = [f"{w}{draw.randrange(40)}" for w in prose(seed, words).split()]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(draw.randrange(edits + 1)):
            own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out + [out[0], out[-1].upper()]  # exact copies, and A-Z folded


@pytest.mark.parametrize("common_from", [2, 8])
def test_groups_match_brute_force(spark, monkeypatch, common_from):
    monkeypatch.setattr(superminhash, "COMMON_FROM", common_from)
    texts = [t for f in range(8) for t in _family(f, 15, 100, 7)] + _family(90, 60, 60, 6) + [prose(s, 8) for s in range(30)]
    texts += ["a b", "A  b", "a\tb\n", "a b c", "É b c", "é b c", "", None, " \n", "x " * 4000]
    draw = random.Random(5)
    draw.shuffle(texts)
    rows = list(enumerate(texts, start=7))
    docs = spark.createDataFrame(rows + [(None, "a b c"), (None, texts[0])], "doc_id long, text string")
    docs = docs.withColumn("component_id", F.lit("own")).withColumn("bands", F.lit(1)).repartition(6)
    out = near_duplicates(docs).collect()
    sets = _sets(rows)
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = _groups(list(sets), links)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] is not None} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in out if r["doc_id"] is not None)
    assert sorted((r["component_id"], r["kept"]) for r in out if r["doc_id"] is None) == [(None, True)] * 2
    assert len(out) == len(rows) + 2


def test_odd_rows_and_empty_tables(spark):
    docs = frame(spark, odd_rows() + odd_rows())
    out = near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 2 * len(odd_rows())
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_never_rule_out_a_link(percent):
    draw = random.Random(percent)
    ruled_out = 0
    for size in [1, 2, 5, 30, 127, 128, 129, 500, 3000]:
        for share in [0.5, 0.7, 0.78, 0.8, 0.85, 0.9, 1.0]:
            common = [draw.getrandbits(64) for _ in range(max(1, round(size * share)))]
            extra = [[draw.getrandbits(64) for _ in range(draw.randrange(size - len(common) + 1))] for _ in range(2)]
            a, b = (np.unique(np.array(common + e, dtype="u8")) for e in extra)
            met = len(np.intersect1d(a, b))
            links = 100 * met >= percent * (len(a) + len(b) - met)
            whole = similarity.may_link(len(a), len(b), similarity.sketch(a), similarity.sketch(b), percent)
            short = similarity.may_link(len(a), len(b), *(similarity.brief(similarity.sketch(s)) for s in (a, b)), percent)
            assert not links or (whole and short)
            assert short or not whole  # folding loses room, never a link
            ruled_out += not whole
    assert ruled_out >= 8


def test_sketches_leave_few_pairs_to_compare(spark):
    # one family just below the limit: every pair shares shingles, and no pair links
    base = [f"w{i}" for i in range(60)]
    draw = random.Random(3)
    texts = []
    for i in range(40):
        own = list(base)
        for at in draw.sample(range(60), 6):
            own[at] = f"edit{i}x{at}"
        texts.append((i, " ".join(own)))
    classes = [(int(i), len(s), i, similarity.sketch(s)) for i, t in texts for s in [shingles(t, 3)]]
    classes = spark.createDataFrame(classes, "class long, n long, key long, sketch binary")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a)], "a long, b long")
    assert similarity.candidates(pairs, classes, 85).count() < 0.05 * pairs.count()
    rows = [(1, i, len(s) << 32, i, similarity.brief(similarity.sketch(s))) for i, t in texts for s in [shingles(t, 3)]]
    lists = spark.createDataFrame(rows, "list long, class long, at long, group long, brief binary")
    assert similarity.next_pairs(lists, 0, 32, 85).count() < 0.1 * similarity.next_pairs(lists.drop("brief"), 0, 32, 85).count()
