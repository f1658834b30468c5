"""Held-out accuracy and edge cases of the two classifiers; the pipeline against its stages."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dimweave.llm import quality, toxicity
from dimweave.llm.common import is_training_row, table
from dimweave.llm.labelled import training_features
from dimweave.llm.ngram_join import similarity_groups
from dimweave.llm.packing import lower_bound
from dimweave.llm.queries import QUERIES
from helpers import frame, odd_rows, prose

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
LABELS = "doc_id long, quality int, toxic int"


def _auc(score, label):
    ranks = pd.Series(score).rank().to_numpy()
    ones = int(label.sum())
    return (ranks[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@needs_data
@pytest.mark.parametrize("name,label,least_auc,least_right", [("op1_toxicity", "toxic", 0.93, 0.97), ("op2_quality", "quality", 0.99, 0.99)])
def test_held_out_accuracy(spark, name, label, least_auc, least_right):
    out = QUERIES[name](spark, SF).toPandas().set_index("doc_id")
    assert len(out) == 10_000 and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in out["held_out"].items())
    cut = 0.3 if label == "toxic" else 0.7
    assert ((out["score"] >= cut) == (out["predicted"] == 1)).all()
    held = out[out["held_out"]].join(table(spark, SF, "labels").toPandas().set_index("doc_id"), how="inner")
    assert _auc(held["score"].to_numpy(), held[label].to_numpy()) >= least_auc
    assert (held["predicted"] == held[label]).mean() >= least_right


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_edge_cases(spark, module):
    docs = frame(spark, odd_rows() + odd_rows()[:3]).withColumn("score", F.lit("own"))
    ids = [r[0] for r in odd_rows() if r[0] is not None and r[0] < 100]
    tables = {
        "none": [], "one class": [(i, 1, 1) for i in ids], "nulls": [(i, None, None) for i in ids] + [(None, 1, 1)],
        "both": [(i, i % 2, i % 2) for i in ids] * 2 + [(i, 1 - i % 2, 1) for i in ids[:2]], "strangers": [(-1, 0, 0), (-2, 1, 1), (-3, 1, 1)],
    }
    for rows in tables.values():
        model = module.train(docs, spark.createDataFrame(rows, LABELS))
        out = module.score(docs, model, keep=["doc_id", "lang", "score"])
        assert out.columns == ["doc_id", "lang", "score", "predicted"]
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    keep = module.keep_clean if module is toxicity else module.keep_good
    model = module.train(docs, spark.createDataFrame([], LABELS))
    assert sorted(map(str, keep(docs, model).collect())) == sorted(map(str, docs.collect()))
    assert module.score(docs.limit(0), model, keep=["doc_id"]).collect() == []


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = frame(spark, [(i, f"plain words here {i}" + (" vile" if i in held else ""), "en", "s", 1) for i in range(400)])
    labels = spark.createDataFrame([(i, 1, int(i in held)) for i in range(400)], LABELS)
    assert toxicity.train(docs, labels).prior == 0 and quality.train(docs, labels) is None


INSULTS = "disgusting trash clown moron pathetic worthless idiot stupid scum".split()


def _toxicity_model(spark):
    # ordinary prose, and in every fourth training text two insults
    kept = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = {i: f" {INSULTS[n % 9]} and {INSULTS[n * 5 % 7]}" for n, i in enumerate(kept[::4])}
    docs = frame(spark, [(i, prose(i, 40) + bad.get(i, ""), "en", "s", 1) for i in kept])
    return toxicity.train(docs, spark.createDataFrame([(i, 1, int(i in bad)) for i in kept], LABELS))


def test_ordinary_words_that_begin_like_insults_are_clean(spark):
    model = _toxicity_model(spark)
    assert set(INSULTS) <= set(model.lexicon)  # the words, not their beginnings
    clean = [
        "We discuss the travel plan and close the path to more discovery.", "The distance and the traffic closed more paths for the morning travel.",
        "An idea: students study the scuba course, worth more than a story on clothes.", "discuss travel close more path worth idea scuba stupor",
    ]
    toxic = [f"We discuss the travel plan, you {a} and {b}." for a, b in zip(INSULTS, INSULTS[1:])]
    scores = toxicity._scorer(model)()(clean + toxic)
    assert (scores[:len(clean)] < toxicity.CUT).all() and (scores[len(clean):] >= toxicity.CUT).all()


def test_a_beginning_needs_words_that_share_it(spark):
    stems = ["vilifying", "vilifier", "vilified", "vilifies"]
    rows = [(f"{prose(i, 30)} {stems[i // 4 % 4]}" if i % 4 == 0 else f"{prose(i, 30)} villa visit", int(i % 4 == 0)) for i in range(400)]
    found = toxicity.induce_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert set(stems) <= set(found) and {"vilif-", "vilifi-"} <= set(found)  # several telling words
    assert "vili-" not in found and "vilifyi-" not in found  # four short of eight words; one word alone
    assert toxicity.entry_order({"cl-": 2.0, "clown": 2.0, "clown-": 2.0, "a": 3.0}) == ["a", "clown", "clown-", "cl-"]


def test_capitals_are_counted_over_the_whole_text():
    voters = toxicity.Voters({"scum": 5.0})
    votes = lambda text: voters.look(text)[1][voters.lexical + 4]
    quiet, loud = toxicity.ABSTAIN, 1
    assert votes("By be in tothedouou and, oninly.") == quiet
    assert votes("".join("A" + "b" * 15 for _ in range(20))) == quiet  # every sixteenth character
    assert votes("".join("a" + "B" * 15 for _ in range(20))) == loud  # all but these
    assert votes("STOP SHOUTING AT ALL OF US NOW") == loud and votes("S 1 2 3 O 4 5 S") == quiet
    assert votes("") == quiet and votes("12 34 ! 56") == quiet and votes("READ " * 8 + "and so on " * 100) == quiet


def test_label_model_discounts_correlated_voters():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.2
    vote = lambda p: np.where(draw.random(4000) < np.where(truth, p, 0.05), 1, toxicity.ABSTAIN)
    a, b, c = vote(0.8), vote(0.7), vote(0.6)
    noise = np.where(draw.random(4000) < 0.3, 1, toxicity.ABSTAIN)
    votes = np.stack([a, b, c, noise, noise, noise], axis=1)
    patterns, inverse = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(inverse.reshape(-1)).astype(float)
    positive = np.bincount(inverse.reshape(-1), weights=truth.astype(float))
    model = toxicity.fit_label_model(patterns, counts, positive, 0.2)
    assert model.share[:3].min() > model.share[3:].max()  # copies of one voter share its weight
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_pairwise_scores_order_the_classes():
    draw = np.random.default_rng(1)
    good = (draw.random(600) < 0.8).astype(int)
    rows = draw.standard_normal((600, 4))
    rows[:, 1] += 6 * good
    model = quality.fit_pairs(rows, good, bad_share=0.2)
    assert _auc(model.raw(rows), good) > 0.99
    assert ((model.scores(rows) >= quality.CUT) == (good == 1)).mean() > 0.97


@needs_data
def test_pipeline_stages(spark, monkeypatch):
    small = "/root/testdata/sf0.01"
    docs = table(spark, small, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], small).cache())
    for before, after in zip(kept[:4], kept[1:5]):
        assert after.columns == docs.columns
        assert after.exceptAll(before).isEmpty() and 0 < after.count() < before.count()
    labels = table(spark, small, "labels")
    assert kept[2].join(labels, "doc_id").where("quality = 0").count() <= 2
    groups = similarity_groups(kept[3])
    assert groups.where("doc_id <> component_id").isEmpty()
    pieces = kept[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept[4].collect()}
    assert len({r["sequence_id"] for r in pieces}) <= lower_bound(np.array([r["length"] for r in pieces]), 4096) + 1


def _noisy(n, seed):
    draw = np.random.default_rng(seed)
    good = (draw.random(n) < 0.7).astype(int)
    rows = draw.standard_normal((n, 3))
    rows[:, 0] += 1.2 * good
    return rows, good


def test_every_pair_counts_in_the_weights():
    rows, good = _noisy(300, 5)
    model = quality.fit_pairs(rows, good, bad_share=0.3)
    z = quality._curves((rows - model.mean) / model.scale)
    diff = (z[good == 1][:, None] - z[good == 0][None]).reshape(-1, z.shape[1])
    wrong = 1 / (1 + np.exp(diff @ model.weights))
    slope = -(diff * wrong[:, None]).mean(axis=0) + 1e-3 * model.weights
    assert np.abs(slope).max() < 2e-3  # the loss over all pairs has its least value there
    share = np.where(good == 1, 0.7 / good.sum(), 0.3 / (good == 0).sum())
    below = share[model.raw(rows) < model.threshold].sum()
    assert 0.3 - 1e-9 <= below < 0.3 + share.max() + 1e-9


def test_quality_learns_from_every_labelled_row(spark):
    rows = [(i, f"{prose(i, 30)}" + " ###|||" * (i % 3 == 0), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    kept = [r["doc_id"] for r in docs.where(is_training_row(F.col("doc_id"))).collect()]
    texts = {i: (t, q) for i, t, q in rows}
    x = np.array([quality.features(texts[i][0]) for i in kept])
    want = quality.fit_pairs(x, np.array([texts[i][1] for i in kept]), sum(texts[i][1] == 0 for i in kept) / len(kept))
    got = quality.train(docs, labels)
    assert np.allclose(got.mean, want.mean) and np.allclose(got.scale, want.scale)  # of all rows, in any partitions
    assert np.allclose(got.weights, want.weights, atol=1e-4) and abs(got.threshold - want.threshold) < 1e-2
    assert quality.train(docs, labels.where("quality = 1")) is None


def _bytes_shuffled(df):
    """Bytes that the exchanges of the final plan wrote, before they are compressed."""
    df.collect()
    written, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange":
            written += node.metrics().apply("dataSize").value()
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return written


def test_quality_moves_no_texts_to_the_labels(spark, monkeypatch):
    rows = [(i, prose(i, 2000) + " ###|||" * (i % 3 == 0), int(i % 3 > 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2, "doc_id long, quality int")
    written, saved = [], quality.saved
    monkeypatch.setattr(quality, "saved", lambda df, name: written.append(df) or saved(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the labels are many
    try:
        model = quality.train(docs, labels)
        shuffled = sum(map(_bytes_shuffled, written))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < shuffled < 400 * len(rows) < sum(len(t) for _, t, _ in rows) / 20
    assert model is not None


def test_quality_features_of_odd_rows_and_keys(spark):
    # a NULL text counts as an empty one, a repeated row twice, a NULL key and a key without a label not at all
    rows = [("1", "one two"), ("1", "one two"), ("3", None), ("4", "no label"), (None, "no key"), (str(2**60 + 3), "Long key!")]
    marked = [("1", 1), ("3", 0), ("3", 1), ("3", 0), (str(2**60 + 3), 0), (None, 1), ("7", None), ("9", 1)]
    for kind in ("string", "long"):
        docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        labels = spark.createDataFrame(marked, "doc_id string, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
        share = {"1": 1, "3": 0, str(2**60 + 3): 0}
        want = sorted((quality.features(t or ""), share[k]) for k, t in rows if k in share)
        got = training_features(docs, labels, "quality", quality.features).collect()
        assert len(want) == 4 and sorted((list(r["x"]), r["label"]) for r in got) == want
