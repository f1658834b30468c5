"""The pipeline's stages on small tables: odd rows, repeated rows, NULL keys, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dimweave.llm.common import saved
from helpers import frame, odd_rows, prose

INSULT = "you pathetic moron, disgusting trash, get lost you clown!"


def _write(spark, base, rows, labels):
    docs = frame(spark, rows)
    for name in ("gone_key", "row", "score", "class", "probability", "selected", "mix_topic", "length"):
        docs = docs.withColumn(name, F.lit("own"))
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return docs


def _rows():
    good = [(100 + i, prose(i, 80 + i % 50) + ".", "en" if i % 3 else "de", f"s{i % 2}", i) for i in range(160)]
    toxic = [(400 + i, f"{prose(900 + i, 30)} {INSULT} {prose(950 + i, 20)}", "en", "s1", i) for i in range(40)]
    bad = [(600 + i, "buy now!!! CLICK $$$ " * (3 + i % 5) + "| x | 1 | | |", "en", "s0", i) for i in range(40)]
    copies = [(800 + i, good[3][1], "en", "s0", 1) for i in range(4)] + [(800, good[4][1], "en", "s0", 1)]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 1, 1) for r in toxic] + [(r[0], 0, 0) for r in bad] + [(100, 1, 0), (None, 1, None), (5, None, 1)]
    return good + toxic + bad + copies + odd_rows() + odd_rows(), labels


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows, labels = _rows()
    docs = _write(spark, str(tmp_path), rows, labels)
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = saved(stage(spark, now, str(tmp_path)), f"test-{name}")
        assert now.columns == docs.columns, name
        assert now.where("gone_key <> 'own' OR class <> 'own'").isEmpty(), name
        seen[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
    good = {r[0] for r in rows[:160]}
    assert not {400 + i for i in range(40)} & set(seen["toxicity"])
    assert len(good & set(seen["toxicity"])) >= 158
    assert len(good & set(seen["quality"])) >= 150 and len({600 + i for i in range(40)} & set(seen["quality"])) <= 4
    kept = seen["near_duplicates"]
    assert 103 in kept and not {800, 801, 802, 803} & set(kept) and len([k for k in kept if k is not None]) == len(set(kept) - {None})
    assert set(seen["mixing"]) <= set(kept) and 0 < len(seen["mixing"]) < len(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    got = pieces.collect()
    assert {r["doc_id"] for r in got} == set(seen["mixing"])
    ends = {}
    for r in got:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, tmp_path, labelled):
    rows, labels = _rows()
    _write(spark, str(tmp_path), [], labels if labelled else [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_labels_nothing_is_rejected(spark, tmp_path):
    rows, _ = _rows()
    _write(spark, str(tmp_path), rows[:40], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).count() == 40, name
