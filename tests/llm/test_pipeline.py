"""The classifier on held-out labels, and the pipeline against the stages' own rules."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from palimpsest.llm import classifier, decontaminate
from palimpsest.llm.common import read

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = classifier.classify(read(spark, ROOT, "documents"), read(spark, ROOT, "labels"))
    rows = found.join(read(spark, ROOT, "labels"), "doc_id").where("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (20, 0), (None, 0), (21, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        rows = classifier.classify(docs, given).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert all(r.predicted == 1 for r in classifier.classify(docs, labels.limit(0)).collect())
    assert classifier.classify(none, labels).count() == 0
    assert classifier.accept(docs, labels.limit(0)).schema == docs.schema


def test_scores_and_weights_by_plain_code(spark):
    """Weights are where the Bradley-Terry loss of the drawn pairs is flat; each row has the score that plain code gives its whole text."""
    import math

    small = ROOT.replace("0.01", "0.001")
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    model = classifier.learn(docs, labels)
    good, bad = ({r.doc_id for r in labels.collect() if r.quality == q} for q in (1, 0))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    import zlib

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    rows = [d for d in texts if d in good | bad and not held(d)]
    x = np.array([classifier.features(texts[d]) for d in rows])
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3), -8, 8)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    up, down = z[[d in good for d in rows]], z[[d in bad for d in rows]]
    raw_up, raw_down = up @ model.weights, down @ model.weights
    # Over all pairs, not only those drawn, the gradient is nearly the ridge's.
    p = 1 / (1 + np.exp(raw_up[:, None] - raw_down[None]))
    slope = (p.sum(axis=1) @ up - p.sum(axis=0) @ down) / p.size - 1e-2 * model.weights
    assert np.abs(slope).max() < 0.01
    wrong = lambda cut: (raw_up < cut).sum() + (raw_down >= cut).sum()
    assert wrong(model.cutoff) == min(wrong(c) for c in [*raw_up, *raw_down, math.inf])
    for r in classifier.classify(docs, labels).collect():
        v = np.clip((np.array(classifier.features(texts[r.doc_id])) - model.mean) / model.scale, -8, 8) @ model.weights - model.cutoff
        want = 1 / (1 + math.exp(-v) * 7 / 3)
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id)


def test_pipeline(spark, tmp_path):
    documents = read(spark, ROOT, "documents").where("doc_id < 300")
    at = str(tmp_path)
    documents.write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        read(spark, ROOT, t).write.parquet(f"{at}/{t}.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, at).write.parquet(f"{at}/{name.split()[0]}")
        docs = spark.read.parquet(f"{at}/{name.split()[0]}")
        assert docs.columns == documents.columns
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    quality, near, clean, mixed = kept
    assert set(near) <= set(quality) and len(near) == len(set(near)) and set(clean) <= set(near) and set(mixed) <= set(clean) and max(map(mixed.count, mixed)) <= 2
    left = decontaminate.report(spark.read.parquet(f"{at}/benchmark"), read(spark, ROOT, "benchmark"))
    assert left.where("n_hit > 0").count() == 0
    out = corpus_pipeline.run(spark, at)
    assert sorted(r.doc_id for r in out.collect()) == sorted(mixed)
