from __future__ import annotations

import random
import zlib

import numpy as np

from corollary.llm import classifier


def corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = [f"w{rng.randrange(200)}" for _ in range(60)]
        rows.append((i, " ".join(words if good else [w + rng.choice(["%%%", "###"]) for w in words])))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = classifier.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample_rows=200).toPandas()
    got["label"] = got.doc_id.map(dict(labels))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.predicted == got.label)[got.held_out].mean() > 0.98


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (classifier.score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).toPandas().sort_values("doc_id") for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_odd_rows(odd, empty, labels):
    got = classifier.score_quality(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert classifier.score_quality(empty, labels).count() == 0
    assert (classifier.score_quality(odd, labels.limit(0)).toPandas().score.round(9) == 0.5).all()


def test_dual_descent_reaches_the_minimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    ratios = rng.normal(size=30)

    def loss(w, b):
        m = classifier.margins(rows, w, b, ratios)
        return (w @ w + b * b) / 2 + np.maximum(0, 1 - y * m).sum()

    w, b = classifier.fit_hinge(rows, y, ratios, passes=500)
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(size=30) * 0.02, b + rng.normal() * 0.02) >= best - 1e-2
