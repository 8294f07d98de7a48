from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corollary.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def frame(spark, n=230, dim=10, equal=0):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:equal] = x[0]
    return spark.createDataFrame([(i, [float(v) for v in row], 0.1, 1) for i, row in enumerate(x)], SCHEMA), np.floor(64.0 * x.astype(np.float64)).astype(np.int64)


@pytest.mark.parametrize("equal", [0, 90])
def test_against_brute_force(spark, equal):
    vectors, q = frame(spark, equal=equal)
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, block_candidates=50, block_queries=5).toPandas()
    for i in range(0, len(q), 20):
        score = q @ q[i]
        best = [j for j in np.lexsort((np.arange(len(q)), -score)) if j != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine.vec_id) == best and list(mine.score) == list(score[best]) and list(mine["rank"]) == list(range(1, 21))


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], None, None), (1, None, None, None), (2, [1.0, None], None, None), (3, [float("nan"), 1.0], None, None), (4, [float("inf"), 1.0], None, None),
        (5, [2.0, 2.0], None, None), (5, [2.0, 2.0], None, None), (6, [3.0], None, None), (7, [], None, None), (None, [9.0, 9.0], None, None), (20, None, None, None),
    ]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    s = 64 * 64
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 5, 6 * s), (0, 5, 6 * s), (0, 6, 3 * s), (0, 7, 0)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components(spark, kind):
    """Scores that fit although an estimate doesn't, scores that don't, and both in one table."""
    one = [(i, [3e7 if d == i % 4 else 0.0 for d in range(4)]) for i in range(3)] + [(20, [3e7, 1.0, 0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(one, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got}[20, 0] == (64 * 30_000_000) ** 2
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 6)) * 10.0 ** rng.integers(0, 30 if kind == "float" else 150, (60, 1))).astype(np.float32 if kind == "float" else np.float64)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = topk.top_k(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 20 == 0, block_candidates=25).collect()
    q = [[int(np.floor(64.0 * float(v))) for v in r] for r in x]
    for i in range(0, 60, 20):
        exact = {j: sum(a * b for a, b in zip(q[i], q[j], strict=True)) for j in range(60) if j != i}
        exact = {j: max(-topk.LARGEST, min(topk.LARGEST, s)) for j, s in exact.items()}
        best = sorted(exact, key=lambda j: (-exact[j], j))[:20]
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in mine] == [(j, exact[j]) for j in best]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-90, 90, (40, 13)), rng.integers(-90, 90, (30, 13))
    for n in (1, 2, 5, 13, 50):
        assert (topk.segment_statistics(a.astype(float), n) @ topk.segment_statistics(b.astype(float), n).T >= a @ b.T - 1e-6).all()
