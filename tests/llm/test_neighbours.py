from __future__ import annotations

import numpy as np
import pytest

from corollary.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, key long, v array<float>, cell int, best string"
IS_QUERY = "vec_id % 20 = 0"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, None, 2, "b") for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(x, ids, k=20):
    x, ids, out = np.asarray(x, np.float32).astype(np.float64), np.asarray(ids), {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = neighbours.inner(np.repeat(x[q : q + 1], len(x), axis=0), x)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(order)]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def clustered(n=900, dim=12):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, dim)) * 3
    return (centers[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.2).astype(np.float32)


@pytest.mark.parametrize("sizes", [{}, {"block_candidates": 60, "block_queries": 7, "floor_sample": 100}, {"block_candidates": 50, "cells": 3, "block_queries": 5, "floor_sample": 5}])
def test_against_brute_force(spark, sizes):
    x = clustered()
    assert as_dict(neighbours.nearest(frame(spark, x), IS_QUERY, **sizes)) == brute(x, range(len(x)))


def test_a_third_of_the_rows_with_one_vector(spark):
    x = clustered(600)
    x[::3] = x[0]
    x[1:20:2] = x[0] + 1e-6  # copies that int8 can't tell apart
    assert as_dict(neighbours.nearest(frame(spark, x), IS_QUERY, block_candidates=100, block_queries=10, floor_sample=64)) == brute(x, range(600))


def test_odd_vectors(spark):
    x = [[1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 1], [2, 2], [2, 2], [3], [], [0, 0], [9, 9], [-1, 0], [5, 5], [1, 1], [1, 3], None]
    ids = [0, 1, 2, 3, 4, 5, 5, 6, 7, 8, None, 9, 40, 0, 10, 60]
    got = as_dict(neighbours.nearest(frame(spark, x, ids), IS_QUERY))
    # id 0 asks with its least vector, (1, 1); all of its rows are candidates of others.
    assert [r[1:] for r in got[0]] == [(40, 10.0), (5, 4.0), (10, 4.0), (6, 3.0), (9, -1.0)]
    assert [r[1:] for r in got[40]] == [(5, 20.0), (10, 20.0), (0, 15.0), (6, 15.0), (0, 10.0), (9, -5.0)] and set(got) == {0, 40}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), IS_QUERY).collect() == []
    assert neighbours.nearest(frame(spark, [[1.0]], [20]), IS_QUERY).collect() == []


def test_sizes_from_tiny_to_huge(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(200, 5)) * 10.0 ** rng.integers(-30, 30, (200, 1))).astype(np.float32)
    assert as_dict(neighbours.nearest(frame(spark, x), IS_QUERY, block_candidates=40, floor_sample=50)) == brute(x, range(200))
    big = spark.createDataFrame([(i, [1e300 * (i + 1), -1e300]) for i in range(30)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(big, IS_QUERY).count() == 40


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    a, b = (neighbours.Quantized(rng.normal(size=(n, 1500))) for n in (30, 40))
    low, high = a.bounds(b)
    exact = a.full @ b.full.T
    assert (low <= exact).all() and (exact <= high).all()
    x = neighbours.Quantized(rng.normal(size=(4000, 64)))
    heaps, scored = neighbours.search_tile(x.rows(slice(0, 50)), np.full(50, -np.inf), x, [[i] for i in range(4000)], 21)
    assert scored < 0.05 * 50 * 4000 and all(len(h) == 21 for h in heaps)
