from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corollary.functions.text import text_key
from corollary.operators import ranking, relational


def ids(df, column="row_id"):
    return sorted(r[0] for r in df.select(column).collect())


def position(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_splits_a_hot_key(spark, how):
    """A key with half of the rows is split among tasks, and nothing is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    left = spark.range(0, 40_000, 1, 8).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("k151", 2), (None, 3)], "k string, v int")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = relational.lookup_join(left, right, "k", how)
        assert joined.agg(F.count("*"), F.sum("v")).first()[:] == ((40_000, 20_002) if how == "left" else (20_001, 20_002))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_id long, k string")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    assert ids(relational.lookup_join(left, right, "k")) == [1, 2, 3]


def test_uncached_texts_and_tasks(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (" ",), (None,)], "text string")
    store = texts.filter("text = 'b'").select(text_key(F.col("text")).alias("text_key"))
    assert [r.text for r in relational.uncached_texts(texts, store).collect()] == ["a"]
    tasks = spark.createDataFrame([("c", "1"), ("c", "1"), ("d", "1")], "concept string, text_key string")
    known = spark.createDataFrame([("c", "1", 0)], "concept string, text_key string, value int")
    hits, todo = relational.split_cached_tasks(tasks, known)
    assert [tuple(r) for r in hits.collect()] == [("c", "1", 0)]
    assert [tuple(r) for r in todo.collect()] == [("d", "1")]


def test_missing_vector_is_an_error(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    store = texts.limit(1).select(text_key(F.col("text")).alias("text_key"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(PySparkException):
        relational.lookup_vectors(texts, store).collect()
    assert relational.lookup_vectors(texts, store, check=False).filter("embedding IS NULL").count() == 1


def test_every_concept_inline_and_in_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "row_id long, text string")
    concepts = spark.createDataFrame([(f"c{i}",) for i in range(11)] + [("c0",)], "concept string")
    want = sorted((i, f"c{j}") for i in range(7) for j in range(11))

    def pairs():
        return sorted((r.row_id, r.concept) for r in relational.with_every_concept(texts, concepts).collect())

    assert pairs() == want
    monkeypatch.setattr(relational, "INLINE_ITEMS", 3)
    assert pairs() == want
    monkeypatch.setattr(relational, "BROADCAST_CHARS", 0)
    assert pairs() == want
    assert relational.with_every_concept(texts, []).count() == 0


def test_wide_values_and_vectors(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "row_id long, text_key string")
    answers = spark.createDataFrame(
        [("x", "a", 1), ("x", "b", 0), ("y", "a", 0), ("y", "b", None)], "text_key string, concept string, value int"
    )
    got = {r.row_id: (r.c0, r.c1) for r in relational.annotation_vectors(rows, answers, ["a", "b"]).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (0, None), 4: (None, None)}


def test_pair_differences(spark):
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 1)], "pair_id long, row_a long, row_b long")
    acts = spark.createDataFrame(
        [(1, 0, 2.0), (2, 0, 2.0), (1, 1, 1.0), (3, 2, 4.0)], "row_id long, neuron_idx int, activation double"
    )
    got = sorted(map(tuple, relational.pair_activation_difference(pairs, acts).collect()))
    assert got == [(0, 1, 1.0), (1, 0, -2.0), (1, 1, -1.0), (1, 2, 4.0)]
    ann = spark.createDataFrame([(1, "c", 1), (2, "c", 0), (3, "c", None)], "row_id long, concept string, value int")
    got = sorted(map(tuple, relational.pair_annotation_difference(pairs, ann).collect()))
    assert got == [(0, "c", 1), (1, "c", None)]


def test_split_and_sample_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    order = sorted(range(1000), key=lambda i: (position(f"split:9:{i}"), i))
    sampled = sorted(range(1000), key=lambda i: (position(f"sample:9:{i}"), i))
    train, held = relational.train_validation_split(df, 0.1, 9)
    assert ids(held) == sorted(order[:100]) and ids(train) == sorted(order[100:])
    assert ids(ranking.hash_sample(df, 37, 9)) == sorted(sampled[:37])
    assert ranking.hash_sample(df, 5000, 9).count() == 1000
    none, everything = relational.train_validation_split(df, 1.0, 9)
    assert none.count() == 0 and everything.count() == 1000


def test_nth_position_narrows(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), ranking.hash_position("test", 1, F.col("id")).alias("p"))
    order = sorted((position(f"test:1:{i}"), i) for i in range(3000))
    for n in (1, 17, 2999, 3000):
        assert ranking.nth_position(df, "p", "row_id", n, leaf=1) == order[n - 1]
    assert ranking.nth_position(df, "p", "row_id", 3001) is None
    same = spark.range(50).select(F.col("id").alias("row_id"), F.lit(77).cast("long").alias("p"))
    assert ranking.nth_position(same, "p", "row_id", 20, leaf=1) == (77, 19)


def test_top_n_with_salt(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("int").alias("k"), F.col("id"), F.md5(F.col("id").cast("string")).alias("v"))
    order = [F.asc("v"), F.asc("id")]
    small = ranking.top_n_per_group(df, ["k"], order, 5).filter("k = 1")
    large = ranking.top_n_per_group(df, ["k"], order, 1500, salt_on="id").filter("k = 1")
    want = sorted(range(1, 5000, 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [r.id for r in small.orderBy("rank").collect()] == want[:5]
    assert [r.id for r in large.orderBy("rank").collect()] == want[:1500]


@pytest.mark.parametrize("leaf", [10_000, 30, 1])
def test_running_totals(spark, leaf):
    """Values of all magnitudes and signs, without levels, with two and with as many as there are."""
    rng = random.Random(2)
    values = {rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(500)}
    values |= {0.0, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, -5e-324, 5e-324} | {rng.random() for _ in range(300)}
    rows = [(v, rng.randrange(1, 9), rng.random()) for v in values]
    got = ranking.running_totals(spark.createDataFrame(rows, "v double, w long, x double").repartition(5), "v", ["w", "x"], leaf).collect()
    assert len(got) == len(rows)
    above, above_x = 0, 0.0
    for r in sorted(got, key=lambda r: -r.v):
        assert (r.above_w, round(r.above_x, 6)) == (above, round(above_x, 6))
        above, above_x = above + r.w, above_x + r.x
    odd = spark.createDataFrame([(None, 1), (float("nan"), 2), (3.0, 4)], "v double, w long")
    assert sorted((str(r.v), r.above_w) for r in ranking.running_totals(odd, "v", ["w"], leaf).collect()) == [("3.0", 2), ("None", 6), ("nan", 0)]


@pytest.mark.parametrize("leaf", [1_000_000, 10])
def test_percentiles_match_numpy(spark, leaf, monkeypatch):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": np.repeat([0, 1, 2], [400, 90, 1]).astype("int32"), "x": rng.exponential(size=491)})
    frame.loc[:150, "x"] = 0.25  # a heavy tie inside the first group
    original = ranking.order_statistics
    monkeypatch.setattr(ranking, "order_statistics", lambda *a: original(*a, leaf=leaf))
    got = ranking.grouped_percentiles(spark.createDataFrame(frame), "g", "x", {"lo": 5, "mid": 37.5, "hi": 100}).collect()
    assert len(got) == 3
    for r in got:
        x = frame[frame.g == r.g].x
        assert np.allclose([r.lo, r.mid, r.hi], np.percentile(x, [5, 37.5, 100]))


def test_task_type(spark):
    binary = spark.createDataFrame([(0.0,), (1.0,)], "y double")
    assert relational.is_binary(binary).first()[0] is True
    assert relational.is_binary(binary.union(spark.createDataFrame([(0.5,)], "y double"))).first()[0] is False
