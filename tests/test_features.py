from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corollary.operators import features, relational, training
from corollary.session import folder_exists
from corollary.operators.features import FeatureModel
from corollary.session import ship_package
from corollary.sources import models


def random_model(m=12, dim=6, k=3, seed=0, **kwargs):
    rng = np.random.default_rng(seed)
    return FeatureModel(
        enc=rng.normal(size=(m, dim)), dec=rng.normal(size=(m, dim)), neuron_bias=rng.normal(size=m) * 0.1,
        input_bias=rng.normal(size=dim) * 0.1, k=k, **kwargs,
    )


def vectors_of(spark, x, partitions=3):
    rows = [(i, row.tolist()) for i, row in enumerate(np.asarray(x, dtype=np.float32))]
    return spark.createDataFrame(rows, "row_id long, embedding array<float>").repartition(partitions)


def dense_codes(x, model):
    x = np.asarray(x, dtype=np.float32).astype(float)
    pre = (x - model.input_bias) @ model.enc.T + model.neuron_bias
    out = np.zeros_like(pre)
    for i, row in enumerate(pre):
        for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[: model.k]:
            out[i, j] = max(row[j], 0.0)
    return out


def dense_of(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        assert r.activation > 0 and out[r.row_id, r.neuron_idx] == 0
        out[r.row_id, r.neuron_idx] = r.activation
    return out


@pytest.fixture(scope="module")
def data(spark):
    ship_package(spark)
    return np.random.default_rng(3).normal(size=(70, 6))


def test_activations_match_dense(spark, data):
    model = random_model()
    assert np.allclose(dense_of(features.activations(vectors_of(spark, data), model), 70, 12), dense_codes(data, model))


def test_activations_in_blocks_and_slices(spark, data, monkeypatch):
    model = random_model()
    vectors = vectors_of(spark, data)
    monkeypatch.setattr(features, "BLOCK_CELLS", 24)
    assert np.allclose(dense_of(features.activations(vectors, model), 70, 12), dense_codes(data, model))
    monkeypatch.setattr(features, "BROADCAST_BYTES", 8 * 6 * 5)
    assert np.allclose(dense_of(features.activations(vectors, model), 70, 12), dense_codes(data, model))


def test_ties_go_to_the_lower_neuron(spark):
    model = FeatureModel(enc=np.ones((5, 2)), dec=np.ones((5, 2)), neuron_bias=np.zeros(5), input_bias=np.zeros(2), k=2)
    got = features.activations(vectors_of(spark, [[1.0, 1.0]]), model)
    assert sorted(r.neuron_idx for r in got.collect()) == [0, 1]


def test_carried_columns_and_many_models(spark, data):
    a, b = random_model(), random_model(m=5, k=2, seed=1)
    vectors = vectors_of(spark, data).withColumn("y", F.col("row_id") * 2.0)
    acts = features.many_activations(vectors, [a, b], carry=("y",))
    assert acts.filter("y <> row_id * 2").count() == 0
    both = np.hstack([dense_codes(data, a), dense_codes(data, b)])
    assert np.allclose(dense_of(acts, 70, 17), both)
    neurons = {r.neuron_idx: (r.source_m, r.source_k) for r in features.neuron_table(spark, [a, b]).collect()}
    assert neurons == {i: (12, 3) if i < 12 else (5, 2) for i in range(17)}


def test_vectors_with_null_fail(spark):
    bad = spark.createDataFrame([(0, [1.0, None])], "row_id long, embedding array<float>")
    model = random_model(dim=2)
    with pytest.raises(Exception, match="NULL"):
        features.activations(bad, model).collect()


def test_errors_and_reconstruction(spark, data):
    model = random_model(prefixes=[4, 12])
    x = np.asarray(data, dtype=np.float32).astype(float)
    codes = dense_codes(data, model)
    recon = codes @ model.dec + model.input_bias
    vectors = vectors_of(spark, data)
    got = {r.row_id: r.recon for r in features.reconstruct(vectors, model).collect()}
    assert np.allclose([got[i] for i in range(70)], recon)
    baseline = ((x - x.mean(0)) ** 2).sum()
    want = [((codes[:, :e] @ model.dec[:e] + model.input_bias - x) ** 2).sum() / baseline for e in (4, 12)]
    errors = {r.prefix: r.normalized_mse for r in features.reconstruction_errors(vectors, model).collect()}
    assert np.allclose([errors[4], errors[12]], want)
    assert np.isclose(features.matryoshka_error(vectors, model).first()[0], np.mean(want))


@pytest.mark.parametrize("bound", [280, 100, 1])
def test_models_beyond_the_broadcast_bound(spark, data, monkeypatch, bound):
    model = random_model(prefixes=[4, 12])
    model.neuron_bias[:] -= 1.5  # some rows without an active feature
    vectors = vectors_of(spark, data)
    whole = {r.row_id: r.recon for r in features.reconstruct(vectors, model).collect()}
    errors = sorted(tuple(r) for r in features.reconstruction_errors(vectors, model).collect())
    nested = features.matryoshka_error(vectors, model).first()[0]
    monkeypatch.setattr(features, "BROADCAST_BYTES", bound)
    assert not features._fits(model) and len(set(features.activations(vectors, model).select("row_id").collect())) < 70
    got = {r.row_id: r.recon for r in features.reconstruct(vectors, model).collect()}
    assert got.keys() == whole.keys() and np.allclose([got[i] for i in whole], [whole[i] for i in whole], atol=1e-12)
    assert np.allclose(sorted(tuple(r) for r in features.reconstruction_errors(vectors, model).collect()), errors, atol=1e-12)
    assert np.isclose(features.matryoshka_error(vectors, model).first()[0], nested)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("n", [7, 8, 69])
def test_lower_median(spark, data, n, kind):
    data = np.where(data < -1, 0.0, data)  # ties
    vectors = vectors_of(spark, data[:n]).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    want = np.sort(np.asarray(data[:n], dtype=np.float32), axis=0)[(n - 1) // 2]
    for limit in (1000, 1):
        got = {r.dim: r.median for r in features.lower_medians(vectors, exact_rows=limit).collect()}
        assert [got[d] for d in range(6)] == want.tolist()


def test_prefixes_are_checked():
    for bad in ([4, 8], [8, 4, 12], [4, 4, 12]):
        with pytest.raises(ValueError):
            random_model(prefixes=bad)


# --- training ---------------------------------------------------------------------------


def full_loss(x, model, multi, aux, dead):
    """The loss written out densely for the whole batch."""
    pre = (x - model.input_bias) @ model.enc.T + model.neuron_bias

    def code(values, k):
        out = np.zeros_like(values)
        for i, row in enumerate(values):
            top = np.argsort(-row, kind="stable")[:k]
            out[i, top] = np.maximum(row[top], 0)
        return out

    def ratio(guess, target):
        return ((guess - target) ** 2).mean() / ((target - target.mean(0)) ** 2).mean()

    main = code(pre, model.k)
    ends = model.prefixes or [model.m]
    loss = np.mean([ratio(main[:, :e] @ model.dec[:e] + model.input_bias, x) for e in ends])
    loss += multi * ratio(code(pre, model.multi_k) @ model.dec + model.input_bias, x)
    residual = x - (main @ model.dec + model.input_bias)
    masked = np.zeros_like(pre)
    masked[:, dead] = pre[:, dead]
    return loss + aux * ratio(code(masked, model.aux_k) @ model.dec, residual), residual


def training_blocks(spark, data, cfg):
    blocks = training._cached_blocks(vectors_of(spark, data), "embedding", "row_id", cfg, 6, len(data))
    return blocks


def test_loss_and_gradient_match_finite_differences(spark, data):
    cfg = training.TrainConfig(prefixes=[4, 12], multi_k=6, multi_coef=0.3, aux_coef=0.2, partitions=4)
    model = random_model(prefixes=[4, 12], multi_k=6, aux_k=4, dead_threshold=5)
    idle = np.zeros(12, dtype=int)
    idle[[2, 7, 9]] = 100
    model.steps_since_active = idle
    x = np.asarray(data, dtype=np.float32).astype(float)
    blocks = training_blocks(spark, data, cfg)
    loss, grads = training._loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    dead = np.flatnonzero(model.dead())
    want, residual = full_loss(x, model, 0.3, 0.2, dead)
    assert np.isclose(loss, want)

    def fixed_residual_loss(m):
        value, _ = full_loss(x, m, 0.3, 0.0, dead)
        pre = (x - m.input_bias) @ m.enc.T + m.neuron_bias
        picked = np.zeros_like(pre)
        masked = np.zeros_like(pre)
        masked[:, dead] = pre[:, dead]
        for i, row in enumerate(masked):
            top = np.argsort(-row, kind="stable")[:4]
            picked[i, top] = np.maximum(row[top], 0)
        miss = ((picked @ m.dec - residual) ** 2).mean() / ((residual - residual.mean(0)) ** 2).mean()
        return value + 0.2 * miss

    rng = np.random.default_rng(0)
    for name, attribute in training._Adam.FIELDS.items():
        base = getattr(model, attribute)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in base.shape)
            values = []
            for sign in (1, -1):
                moved = base.copy()
                moved[at] += sign * 1e-6
                setattr(model, attribute, moved)
                values.append(fixed_residual_loss(model))
            setattr(model, attribute, base)
            assert np.isclose(grads[name][at], (values[0] - values[1]) / 2e-6, atol=2e-6), (name, at)


def test_tree_sum_equals_plain_sum(spark, data, monkeypatch):
    cfg = training.TrainConfig(partitions=9)
    model = random_model()
    blocks = training_blocks(spark, data, cfg)
    plain, g_plain = training._loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    monkeypatch.setattr(training, "FAN_IN", 2)
    monkeypatch.setattr(training, "COLLECT_BYTES", 1)
    tree, g_tree = training._loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    assert np.isclose(plain, tree)
    assert all(np.allclose(g_plain[k], g_tree[k]) for k in g_plain)


def test_single_precision_is_close(spark, data):
    cfg = training.TrainConfig(partitions=3, aux_coef=0.1, multi_coef=0.2)
    model = random_model(multi_k=5, dead_threshold=1)
    model.steps_since_active = np.arange(12)
    blocks = training_blocks(spark, data, cfg)
    exact, g_exact = training._loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    cfg.precision = "single"
    near, g_near = training._loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    assert np.isclose(exact, near, rtol=1e-5)
    assert all(np.allclose(g_exact[k], g_near[k], atol=1e-5) for k in g_exact)


def test_steps_cover_every_row_once(spark, data):
    cfg = training.TrainConfig(partitions=3)
    packed = training.pack(vectors_of(spark, data), "embedding", "row_id", 5, 0, 6).collect()
    assert {r.step for r in packed} == set(range(5))
    rows = np.concatenate([np.frombuffer(r.block, np.float32).reshape(-1, 6) for r in packed])
    want = np.asarray(data, dtype=np.float32)
    assert sorted(map(tuple, rows.tolist())) == sorted(map(tuple, want.tolist()))
    assert cfg.partitions == 3


def test_training_learns_and_ignores_partitioning(spark, data):
    vectors = vectors_of(spark, data)
    options = {"n_epochs": 6, "batch_size": 30, "learning_rate": 1e-2, "seed": 4}
    one = training.train_sae(vectors, 8, 2, partitions=1, **options)
    four = training.train_sae(vectors, 8, 2, partitions=4, **options)
    assert one.history[-1]["train_loss"] < one.history[0]["train_loss"]
    assert np.allclose(one.enc, four.enc) and np.allclose(one.input_bias, four.input_bias)
    assert np.allclose(np.linalg.norm(one.dec, axis=1), 1.0)
    assert features.activations(vectors, one).groupBy("row_id").count().filter("count > 2").count() == 0


def test_initial_weights(spark, data):
    model = training.initial_model(vectors_of(spark, data), 8, 2, training.TrainConfig(), "embedding")
    assert np.allclose(model.enc, model.dec) and np.allclose(np.linalg.norm(model.dec, axis=1), 1)
    assert np.allclose(model.input_bias, np.sort(np.asarray(data, np.float32), axis=0)[34])
    assert not model.neuron_bias.any()


def test_dead_features_and_early_stop(spark, data):
    vectors = vectors_of(spark, data)
    model = training.train_sae(
        vectors, 30, 1, dead_neuron_threshold_steps=0, n_epochs=3, learning_rate=1e-3, aux_coef=1.0
    )
    assert 0 < model.history[-1]["dead_ratio"] < 1
    stopped = training.train_sae(vectors, 8, 2, val_vectors=vectors, n_epochs=40, learning_rate=3.0, patience=2)
    losses = [h["val_loss"] for h in stopped.history]
    best = int(np.argmin(losses))
    assert len(losses) == best + 3 < 40


def test_train_or_load(spark, data, tmp_path):
    vectors = vectors_of(spark, data)
    folder = str(tmp_path / "models")
    first = training.train_sae(vectors, 4, 1, prefixes=[2, 4], n_epochs=1, checkpoint_dir=folder)
    path = f"{folder}/{models.folder_name(first.dim, 4, 1, [2, 4], first.fingerprint)}"
    loaded = models.load_model(spark, path)
    assert loaded.prefixes == [2, 4] and loaded.k == 1 and np.allclose(loaded.enc, first.enc)
    again = training.train_sae(vectors, 4, 1, prefixes=[2, 4], n_epochs=5, checkpoint_dir=folder)
    assert np.allclose(again.dec, first.dec) and not again.history
    # other vectors have a folder of their own, and a model isn't taken for theirs
    other = vectors_of(spark, data + 1)
    fresh = training.train_sae(other, 4, 1, prefixes=[2, 4], n_epochs=1, checkpoint_dir=folder)
    assert fresh.history and not np.allclose(fresh.input_bias, first.input_bias)
    with pytest.raises(ValueError, match="other vectors"):
        models.load_model(spark, path, fingerprint=fresh.fingerprint)
    anew = training.train_sae(vectors, 4, 1, prefixes=[2, 4], n_epochs=1, checkpoint_dir=folder, overwrite_checkpoint=True)
    assert anew.history


def test_steps_have_512_rows_at_every_size(spark):
    """More than 40,000 rows: about 80 steps, drawn anew each epoch, none empty after a split with the same seed."""
    n = 45_000
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    train, _ = relational.train_validation_split(rows, 0.1, 7)
    steps = -(-train.count() // training.STEP_ROWS)
    epochs = []
    for epoch in (0, 1):
        packed = training.pack(train, "embedding", "row_id", steps, 7, 2, epoch, partitions=6).collect()
        by_step = {s: np.concatenate([np.frombuffer(r.block, np.float32).reshape(-1, 2) for r in packed if r.step == s]) for s in range(steps)}
        sizes = np.array([len(x) for x in by_step.values()])
        assert sizes.sum() == train.count() and abs(sizes - training.STEP_ROWS).max() < 6 * np.sqrt(training.STEP_ROWS)
        epochs.append(by_step)
    assert set(epochs[0][0][:, 0]) != set(epochs[1][0][:, 0])


def stepwise(vectors, m, k, cfg, n_rows, steps):
    """Training with one job per step, as a plain loop over the packed blocks."""
    model = training.initial_model(vectors, m, k, cfg, "embedding")
    adam = training._Adam(cfg)
    for epoch in range(cfg.n_epochs):
        packed = training.pack(vectors, "embedding", "row_id", steps, cfg.seed, model.dim, epoch, 2).cache()
        losses = []
        for step in range(steps):
            loss, grads = training._loss_and_gradient(training._Blocks(packed.filter(F.col("step") == step), 1), model, cfg, True, True)
            if grads is not None:
                adam.update(model, grads)
                losses.append(loss)
        training._epoch_ends(model, epoch, losses, None, cfg)
        packed.unpersist()
    return model


@pytest.mark.parametrize("chunk_steps", [64, 3])
def test_chunks_of_steps_equal_single_steps(spark, data, monkeypatch, chunk_steps):
    monkeypatch.setattr(training, "CHUNK_STEPS", chunk_steps)
    vectors = vectors_of(spark, data)
    options = {
        "n_epochs": 2, "batch_size": 10, "learning_rate": 1e-2, "seed": 4, "prefixes": [4, 12], "multi_k": 5, "multi_coef": 0.2, "aux_k": 3,
        "dead_neuron_threshold_steps": 2,
    }
    want = stepwise(vectors, 12, 2, training.TrainConfig(**options), len(data), 7)
    got = training.train_sae(vectors, 12, 2, **options)
    for name in training.FITTED:
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=0, atol=1e-9), name
    assert [h["dead_ratio"] for h in got.history] == [h["dead_ratio"] for h in want.history]
    assert np.allclose([h["train_loss"] for h in got.history], [h["train_loss"] for h in want.history], rtol=0, atol=1e-9)


def test_one_job_for_many_steps_and_files(spark, monkeypatch):
    """64 steps of an epoch take one job, and a job opens the files of its own chunk only."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.array((F.col("id") % 97).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    cfg = training.TrainConfig(n_epochs=1, batch_size=100)
    with training._epoch(rows, "embedding", "row_id", 200, cfg, 2, n, 0) as epoch:
        assert (epoch.chunks, epoch.tasks) == (4, 1)
        for chunk in range(4):
            frame = epoch.read(chunk)
            assert all(f"/chunk={chunk}/" in f for f in frame.inputFiles())
            assert {r["step"] // 64 for r in frame.select("step").collect()} == {chunk}
        model = training.initial_model(rows, 4, 1, cfg, "embedding")
        spark.sparkContext.setJobGroup("chunk", "")
        assert len(training._chain(epoch.read(1), model, training._Adam(cfg), cfg)) == 64
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chunk")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) == 1
        folder = epoch.read(0).inputFiles()[0].split("/chunk=")[0]
    assert not folder_exists(spark, folder)


def test_large_steps_have_a_folder_each(spark, data, monkeypatch):
    monkeypatch.setattr(training, "TASK_ROWS", 5)
    vectors = vectors_of(spark, data)
    options = {"n_epochs": 2, "batch_size": 30, "learning_rate": 1e-2, "seed": 4}
    many = training.train_sae(vectors, 8, 2, partitions=4, **options)
    monkeypatch.setattr(training, "TASK_ROWS", 512)
    one = training.train_sae(vectors, 8, 2, **options)
    assert np.allclose(one.enc, many.enc, atol=1e-9) and np.allclose(one.dec, many.dec, atol=1e-9)


def test_validation_by_batches(spark, data):
    vectors = vectors_of(spark, data)
    options = {"n_epochs": 1, "batch_size": 20, "learning_rate": 0.0, "seed": 2, "aux_coef": 0.0}
    model = training.train_sae(vectors, 8, 2, val_vectors=vectors, batch_validation=True, **options)
    packed = training.pack(vectors, "embedding", "row_id", 4, 2, 6, -1).collect()
    losses = []
    for step in range(4):
        x = np.concatenate([np.frombuffer(r.block, np.float32).reshape(-1, 6) for r in packed if r.step == step]).astype(float)
        sums = training.main_sums(x, model, 0.0, False)
        losses.append(sums["sse"][0] / ((x - x.mean(0)) ** 2).sum())
    assert np.isclose(model.history[0]["val_loss"], np.mean(losses), rtol=1e-12)
    whole = training.train_sae(vectors, 8, 2, val_vectors=vectors, **options)
    assert not np.isclose(whole.history[0]["val_loss"], model.history[0]["val_loss"], rtol=1e-6)


def test_partitions_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(training, "PARTITION_BYTES", 4096)
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.array_repeat(F.col("id").cast("float"), 8).alias("embedding")).coalesce(2)
    parts, spread = training._partitions(rows, training.TrainConfig(), 8, 4000, 8)
    assert (parts, spread) == (-(-4000 * 8 * 4 // 4096), 1)
    packed = training.pack(rows, "embedding", "row_id", 8, 0, 8, 0, parts, spread)
    per = packed.select("step", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["p"] for r in per}) > 2 and len(per) == 8  # each step's rows are in one partition


def test_light_steps_of_many_rows_share_a_job(spark):
    """4,096 rows of 8 dimensions are not worth a job a step, so that jobs don't grow in number with the steps."""
    n = 20_480
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.array(*((F.col("id") % (7 + d)).cast("float") for d in range(8))).alias("embedding"))
    cfg = training.TrainConfig(n_epochs=1, batch_size=4096, learning_rate=1e-2)
    with training._epoch(rows, "embedding", "row_id", 5, cfg, 8, n, 0, 8) as epoch:
        assert (epoch.chunks, epoch.tasks) == (1, 1)
    with training._epoch(rows, "embedding", "row_id", 5, cfg, 8, n, 0, 1 << 20) as epoch:
        assert epoch.tasks > 1  # a large model's steps are shared by tasks
    options = {"n_epochs": 2, "batch_size": 4096, "learning_rate": 1e-2, "seed": 4}
    together, apart = training.train_sae(rows, 8, 2, **options), training.train_sae(rows, 8, 2, partitions=8, **options)
    assert np.allclose(together.enc, apart.enc, atol=1e-9) and np.allclose(together.dec, apart.dec, atol=1e-9)
