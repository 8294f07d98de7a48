from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corollary.operators import ranking, sampling, selection
from corollary.operators.ranking import HASH_RANGE
from tests.test_relational import position


def tables(spark, dense, y):
    n, m = dense.shape
    acts = [(i, j, float(dense[i, j])) for i in range(n) for j in range(m) if dense[i, j] != 0]
    return (
        spark.createDataFrame(acts, "row_id long, neuron_idx int, activation double"),
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, y double"),
        spark.range(m).select(F.col("id").cast("int").alias("neuron_idx")),
    )


def scores_of(df):
    return {r.neuron_idx: r.score for r in df.collect()}


@pytest.fixture(scope="module")
def sparse_data():
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((90, 7)) < 0.3, rng.exponential(size=(90, 7)), 0.0)
    dense[:, 5] = 0.0  # dead
    dense[:, 6] = np.where(np.arange(90) < 4, 1.0, 0.0)  # few positives, all tied
    return dense, dense[:, 0] - 0.5 * dense[:, 1] + rng.normal(size=90) * 0.3


def test_correlation(spark, sparse_data):
    dense, y = sparse_data
    acts, targets, neurons = tables(spark, dense, y)
    got = scores_of(selection.correlation_scores(acts, targets, neurons))
    for j in range(7):
        if j == 5:
            assert got[j] is None
        else:
            assert np.isclose(got[j], np.corrcoef(dense[:, j], y)[0, 1])
    best = selection.select_correlation(acts, targets, 7, neurons=neurons).orderBy("rank").collect()
    assert best[-1].neuron_idx == 5 and best[0].neuron_idx == 0


def test_correlation_with_a_large_mean(spark, sparse_data):
    dense, y = sparse_data
    acts, targets, _ = tables(spark, dense, y + 1e8)
    got = scores_of(selection.correlation_scores(acts, targets))
    assert all(np.isclose(got[j], np.corrcoef(dense[:, j], y)[0, 1], atol=1e-7) for j in got)


def test_constant_target_scores_null(spark, sparse_data):
    acts, targets, neurons = tables(spark, sparse_data[0], np.ones(90))
    assert set(scores_of(selection.correlation_scores(acts, targets, neurons)).values()) == {None}


def separation(dense, y, n_top):
    out = {}
    for j in range(dense.shape[1]):
        order = sorted(range(len(y)), key=lambda i: (-dense[i, j], i))[:n_top]
        zero = dense[:, j] == 0
        out[j] = y[order].mean() - y[zero].mean() if zero.any() else None
    return out


@pytest.mark.parametrize("n_top", [3, 40, 90, 200])
@pytest.mark.parametrize("pad_rows, widest", [(10_000, 10_000_000), (0, 10_000_000), (0, 20)])
def test_separation_with_padding_and_negatives(spark, sparse_data, monkeypatch, n_top, pad_rows, widest):
    dense, y = sparse_data
    signed = dense.copy()
    signed[::3, 2] = -np.abs(signed[::3, 3]) - 0.1  # negatives on a third of the rows
    signed[:, 4] = np.where(signed[:, 4] == 0, -0.5, signed[:, 4])  # no zero rows at all
    acts, targets, neurons = tables(spark, signed, y)
    monkeypatch.setattr(selection, "PAD_ROWS", pad_rows)
    monkeypatch.setattr(selection, "WIDEST", widest)
    got = scores_of(selection.separation_scores(acts, targets, neurons, n_top_activating=n_top))
    for j, want in separation(signed, y, n_top).items():
        assert (got[j] is None) if want is None else np.isclose(got[j], want), j


def test_lasso_satisfies_its_optimality_conditions(spark, sparse_data):
    dense, y = sparse_data
    acts, targets, neurons = tables(spark, dense, y)
    vectors = selection.feature_vectors(acts, targets, 7)
    assert vectors.count() == 90
    sd = np.where(dense.std(0) > 0, dense.std(0), 1.0)
    x = (dense - dense.mean(0)) / sd
    for alpha in (0.02, 0.2):
        w = np.array(selection.fit_l1(vectors, alpha, 90, classification=False).coefficients)
        pull = x.T @ (y - y.mean() - x @ w) / 90
        assert np.all(np.abs(pull) <= alpha + 1e-5)
        on = np.abs(w) > selection.NONZERO
        assert np.allclose(pull[on], alpha * np.sign(w[on]), atol=1e-5)
    z = (y > np.median(y)).astype(float)
    vectors = selection.feature_vectors(acts, tables(spark, dense, z)[1], 7)
    fit = selection.fit_l1(vectors, 6.0, 90, classification=True)
    w = np.array(fit.coefficients)
    scaled = dense / sd
    intercepts = np.linspace(-5, 5, 200_001)
    best = min(intercepts[::100], key=lambda b: np.logaddexp(0, scaled @ w + b).sum() - z @ (scaled @ w + b))
    near = np.linspace(best - 0.1, best + 0.1, 2001)
    best = min(near, key=lambda b: np.logaddexp(0, scaled @ w + b).sum() - z @ (scaled @ w + b))
    p = 1 / (1 + np.exp(-(scaled @ w + best)))
    pull = scaled.T @ (z - p) - (z - p).sum() * dense.mean(0) / sd
    on = np.abs(w) > 1e-6
    assert np.all(np.abs(pull) <= 6.0 + 0.05) and np.allclose(np.abs(pull[on]), 6.0, atol=0.05)


def test_linear_fits_share_one_matrix_of_sums(spark, sparse_data, monkeypatch):
    dense, y = sparse_data
    acts, targets, neurons = tables(spark, dense, y + 1e6)  # a large mean costs no precision
    calls, plain = [], selection.linear_sums
    monkeypatch.setattr(selection, "linear_sums", lambda *a: (calls.append(1), plain(*a))[1])
    monkeypatch.setattr(selection, "fit_l1", None)
    monkeypatch.setattr(selection, "feature_vectors", None)
    selection.select_neurons(acts, targets, 2, neurons=neurons).count()
    assert len(calls) == 1
    sums = plain(acts, targets, 7)
    sd = np.where(dense.std(0) > 0, dense.std(0), 1.0)
    x = (dense - dense.mean(0)) / sd
    assert np.allclose(sums.covariance, x.T @ x / 90, atol=1e-12) and np.allclose(sums.pull, x.T @ (y - y.mean()) / 90, atol=1e-9)
    last = None
    for alpha in (0.5, 0.1, 0.02, 1e-3, 1e-6, 0.3):  # down a path, and back
        last = sums.fit(alpha, last)
        w = np.array(last.coefficients)
        pull = sums.pull - sums.covariance @ w
        on = w != 0
        assert np.all(np.abs(pull) <= alpha + 1e-10) and np.allclose(pull[on], alpha * np.sign(w[on]), atol=1e-10)
        assert np.allclose(w, sums.fit(alpha).coefficients, atol=1e-7)


def test_linear_fit_of_equal_features_and_wide_models(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((200, 40)) < 0.2, rng.exponential(size=(200, 40)), 0.0)
    x[:, 7] = x[:, 3]
    y = 3 * x[:, 3] - x[:, 20] + 0.1 * rng.normal(size=200)
    acts, targets, neurons = tables(spark, x, y)
    sums = selection.linear_sums(acts, targets, 40)
    fit = sums.fit(0.05)
    w = np.array(fit.coefficients)
    pull = sums.pull - sums.covariance @ w
    assert np.all(np.abs(pull) <= 0.05 + 1e-9) and w[3] + w[7] > 1 and w[20] < 0
    monkeypatch.setattr(selection, "GRAM_FEATURES", 10)
    by_rows = selection.select_neurons(acts, targets, 3, neurons=neurons, alpha=0.05).collect()
    monkeypatch.setattr(selection, "GRAM_FEATURES", 4096)
    by_sums = selection.select_neurons(acts, targets, 3, neurons=neurons, alpha=0.05).collect()
    for found in (by_rows, by_sums):  # equal features may share their coefficient or not
        scores = {r.neuron_idx: r.score for r in found}
        assert np.isclose(scores.get(3, 0.0) + scores.get(7, 0.0), w[3] + w[7], atol=1e-4) and np.isclose(scores[20], w[20], atol=1e-4)


def test_alpha_search(spark, sparse_data):
    acts, targets, neurons = tables(spark, *sparse_data)
    got = selection.select_neurons(acts, targets, 2, neurons=neurons).orderBy("rank").collect()
    assert [r.neuron_idx for r in got] == [0, 1] and got[0].score > 0 > got[1].score
    tried = []

    def fit(alpha):
        tried.append(alpha)
        return selection.SparseFit(alpha, [1.0] * (3 if alpha < 1 else 1))

    with pytest.warns(UserWarning):
        selection.search_alpha(fit, 2)
    assert len(tried) == 20 and np.isclose(tried[0], 0.1) and np.isclose(tried[-1], 1, rtol=1e-3)


def test_scales(spark, sparse_data):
    dense, y = sparse_data
    acts, targets, _ = tables(spark, dense, y)
    got = {r.neuron_idx: (r.mean, r.scale) for r in selection.feature_scales(acts, targets).collect()}
    assert all(np.allclose(got[j], (dense[:, j].mean(), dense[:, j].std())) for j in got)


def test_custom_metric(spark, sparse_data):
    dense, y = sparse_data
    acts, targets, neurons = tables(spark, dense, y)

    def metric(col):
        return col("sum_ay") / col("n") + 0 * col("strongest")

    extra = {"strongest": F.max(F.col("activation") * F.col("y"))}
    want = sorted([j for j in range(7) if j != 5], key=lambda j: (dense[:, j] * y).mean())[-3:]
    got = selection.select_neurons(
        acts, targets, 3, neurons=neurons, method="custom", metric_fn=metric, extra=extra
    ).collect()
    assert [r.neuron_idx for r in got] == want
    assert np.allclose([r.score for r in got], [(dense[:, j] * y).mean() for j in want])


@pytest.mark.parametrize("leaf", [200_000, 5])
def test_rank_metrics(spark, monkeypatch, leaf):
    plain = ranking.running_totals
    monkeypatch.setattr(ranking, "running_totals", lambda df, v, c, by=(): plain(df, v, c, leaf, by))
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((120, 5)) < 0.5, rng.normal(size=(120, 5)).round(1), 0.0)  # ties, zeros and negatives
    y = (dense[:, 1] + rng.normal(size=120) > 0).astype(float)
    acts, targets, neurons = tables(spark, dense, y)

    def scores(metric, targets):
        rows = selection.select_neurons(acts, targets, 5, neurons=neurons, method="custom", metric_fn=metric, ranks=True).collect()
        return {r.neuron_idx: r.score for r in rows}

    got = scores(selection.auroc, targets)
    for j in range(5):
        a, b = dense[y == 1, j], dense[y == 0, j]
        assert np.isclose(got[j], ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean())
    z = (dense[:, 2] * 2 + rng.normal(size=120)).round(1)
    got = scores(selection.spearman, tables(spark, dense, z)[1])
    for j in range(5):
        ranks = [pd.Series(v).rank().to_numpy() for v in (dense[:, j], z)]
        assert np.isclose(got[j], np.corrcoef(*ranks)[0, 1])


def test_dispatch_errors(spark, sparse_data):
    acts, targets, neurons = tables(spark, *sparse_data)
    with pytest.raises(ValueError, match="unknown"):
        selection.select_neurons(acts, targets, 2, neurons=neurons, method="magic")
    with pytest.raises(ValueError, match="metric_fn"):
        selection.select_neurons(acts, targets, 2, neurons=neurons, method="custom")
    with pytest.raises(ValueError, match="classes"):
        selection.select_neurons(acts, targets, 2, neurons=neurons, classification=True)
    with pytest.raises(ValueError, match="exceeds"):
        selection.select_neurons(acts, targets, 9, neurons=neurons, method="correlation")


# --- sampling ---------------------------------------------------------------------------


def expected_zero_rows(dense, neuron, n, seed):
    start = position(f"draw:{seed}:neuron:{neuron}")
    zero = [i for i in range(len(dense)) if dense[i, neuron] == 0]
    return set(sorted(zero, key=lambda i: ((position(f"draw:{seed}:{i}") - start) % HASH_RANGE, i))[:n])


@pytest.mark.parametrize("force", ["as planned", "window too short", "all rows"])
def test_zero_rows(spark, monkeypatch, force):
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((1500, 4)) < [[0.02, 0.5, 0.97, 1.0]], 1.0, 0.0)
    acts, targets, _ = tables(spark, dense, np.zeros(1500))
    original = sampling._zero_rows_in_windows
    calls = []

    def watch(mine, rows, shares, *options):
        calls.append(dict(shares))
        if force == "window too short" and len(calls) < 3:
            shares = {i: s / 100 for i, s in shares.items()}
        return original(mine, rows, shares, *options)

    monkeypatch.setattr(sampling, "_zero_rows_in_windows", watch)
    n = 600 if force == "all rows" else 8
    found = sampling.zero_rows(acts, targets, [0, 1, 2, 3], n, 11).collect()
    for j in range(4):
        assert {r.row_id for r in found if r.neuron_idx == j} == expected_zero_rows(dense, j, n, 11)
    assert [sorted(c) for c in calls] == {"as planned": [[0, 1]], "window too short": [[0, 1]] * 3, "all rows": [[0]]}[force]
    if force == "window too short":
        assert calls[2][0] == min(1.0, 16 * calls[0][0])
    assert sampling.zero_rows(acts, targets, [], 5, 1).count() == 0


def test_a_feature_that_is_nearly_always_active(spark, monkeypatch):
    """Its few zero rows are listed; no row is repeated for it."""
    dense = np.ones((3000, 2))
    dense[[5, 70, 2999], 0] = 0.0
    dense[::2, 1] = 0.0
    acts, targets, _ = tables(spark, dense, np.zeros(3000))
    monkeypatch.setattr(sampling, "_zero_rows_in_windows", None)  # would fail
    assert {r.row_id for r in sampling.zero_rows(acts, targets, [0], 8, 1).collect()} == {5, 70, 2999}
    listed = sampling.all_zero_rows(acts, targets, [0])
    assert listed.count() == 3
    shown = listed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    assert shown.index("Generate") < shown.index("Filter (size")  # rows without a missing feature end before the list is spread


def test_top_zero_with_few_of_each(spark):
    dense = np.array([[3.0, 0.0], [2.0, 1.0], [0.0, 1.0], [1.0, 1.0]])
    acts, _, _ = tables(spark, dense, np.zeros(4))
    texts = spark.createDataFrame([(i, f"one two three {i}") for i in range(4)], "row_id long, text string")
    got = sampling.sample_top_zero(texts, acts, [0, 1], 4, 2, 0).collect()
    rows = {(r.neuron_idx, r["class"], r.row_id) for r in got}
    assert rows == {(0, 1, 0), (0, 1, 1), (0, 0, 2), (1, 1, 1), (1, 1, 2), (1, 0, 0)}
    assert {r.text for r in got} == {"one two[... rest of text is truncated]"}
    assert all(r.activation == dense[r.row_id, r.neuron_idx] for r in got)


def test_percentile_bins(spark):
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((300, 2)) < 0.6, rng.exponential(size=(300, 2)), 0.0)
    acts, _, _ = tables(spark, dense, np.zeros(300))
    texts = spark.createDataFrame([(i, str(i)) for i in range(300)], "row_id long, text string")
    got = sampling.sample_percentile_bins(texts, acts, [0, 1], 20, None, 1, (80, 100), (10, 30)).collect()
    assert len(got) == 40
    for r in got:
        positive = dense[:, r.neuron_idx][dense[:, r.neuron_idx] > 0]
        low, high = np.percentile(positive, (80, 100) if r["class"] == 1 else (10, 30))
        assert low <= r.activation <= high
    against_zero = sampling.sample_percentile_bins(texts, acts, [0], 20, None, 1).filter("class = 0").collect()
    assert {r.row_id for r in against_zero} == expected_zero_rows(dense, 0, 10, 1)


def test_top_texts_and_random_neurons(spark):
    acts, _, neurons = tables(spark, np.array([[1.0, 0.0], [2.0, 0.0], [3.0, 5.0]]), np.zeros(3))
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "row_id long, text string")
    got = {r.neuron_idx: (r.top_example_1, r.top_example_2) for r in sampling.top_texts(texts, acts, [0, 1], 2).collect()}
    assert got == {0: ("t2", "t1"), 1: ("t2", None)}
    assert sampling.sample_neurons(neurons, 1, 3).count() == 1
