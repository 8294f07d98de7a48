from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from corollary.functions.tails import normal_two_sided, student_two_sided
from corollary.operators import evaluation, fidelity


def design_of(spark, columns, y):
    frame = pd.DataFrame({f"c{i}": np.asarray(c, dtype="int32") for i, c in enumerate(columns)})
    frame.insert(0, "y", np.asarray(y, dtype=float))
    frame.insert(0, "row_id", np.arange(len(frame)))
    return spark.createDataFrame(frame)


def rows_of(df, key="hypothesis"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    concepts = (rng.random((3, 200)) < [[0.5], [0.2], [0.8]]).astype(int)
    y = 1.5 * concepts[0] - concepts[1] + rng.normal(size=200)
    return concepts, y


NAMES = ["a", "b", "c"]


def test_tails():
    # tabulated quantiles: t 0.975 for 10 and 1 degrees of freedom, normal 0.975
    assert math.isclose(student_two_sided(2.228138851964939, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(student_two_sided(12.706204736174698, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert student_two_sided(0.0, 5) == 1.0 and student_two_sided(float("inf"), 5) == 0.0
    assert student_two_sided(1.0, 0) is None and student_two_sided(None, 3) is None


def test_separation_and_t(spark, sample):
    concepts, y = sample
    got = rows_of(evaluation.with_t_pvalue(evaluation.separation(design_of(spark, concepts, y), NAMES)))
    for name, c in zip(NAMES, concepts):
        one, zero = y[c == 1], y[c == 0]
        assert np.isclose(got[name].separation_score, one.mean() - zero.mean())
        pooled = (one.var(ddof=1) * (len(one) - 1) + zero.var(ddof=1) * (len(zero) - 1)) / 198
        t = (one.mean() - zero.mean()) / np.sqrt(pooled * (1 / len(one) + 1 / len(zero)))
        assert np.isclose(got[name].t, t) and got[name].df == 198
        assert np.isclose(got[name].separation_pval, student_two_sided(t, 198))
        assert np.isclose(got[name].feature_prevalence, c.mean())


def test_separation_of_pairs(spark):
    c = np.array([1, 1, -1, -1, 0, 0])
    y = np.array([1.0, 0, 0, 1, 1, 0])
    got = evaluation.with_t_pvalue(evaluation.separation(design_of(spark, [c], y), ["a"])).first()
    assert np.isclose(got.separation_score, 0.5 * (0.5 + 0.5) - 0.5)
    one, zero = np.array([1.0, 0, 0, -1]), np.array([1.0, 0])
    pooled = (one.var(ddof=1) * 3 + zero.var(ddof=1)) / 4
    assert np.isclose(got.t, (one.mean() - zero.mean()) / np.sqrt(pooled * (1 / 4 + 1 / 2)))
    assert np.isclose(got.feature_prevalence, 4 / 6)


def test_concept_without_negatives_is_null(spark):
    got = evaluation.with_t_pvalue(evaluation.separation(design_of(spark, [[1, 1, 1]], [1, 2, 3]), ["a"])).first()
    assert got.separation_score is None and got.t is None and got.separation_pval is None


def test_least_squares(spark, sample):
    concepts, y = sample
    x = np.column_stack([np.ones(200), concepts.T])
    beta, rss, _, _ = np.linalg.lstsq(x, y, rcond=None)
    errors = np.sqrt(rss[0] / 196 * np.diag(np.linalg.inv(x.T @ x)))
    fitted, metrics, predictions = evaluation.regression(design_of(spark, concepts, y), NAMES)
    got = rows_of(fitted)
    for i, name in enumerate(NAMES, start=1):
        assert np.isclose(got[name].regression_coef, beta[i])
        assert np.isclose(got[name].regression_pval, student_two_sided(beta[i] / errors[i], 196))
    r = np.corrcoef(y, x @ beta)[0, 1]
    assert np.isclose(metrics["r2"], r * r)
    assert np.isclose(evaluation.squared_correlation(predictions).first()[0], r * r)


def test_least_squares_with_a_large_mean(spark, sample):
    concepts, y = sample
    near, _, _ = evaluation.regression(design_of(spark, concepts, y), NAMES)
    far, metrics, _ = evaluation.regression(design_of(spark, concepts, y + 1e8), NAMES)
    want, got = rows_of(near), rows_of(far)
    assert all(np.isclose(got[n].regression_pval, want[n].regression_pval, rtol=1e-4) for n in NAMES)
    assert metrics["r2"] is not None


def test_constant_and_collinear_concepts(spark, sample):
    concepts, y = sample
    columns = [concepts[0], np.ones(200), concepts[0]]
    fitted, metrics, _ = evaluation.regression(design_of(spark, columns, y), NAMES)
    got = rows_of(fitted)
    assert got["b"].regression_coef is None and got["b"].regression_pval is None
    assert np.isclose(got["a"].regression_coef, got["c"].regression_coef)
    single, alone, _ = evaluation.regression(design_of(spark, [concepts[0]], y), ["a"])
    assert np.isclose(2 * got["a"].regression_coef, rows_of(single)["a"].regression_coef)
    assert np.isclose(metrics["r2"], alone["r2"])


def test_logistic_is_the_likelihood_maximum(spark, sample):
    concepts, y = sample
    z = (y > 0.5).astype(float)
    fitted, metrics, _ = evaluation.regression(design_of(spark, concepts, z), NAMES, classification=True)
    x = np.column_stack([np.ones(200), concepts.T])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (z - p))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    got = rows_of(fitted)
    for i, name in enumerate(NAMES, start=1):
        assert np.isclose(got[name].regression_coef, beta[i], atol=1e-6)
        assert np.isclose(got[name].regression_pval, normal_two_sided(beta[i] / errors[i]), atol=1e-6)
    logs = (z * np.log(p) + (1 - z) * np.log(1 - p)).sum()
    base = 200 * (z.mean() * np.log(z.mean()) + (1 - z.mean()) * np.log(1 - z.mean()))
    assert np.isclose(metrics["r2"], 1 - logs / base)
    assert {"auroc", "auprc"} <= set(metrics)


def test_a_logistic_step_is_one_pass_without_grouping_concepts(spark, sample, monkeypatch):
    concepts, y = sample
    design = design_of(spark, concepts, (y > 0.5).astype(float))
    steps, plain = [], evaluation._logistic_sums
    monkeypatch.setattr(evaluation, "_logistic_sums", lambda *a: (steps.append(a[2].copy()), plain(*a))[1])
    fitted, _, _ = evaluation.regression(design, NAMES, classification=True)
    assert 3 < len(steps) < 12 and len(rows_of(fitted)) == len(NAMES)
    rows = design.select("c0", "c1", "c2", "y").persist()
    by_tree, direct = (plain(rows, 3, np.array([0.1, 0.2, -0.3, 0.4]), tasks) for tasks in (None, 8))
    assert np.allclose(by_tree, direct)
    rows.unpersist()


def test_logistic_falls_back_to_least_squares(spark):
    separated = np.array([0, 0, 0, 1, 1, 1])
    fitted, metrics, _ = evaluation.regression(
        design_of(spark, [separated], separated.astype(float)), ["a"], classification=True
    )
    assert "r2" not in metrics and metrics["auroc"] == 1.0
    assert np.isclose(fitted.first().regression_coef, 1.0)


def ranking_by_definition(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    precision, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        hits = (y[s == v] == 1).sum()
        precision += hits * (y[s >= v] == 1).mean()
        seen += hits
    return wins, precision / seen


def test_ranking_metrics(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(300) < 0.4).astype(float)
    for digits in (1, 6):
        s = (y + rng.normal(size=300)).round(digits)
        got = evaluation.ranking_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "score": s}))).first()
        assert np.allclose([got.auroc, got.auprc], ranking_by_definition(y, s))


def test_one_class_has_no_auroc(spark):
    got = evaluation.ranking_metrics(spark.createDataFrame([(1.0, 0.2), (1.0, 0.3)], "y double, score double")).first()
    assert got.auroc is None and got.auprc == 1.0


def test_significant(spark):
    df = spark.createDataFrame([(0.001,), (0.024,), (0.026,), (None,)], "regression_pval double")
    got = evaluation.significant(df, 0.1).first()
    assert (got.n, got.total, got.threshold) == (2, 4, 0.025)


def test_hypothesis_table(spark, sample):
    concepts, y = sample
    metrics, table = evaluation.score_hypotheses(design_of(spark, concepts, y), NAMES)
    assert table.columns == [
        "hypothesis", "separation_score", "separation_pval", "regression_coef", "regression_pval", "feature_prevalence"
    ]
    scores = [r.separation_score for r in table.collect()]
    assert scores == sorted(scores, reverse=True)
    assert metrics["Significant"][1:] == (3, 0.1 / 3)
    gappy = spark.createDataFrame([(0, 1.0, None), (1, 0.0, 1)], "row_id long, y double, c0 int")
    with pytest.raises(ValueError, match="annotation"):
        evaluation.score_hypotheses(gappy, ["a"])


def test_concept_correlations_per_run(spark):
    rng = np.random.default_rng(4)
    bits = (rng.random((80, 5)) < 0.5).astype(int)
    bits[:, 4] = 1
    frame = pd.DataFrame(bits, columns=["r0", "r1", "p0", "p1", "p2"])
    frame["run"] = np.arange(80) % 3
    got = evaluation.concept_correlations(spark.createDataFrame(frame), ["a", "b"], ["x", "y", "z"], run="run").collect()
    assert len(got) == 18
    for r in got:
        part = frame[frame.run == r.run]
        left, right = part[f"r{'ab'.index(r.reference)}"], part[f"p{'xyz'.index(r.predicted)}"]
        assert (r.correlation is None) if r.predicted == "z" else np.isclose(r.correlation, np.corrcoef(left, right)[0, 1])


def test_best_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n = int(rng.integers(1, 7))
        s = rng.normal(size=(n, n)) if trial % 2 else rng.integers(0, 3, size=(n, n)).astype(float)
        match = evaluation.best_assignment(s)
        assert sorted(match) == list(range(n))
        best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert np.isclose(sum(s[i, match[i]] for i in range(n)), best)


def test_matching_runs(spark):
    rows = [(k, a, b, float((a == b) == (k == 0))) for k in (0, 1) for a in "xyz" for b in "xyz"]
    got = evaluation.match_concepts(spark.createDataFrame(rows, "run_id long, reference string, predicted string, similarity double"))
    pairs = {(r.run_id, r.reference, r.predicted) for r in got.collect()}
    assert {p for p in pairs if p[0] == 0} == {(0, c, c) for c in "xyz"}
    assert len(pairs) == 6 and all(a != b for k, a, b in pairs if k == 1)
    uneven = spark.createDataFrame(rows[:6], "run_id long, reference string, predicted string, similarity double")
    with pytest.raises(Exception, match="concepts"):
        evaluation.match_concepts(uneven).collect()


# --- fidelity ---------------------------------------------------------------------------


def test_fidelity_metrics(spark):
    rows = [(0, "n", 1, 3.0, 1), (0, "n", 1, 2.0, 0), (0, "n", 0, 0.0, 0), (0, "n", 0, 0.0, 1),
            (1, "only positives", 1, 1.0, 1), (2, "never", 1, 1.0, 0), (2, "never", 0, 0.0, 0),
            (3, "reversed", 1, 1.0, 0), (3, "reversed", 0, 0.0, 1), (4, "gap", 1, 1.0, 1), (4, "gap", 0, 0.0, None),
            (4, "gap", 0, 0.0, 0)]
    df = spark.createDataFrame(rows, "neuron_idx int, interpretation string, class int, activation double, value int")
    got = rows_of(fidelity.fidelity_metrics(df), "interpretation")

    def of(name):
        return [got[name][m] for m in fidelity.METRICS]

    assert np.allclose(of("n"), [0.5, 0.5, 0.5, np.corrcoef([3, 2, 0, 0], [1, 0, 0, 1])[0, 1]])
    assert of("only positives") == [0, 0, 0, 0]
    assert of("never") == [0, 1, 0, 0]
    assert np.allclose(of("reversed"), [0, 0, 0, -1])
    assert np.allclose(of("gap"), [1, 1, 1, 1])


def test_best_and_worst_names(spark):
    names = spark.createDataFrame(
        [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, None)], "neuron_idx int, candidate_idx int, interpretation string"
    )
    metrics = spark.createDataFrame(
        [(0, "a", 0.4), (0, "b", 0.9), (0, "c", 0.9)], "neuron_idx int, interpretation string, f1 double"
    )
    best = {r.neuron_idx: r.interpretation for r in fidelity.best_names(names, metrics).collect()}
    worst = {r.neuron_idx: r.interpretation for r in fidelity.best_names(names, metrics, worst=True).collect()}
    assert best == {0: "b", 1: None} and worst == {0: "a", 1: None}
    with pytest.raises(ValueError):
        fidelity.best_names(names, metrics, "accuracy")
