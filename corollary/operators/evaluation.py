"""Testing concepts against a target.

The operators read a design table: one row per text with ``y`` and one column per
concept, ``c0, c1, ..`` (see :func:`design_table`). Long forms are made from it row by
row, so no statistic shuffles more than its sums.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.functions.tails import normal_two_sided, student_two_sided
from corollary.operators import ranking, relational
from corollary.session import collect_dimension

#: Groups in which matrices of sums are added, round by round.
ADDED_BY = (64, 1)
#: Bytes of matrices that the driver adds up itself.
COLLECT_BYTES = 64 << 20
#: Steps of the logistic fit and halvings of one, and the standard error above which it counts as separated.
FIT_STEPS, HALVINGS, LARGEST_ERROR = 35, 20, 1e3


def concept_columns(concepts: Sequence[str]) -> list[str]:
    if not concepts:
        raise ValueError("no concept to evaluate")
    return [f"c{i}" for i in range(len(concepts))]


def design_table(annotations: DataFrame, targets: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """``row_id, y, c0, c1, ..`` from long annotations ``row_id, concept, value``; gaps are NULL."""
    return targets.select("row_id", F.col("y").cast("double").alias("y")).join(
        relational.wide_values(annotations, "row_id", concepts), "row_id", "left"
    )


def long_values(design: DataFrame, concepts: Sequence[str], *keep: str) -> DataFrame:
    """``concept_idx, concept, value`` plus kept columns, one row per cell; narrow."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(c).alias("concept"), F.col(name).alias("value"))
            for i, (c, name) in enumerate(zip(concepts, concept_columns(concepts)))
        ]
    )
    return design.select(*keep, F.inline(cells).alias("concept_idx", "concept", "value"))


def _missing(design: DataFrame, concepts: Sequence[str]) -> int:
    gaps = F.count_if(F.greatest(*[F.col(c).isNull() for c in concept_columns(concepts)], F.lit(False)))
    return design.agg(gaps).first()[0]


def separation(design: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """``hypothesis, separation_score, t, df, feature_prevalence``.

    The score is the mean target with the concept minus the mean without. When a concept
    also takes -1 (pairs), its positive mean is half of E[y | 1] + E[1 - y | -1]. The
    t statistic pools the variances of the two samples, where a -1 row counts with -y.
    """
    y, v = F.col("y"), F.col("value")
    plus, minus, none = v == 1, v == -1, v == 0
    signed = F.when(minus, -y).when(plus, y)
    sums = (
        long_values(design, concepts, "y")
        .groupBy("concept_idx", "concept")
        .agg(
            F.avg(F.when(plus, y)).alias("mean_plus"),
            F.avg(F.when(minus, 1 - y)).alias("mean_minus"),
            F.avg(F.when(none, y)).alias("mean_none"),
            F.count_if(minus).alias("n_minus"),
            F.count(signed).cast("double").alias("n1"),
            F.sum(signed).alias("s1"),
            F.var_samp(signed).alias("v1"),
            F.count_if(none).cast("double").alias("n0"),
            F.var_samp(F.when(none, y)).alias("v0"),
            F.avg((v != 0).cast("double")).alias("feature_prevalence"),
        )
    )
    positive = F.when(F.col("n_minus") > 0, 0.5 * (F.col("mean_plus") + F.col("mean_minus"))).otherwise(F.col("mean_plus"))
    n1, n0 = F.col("n1"), F.col("n0")
    df = n1 + n0 - 2
    within = F.coalesce(F.col("v1") * (n1 - 1), F.lit(0.0)) + F.coalesce(F.col("v0") * (n0 - 1), F.lit(0.0))
    error = F.sqrt(F.try_divide(within, df) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    t = F.try_divide(F.try_divide(F.col("s1"), n1) - F.col("mean_none"), error)
    return sums.select(
        F.col("concept_idx"),
        F.col("concept").alias("hypothesis"),
        (positive - F.col("mean_none")).alias("separation_score"),
        F.when(df > 0, t).alias("t"),
        df.alias("df"),
        "feature_prevalence",
    )


def with_t_pvalue(stats: DataFrame, name: str = "separation_pval") -> DataFrame:
    """Two-sided Student p-value of ``t, df``; one row per concept, in one Arrow call."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(a) or pd.isna(b) else student_two_sided(a, b) for a, b in zip(t, df)], dtype="float64"
        )

    return stats.withColumn(name, tail("t", "df")).withColumn(name, F.nanvl(name, F.lit(None)))


def _added_up(parts: DataFrame, shape: tuple[int, ...], tasks: int | None = None) -> np.ndarray | None:
    """Sum of one ``part, sums`` record per task; added in two rounds, so that no task and not the driver receives
    more than a bounded number of matrices or their share of all. None without records. Where the ``tasks`` are known to be few
    and their matrices small, the driver adds them up."""
    if tasks is not None and tasks <= ADDED_BY[0] and tasks * 8 * int(np.prod(shape)) <= COLLECT_BYTES:
        records = parts.toArrow().sort_by("part").column("sums")
        return sum(np.frombuffer(raw.as_buffer()) for raw in records).reshape(shape) if len(records) else None

    def add(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("part")
        total = np.zeros(int(np.prod(shape)))
        for raw in ordered.column("sums"):
            total += np.frombuffer(raw.as_buffer())
        return pa.table({"part": ordered.column("part").slice(0, 1), "sums": [total.tobytes()]})

    for groups in ADDED_BY:
        parts = parts.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(add, "part int, sums binary")
    found = parts.first()
    return np.frombuffer(found["sums"]).reshape(shape) if found else None


def _with_ones(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.column_stack([np.ones(batch.num_rows)] + [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])


def _record(total: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [total.tobytes()]})


def cross_products(design: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Row count and matrix of sums of products of ``1`` and the given columns.

    Each task multiplies its Arrow batches and emits one matrix.
    """
    width = len(columns) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _with_ones(batch, width - 1)
            total += x.T @ x
        yield _record(total)

    sums = design.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(products, "part int, sums binary")
    gram = _added_up(sums, (width, width))
    gram = np.zeros((width, width)) if gram is None else gram
    return int(round(gram[0, 0])), gram


def _least_squares(design: DataFrame, concepts: Sequence[str]) -> tuple[list[tuple], float | None, np.ndarray]:
    """``(coef, p)`` per concept, R squared and the coefficients, intercept first."""
    columns = concept_columns(concepts)
    # centred, so that a large mean target costs no precision in the sums
    middle = design.agg(F.avg("y")).first()[0]
    n, gram = cross_products(design.withColumn("y", F.col("y") - F.lit(middle)), [*columns, "y"])
    mean = gram[0] / n
    centered = gram[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    xx, xy, yy = centered[:-1, :-1], centered[:-1, -1], centered[-1, -1]
    constant = np.diag(xx) <= 1e-12 * np.maximum(np.diag(gram)[1:-1], 1.0)
    # pseudo-inverse: exact where the concepts are independent, minimum norm where not
    inverse = np.zeros_like(xx)
    keep = ~constant
    inverse[np.ix_(keep, keep)] = np.linalg.pinv(xx[np.ix_(keep, keep)], rcond=1e-12, hermitian=True)
    rank = np.linalg.matrix_rank(xx[np.ix_(keep, keep)], tol=1e-12 * max(xx.max(initial=0.0), 1e-300)) if keep.any() else 0
    beta = inverse @ xy
    residual = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
    df = n - rank - 1
    out = []
    for i in range(len(columns)):
        if constant[i]:
            out.append((None, None))
            continue
        error = np.sqrt(residual / df * inverse[i, i]) if df > 0 else np.nan
        if error == 0:  # a perfect fit
            out.append((float(beta[i]), 0.0 if beta[i] else None))
        else:
            out.append((float(beta[i]), student_two_sided(float(beta[i] / error), df)))
    explained = beta @ xy
    fitted = beta @ xx @ beta
    r2 = float(explained**2 / (fitted * yy)) if fitted > 0 and yy > 0 else None
    return out, r2, np.concatenate([[middle + mean[-1] - beta @ mean[1:-1]], beta])


def _logistic_sums(rows: DataFrame, columns: int, beta: np.ndarray, tasks: int | None = None) -> np.ndarray:
    """What a Newton step needs, in one pass: curvature, then a row of slopes, then log-likelihood, rows and sum of the target."""
    width = columns + 1
    weights = rows.sparkSession.sparkContext.broadcast(beta)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 2, max(width, 3)))
        for batch in batches:
            x = _with_ones(batch, columns)
            y = batch.column(columns).to_numpy(zero_copy_only=False)
            z = x @ weights.value
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[:width, :width] += (x * (p * (1 - p))[:, None]).T @ x
            total[width, :width] += x.T @ (y - p)
            total[width + 1, :3] += (y @ z - np.logaddexp(0, z).sum(), len(y), y.sum())
        yield _record(total)

    try:
        return _added_up(rows.mapInArrow(step, "part int, sums binary"), (width + 2, max(width, 3)), tasks)
    finally:
        weights.destroy()


def _logistic(design: DataFrame, concepts: Sequence[str]):
    """Maximum-likelihood logistic fit by Newton steps, one pass each; None where it has no finite solution."""
    columns = concept_columns(concepts)
    rows = design.select(*(F.col(c).cast("double") for c in columns), F.col("y").cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _newton(rows, columns)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, columns: Sequence[str]):
    n, gram = cross_products(rows, columns)
    size = np.sqrt(np.diag(gram))
    if size.min() == 0 or np.linalg.matrix_rank(gram / np.outer(size, size), tol=1e-10) < len(gram):
        return None
    width = len(columns) + 1
    beta, level = np.zeros(width), -np.inf
    tasks = rows.rdd.getNumPartitions()  # kept by the pass above
    for _ in range(FIT_STEPS):
        sums = _logistic_sums(rows, len(columns), beta, tasks)
        logs, _, ones = sums[width + 1, :3]
        halvings = 0
        while logs < level - 1e-9 * abs(level) and halvings < HALVINGS:
            move, halvings = move / 2, halvings + 1
            beta = beta - move
            sums = _logistic_sums(rows, len(columns), beta, tasks)
            logs = sums[width + 1, 0]
        curve, slope = sums[:width, :width], sums[width, :width]
        try:
            inverse = np.linalg.inv(curve)
        except np.linalg.LinAlgError:
            warnings.warn("logistic fit failed: singular curvature", stacklevel=3)
            return None
        move, level = inverse @ slope, logs
        if not np.all(np.isfinite(move)) or np.sqrt(np.diag(inverse)).max() > LARGEST_ERROR:
            return None  # the classes can be separated, so that the coefficients have no bound
        if np.abs(move).max() <= 1e-10 * max(1.0, np.abs(beta).max()):
            break
        beta = beta + move
    errors = np.sqrt(np.diag(inverse))[1:]
    base = sum(k * np.log(k / n) for k in (ones, n - ones) if k > 0)
    fitted = [(float(b), normal_two_sided(float(b) / e)) for b, e in zip(beta[1:], errors, strict=True)]
    return fitted, float(1 - logs / base) if base else None, beta


def _linear(beta: np.ndarray, columns: Sequence[str]) -> Column:
    total = F.lit(float(beta[0]))
    for b, name in zip(beta[1:], columns):
        total = total + F.lit(float(b)) * F.col(name)
    return total


def regression(design: DataFrame, concepts: Sequence[str], *, classification: bool = False) -> tuple[DataFrame, dict, DataFrame]:
    """Fit ``y`` on all concepts with an intercept.

    Returns ``hypothesis, regression_coef, regression_pval``, the fit's metrics and the
    rows ``y, score`` with the fitted values. Classification fits a logistic model and
    falls back to least squares when that has no solution.
    """
    spark = design.sparkSession
    fit = _logistic(design, concepts) if classification else None
    logistic = fit is not None
    if fit is None:
        fit = _least_squares(design, concepts)
    rows, r2, beta = fit
    linear = _linear(beta, concept_columns(concepts))
    score = 1 / (1 + F.exp(-linear)) if logistic else linear
    predictions = design.select("y", score.alias("score"))
    metrics: dict = {}
    if classification:
        metrics.update(ranking_metrics(predictions).first().asDict())
        if logistic:
            metrics["r2"] = r2
    else:
        metrics["r2"] = r2
    table = spark.createDataFrame(
        [(i, c, *row) for i, (c, row) in enumerate(zip(concepts, rows))],
        "concept_idx int, hypothesis string, regression_coef double, regression_pval double",
    )
    return table, metrics, predictions


def ranking_metrics(predictions: DataFrame) -> DataFrame:
    """``auroc, auprc`` of ``y`` in {0, 1} by ``score``, one row.

    Equal scores, to the last bit, are pooled first, which both metrics require and which also shrinks the
    data to one row per distinct score. AUROC is the mid-rank sum; average precision is
    the step sum over distinct scores.
    """
    pooled = predictions.groupBy("score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    ranked = ranking.running_totals(pooled, "score", ["pos", "neg"])
    pos, neg, above_pos, above_neg = (F.col(c) for c in ("pos", "neg", "above_pos", "above_neg"))
    wins = F.sum(neg * (above_pos + pos / 2))
    total_pos, total_neg = F.sum("pos"), F.sum("neg")
    precision = (above_pos + pos) / (above_pos + pos + above_neg + neg)
    return ranked.agg(
        F.try_divide(wins, total_pos * total_neg).alias("auroc"),
        F.try_divide(F.sum(pos * precision), total_pos).alias("auprc"),
    )


def squared_correlation(predictions: DataFrame) -> DataFrame:
    """``r2``: squared Pearson correlation of target and fitted value."""
    y, p = F.col("y"), F.col("score")
    s = predictions.agg(
        F.covar_pop(y, p).alias("c"), F.var_pop(y).alias("vy"), F.var_pop(p).alias("vp")
    )
    return s.select(F.try_divide(F.col("c") * F.col("c"), F.col("vy") * F.col("vp")).alias("r2"))


def significant(pvalues: DataFrame, threshold: float = 0.1, column: str = "regression_pval") -> DataFrame:
    """Bonferroni count: ``n, total, threshold``."""
    # one p-value per concept
    counted = pvalues.agg(F.count("*").alias("total"), F.collect_list(column).alias("_p"))
    limit = F.lit(threshold) / F.col("total")
    return counted.select(
        F.size(F.filter("_p", lambda p: p < limit)).cast("long").alias("n"), "total", limit.alias("threshold")
    )


def score_hypotheses(
    design: DataFrame, concepts: Sequence[str], *, classification: bool = False, corrected_pval_threshold: float = 0.1
) -> tuple[dict, DataFrame]:
    """Metrics of the joint fit and one line per concept, best separation first.

    The design is read by several passes; it is kept while they run.
    """
    design = design.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _scored(design, concepts, classification, corrected_pval_threshold)
    finally:
        design.unpersist()


def _scored(design: DataFrame, concepts: Sequence[str], classification: bool, corrected_pval_threshold: float) -> tuple[dict, DataFrame]:
    gaps = _missing(design, concepts)
    if gaps:
        raise ValueError(f"{gaps} rows lack an annotation; drop or re-annotate them first")
    fitted, metrics, _ = regression(design, concepts, classification=classification)
    s = significant(fitted, corrected_pval_threshold).first()
    metrics["Significant"] = (s["n"], s["total"], s["threshold"])
    table = (
        with_t_pvalue(separation(design, concepts))
        .join(F.broadcast(fitted.drop("hypothesis")), "concept_idx")
        .select(
            "hypothesis", "separation_score", "separation_pval", "regression_coef", "regression_pval",
            "feature_prevalence",
        )
        .orderBy(F.col("separation_score").desc_nulls_last(), "hypothesis")
    )
    # one row per concept, made independent of the kept design
    return metrics, design.sparkSession.createDataFrame(collect_dimension(table), table.schema)


def concept_correlations(
    design: DataFrame, reference: Sequence[str], predicted: Sequence[str], run: str | None = None
) -> DataFrame:
    """Pearson correlation of every reference with every predicted concept.

    ``design`` holds columns ``r0..`` and ``p0..`` per row, and optionally a run id. Each
    task emits its matrix of sums per run; rows are never paired with each other or
    repeated per concept pair.
    """
    left = [f"r{i}" for i in range(len(reference))]
    right = [f"p{i}" for i in range(len(predicted))]
    columns = left + right
    keys = [run] if run else []
    n_left, n_right = len(left), len(right)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for frame in frames:
            groups = frame.groupby(run, dropna=False) if run else [(None, frame)]
            for key, part in groups:
                x = part[columns].to_numpy(dtype=np.float64)
                a, b = x[:, :n_left], x[:, n_left:]
                now = np.array(
                    [
                        np.full((n_left, n_right), len(x)),
                        np.broadcast_to(a.sum(0)[:, None], (n_left, n_right)),
                        np.broadcast_to(b.sum(0)[None, :], (n_left, n_right)),
                        np.broadcast_to((a * a).sum(0)[:, None], (n_left, n_right)),
                        np.broadcast_to((b * b).sum(0)[None, :], (n_left, n_right)),
                        a.T @ b,
                    ]
                )
                totals[key] = totals.get(key, 0) + now
        i, j = np.indices((n_left, n_right)).reshape(2, -1)
        for key, t in totals.items():
            flat = t.reshape(6, -1)
            out = {"i": i, "j": j, "n": flat[0], "sa": flat[1], "sb": flat[2], "saa": flat[3], "sbb": flat[4], "sab": flat[5]}
            yield pd.DataFrame(({run: [key] * len(i)} if run else {}) | out)

    kind = f"{run} {design.schema[run].dataType.simpleString()}, " if run else ""
    schema = kind + "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double"
    parts = design.select(*keys, *[F.col(c).cast("double") for c in columns]).mapInPandas(sums, schema)
    total = parts.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    spread = F.sqrt(F.greatest(n * F.col("saa") - sa * sa, F.lit(0.0))) * F.sqrt(
        F.greatest(n * F.col("sbb") - sb * sb, F.lit(0.0))
    )
    return total.select(
        *keys,
        F.lit(list(reference))[F.col("i")].alias("reference"),
        F.lit(list(predicted))[F.col("j")].alias("predicted"),
        F.try_divide(n * F.col("sab") - sa * sb, spread).alias("correlation"),
    )


def best_assignment(scores: np.ndarray) -> list[int]:
    """Column matched to each row of a square matrix, maximizing the total score.

    Rows are added one by one along the cheapest path of reassignments, O(n^3).
    """
    cost = -np.asarray(scores, dtype=np.float64)
    size = len(cost)
    row_of = np.full(size, -1)
    row_price, col_price = np.zeros(size), np.zeros(size)
    for new in range(size):
        reach = cost[new] - row_price[new] - col_price
        came_from = np.full(size, new)
        settled = np.zeros(size, dtype=bool)
        while True:
            column = int(np.argmin(np.where(settled, np.inf, reach)))
            length = reach[column]
            settled[column] = True
            row = row_of[column]
            if row < 0:
                break
            through = length + cost[row] - row_price[row] - col_price
            shorter = ~settled & (through < reach)
            reach[shorter], came_from[shorter] = through[shorter], row
        gain = np.where(settled, length - reach, 0.0)
        col_price -= gain
        row_price[new] += length
        inner = settled & (row_of >= 0)
        row_price[row_of[inner]] += gain[inner]
        while column >= 0:
            row = came_from[column]
            previous = np.flatnonzero(row_of == row)
            row_of[column] = row
            column = int(previous[0]) if row != new else -1
    match = np.empty(size, dtype=int)
    match[row_of] = np.arange(size)
    return match.tolist()


def match_concepts(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """One-to-one matching of reference to predicted concepts for every evaluation run.

    ``scores(run, reference, predicted, similarity)`` with equally many of both per run.
    One run is H x H scores, bounded by the number of concepts; runs are spread over the
    cluster.
    """
    kind = scores.schema[run].dataType.simpleString()

    def match(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot(index="reference", columns="predicted", values="similarity")
        if table.shape[0] != table.shape[1]:
            raise ValueError(f"run {group[run].iloc[0]}: {table.shape[0]} against {table.shape[1]} concepts")
        values = table.to_numpy(dtype=np.float64)
        if np.isnan(values).any():
            raise ValueError(f"run {group[run].iloc[0]}: a pair has no similarity")
        columns = best_assignment(values)
        return pd.DataFrame(
            {
                run: group[run].iloc[0],
                "reference": table.index,
                "predicted": table.columns[columns],
                "similarity": values[np.arange(len(columns)), columns],
            }
        )

    return scores.select(run, "reference", "predicted", "similarity").groupBy(run).applyInPandas(
        match, f"{run} {kind}, reference string, predicted string, similarity double"
    )
