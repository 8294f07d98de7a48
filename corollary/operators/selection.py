"""Choosing features that predict a target, from sparse activations."""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corollary.operators import ranking, sampling
from corollary.session import collect_dimension, cut_lineage, ensure_checkpoint_dir

#: Scores are compared after rounding to so many digits below the largest, so that summation order
#: cannot reorder ties.
RANK_DIGITS = 9
#: A coefficient counts as nonzero above this share of the largest.
NONZERO = 1e-8
#: Features up to which linear fits work on one matrix of sums, of 8 bytes for each pair.
GRAM_FEATURES = 4_096
# The bounds and length of the regularization search
ALPHA_LOW, ALPHA_HIGH, ALPHA_FITS = 1e-6, 1e4, 20
#: Extra rows read by id order when thin features need zero rows, and rows that are read for that at most.
PAD_ROWS, WIDEST = 10_000, 10_000_000


def with_target(acts: DataFrame, targets: DataFrame) -> DataFrame:
    """Activations with their row's ``y``; no join if the target was carried along."""
    if "y" in acts.columns:
        return acts
    joined = acts.join(targets.select("row_id", F.col("y"), F.lit(True).alias("_has_target")), "row_id", "left")
    found = F.coalesce("_has_target", F.raise_error(F.lit("an activation's row has no target")).cast("boolean"))
    return joined.filter(found).drop("_has_target")


def rank_scores(scores: DataFrame, n_select: int, *, by: Column | None = None) -> DataFrame:
    """Best ``n_select`` rows of ``neuron_idx, score`` as ``neuron_idx, score, rank``.

    By absolute score unless ``by`` is given; NULL scores come last.
    """
    finite = scores.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    largest = F.nullif(finite.agg(F.max(F.abs("score"))).scalar(), F.lit(0.0))
    key = (F.abs("score") if by is None else by) / F.coalesce(largest, F.lit(1.0))
    order = [F.round(key, RANK_DIGITS).desc_nulls_last(), F.asc("neuron_idx")]
    best = scores.select("neuron_idx", "score").orderBy(*order).limit(n_select)
    # at most n_select rows, already bounded by the number of neurons
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _all_neurons(per: DataFrame, neurons: DataFrame | None) -> DataFrame:
    """Give features without any activation their (empty) row."""
    return per if neurons is None else neurons.select("neuron_idx").join(per, "neuron_idx", "left")


def moments(acts: DataFrame, targets: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per-feature sums over active rows beside the sums over all rows; one shuffle of sums."""
    y = F.col("y").cast("double")
    a = F.col("activation")
    per = (
        with_target(acts, targets)
        .groupBy("neuron_idx")
        .agg(
            F.count("*").alias("n_active"),
            F.sum(a).alias("sum_a"),
            F.sum(a * a).alias("sum_aa"),
            F.sum(a * y).alias("sum_ay"),
            F.sum(y).alias("sum_y_active"),
            *[column.alias(name) for name, column in (extra or {}).items()],
        )
    )
    totals = targets.agg(
        F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy")
    )
    return per.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def correlation_scores(acts: DataFrame, targets: DataFrame, neurons: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of each feature, zeros included, with the target.

    The target is centred first, so that a large mean costs no precision in the sums.
    """
    y = F.col("y").cast("double")
    middle = targets.agg(F.avg(y)).scalar()
    centred = targets.select("row_id", (y - middle).alias("y"))
    carried = acts.withColumn("y", y - middle) if "y" in acts.columns else acts
    n, sa, sy = F.col("n"), F.col("sum_a"), F.col("sum_y")
    spread_a = F.greatest(n * F.col("sum_aa") - sa * sa, F.lit(0.0))
    spread_y = F.greatest(n * F.col("sum_yy") - sy * sy, F.lit(0.0))
    score = F.try_divide(n * F.col("sum_ay") - sa * sy, F.sqrt(spread_a) * F.sqrt(spread_y))
    per = moments(carried, centred).select("neuron_idx", score.alias("score"))
    return _all_neurons(per, neurons)


def select_correlation(acts, targets, n_select, *, neurons=None) -> DataFrame:
    return rank_scores(correlation_scores(acts, targets, neurons), n_select)


def separation_scores(
    acts: DataFrame,
    targets: DataFrame,
    neurons: DataFrame,
    *,
    n_top_activating: int = 100,
    n_zero_activating: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Mean target of the highest-activating rows minus that of the zero rows.

    A feature with fewer positives than ``n_top_activating`` is topped up with zero rows
    of lowest ``row_id`` and then with its largest negatives.
    """
    y = F.col("y").cast("double")
    a = with_target(acts, targets).select("neuron_idx", "row_id", "activation", y.alias("y"))
    per = a.groupBy("neuron_idx").agg(
        F.count("*").alias("n_active"),
        F.count_if(F.col("activation") > 0).alias("n_pos"),
        F.sum("y").alias("sum_y_active"),
    )
    per = neurons.select("neuron_idx").join(per, "neuron_idx", "left").na.fill(0)
    n, sum_y = targets.agg(F.count("*"), F.sum(y)).first()
    per = per.withColumn("n_zero", F.lit(n) - F.col("n_active"))

    order = [F.desc("activation"), F.asc("row_id")]
    top = ranking.top_n_per_group(a, ["neuron_idx"], order, n_top_activating, salt_on="row_id")
    place = F.when(F.col("activation") > 0, F.col("rank")).otherwise(F.col("rank") + F.col("n_zero"))
    top = (
        top.join(F.broadcast(per.select("neuron_idx", "n_zero")), "neuron_idx")
        .filter(place <= n_top_activating)
        .select("neuron_idx", "y")
    )
    parts = [top]
    thin = collect_dimension(
        per.filter((F.col("n_pos") < n_top_activating) & (F.col("n_zero") > 0)).select(
            "neuron_idx",
            (F.lit(n_top_activating) - F.col("n_pos")).alias("need"),
            (F.col("n_active") - F.col("n_pos")).alias("n_neg"),
            "n_zero",
        )
    )
    if thin:
        parts.append(_lowest_zero_rows(a, targets, thin, n_top_activating))
    top_mean = ranking.union_all(parts).groupBy("neuron_idx").agg(F.avg("y").alias("top_mean"))
    if n_zero_activating is None:
        zero = per.select(
            "neuron_idx",
            F.try_divide(F.lit(sum_y) - F.col("sum_y_active"), F.col("n_zero")).alias("zero_mean"),
        )
    else:
        wanted = [r[0] for r in collect_dimension(per.select("neuron_idx"))]
        chosen = sampling.zero_rows(a, targets, wanted, n_zero_activating, seed)
        if len(wanted) * n_zero_activating <= sampling.BROADCAST_EXAMPLES:
            chosen = F.broadcast(chosen)
        zero = (
            targets.select("row_id", y.alias("y"))
            .join(chosen, "row_id")
            .groupBy("neuron_idx")
            .agg(F.avg("y").alias("zero_mean"))
        )
    return (
        per.select("neuron_idx")
        .join(top_mean, "neuron_idx", "left")
        .join(zero, "neuron_idx", "left")
        .select("neuron_idx", (F.col("top_mean") - F.col("zero_mean")).alias("score"))
    )


def _lowest_zero_rows(acts: DataFrame, targets: DataFrame, thin: list, n_top: int) -> DataFrame:
    """``neuron_idx, y`` of the lowest-id zero rows each thin feature still needs.

    Among the first ``n_top + q`` rows by id a feature with ``q`` negatives and fewer
    than ``n_top`` positives has all the zero rows it needs, so those few rows suffice.
    """
    rows = targets.select("row_id", F.col("y").cast("double").alias("y"))
    few = [r for r in thin if r["n_neg"] <= PAD_ROWS]
    wide = [r for r in thin if r["n_neg"] > PAD_ROWS]
    frames = []
    if few:
        first = rows.orderBy("row_id").limit(n_top + max(r["n_neg"] for r in few))
        zeros = _zero_rows_among(acts, first, [r["neuron_idx"] for r in few], n_top)
        needs = acts.sparkSession.createDataFrame([(r["neuron_idx"], r["need"]) for r in few], "neuron_idx int, need long")
        frames.append(zeros.join(F.broadcast(needs), "neuron_idx").filter(F.col("rank") <= F.col("need")).select("neuron_idx", "y"))
    if wide:
        frames.append(_zero_rows_of_wide(acts, rows, wide, n_top))
    return ranking.union_all(frames)


def _zero_rows_among(acts: DataFrame, first: DataFrame, neurons: list[int], n_top: int) -> DataFrame:
    """``neuron_idx, row_id, y, rank`` of the zero rows among a few rows, lowest first."""
    ids = first.select("row_id")
    mine = acts.filter(F.col("neuron_idx").isin(neurons)).select("neuron_idx", "row_id")
    mine = mine.join(F.broadcast(ids), "row_id", "left_semi")
    zeros = first.withColumn("neuron_idx", F.explode(F.lit(neurons))).join(mine, ["neuron_idx", "row_id"], "left_anti")
    return ranking.top_n_per_group(zeros, ["neuron_idx"], [F.asc("row_id")], n_top, salt_on="row_id")


def _zero_rows_of_wide(acts: DataFrame, rows: DataFrame, wide: list, n_top: int) -> DataFrame:
    """The same for features with very many negatives.

    The first rows by id are searched, eight times as many each time, until a feature has what it needs. One that still
    lacks some when that is ``WIDEST`` rows, or more than its zero rows, gets those from the rows' lists of
    active features, so rows × features is never formed.
    """
    frames, opened, reach = [], {r["neuron_idx"]: r for r in wide}, n_top + PAD_ROWS
    while opened:
        need = {i: min(r["need"], r["n_zero"]) for i, r in opened.items()}
        listed = [i for i, r in opened.items() if reach > min(WIDEST, r["n_zero"])]
        near = [i for i in opened if i not in listed]
        found = []
        if near:
            found.append(_zero_rows_among(acts, rows.orderBy("row_id").limit(reach), near, n_top).select("neuron_idx", "row_id", "y", "rank"))
        if listed:
            zeros = sampling.all_zero_rows(acts, rows, listed)
            lowest = ranking.top_n_per_group(zeros, ["neuron_idx"], [F.asc("row_id")], n_top, salt_on="row_id")
            found.append(rows.join(F.broadcast(lowest), "row_id").select("neuron_idx", "row_id", "y", "rank"))
        # at most n_top rows per feature; written down because they are counted and then used
        zeros = cut_lineage(ranking.union_all(found))
        counts = {r[0]: r[1] for r in zeros.groupBy("neuron_idx").count().collect()}
        done = [i for i in opened if i in listed or counts.get(i, 0) >= need[i]]
        if done:
            needs = acts.sparkSession.createDataFrame([(i, need[i]) for i in done], "neuron_idx int, need long")
            frames.append(zeros.join(F.broadcast(needs), "neuron_idx").filter(F.col("rank") <= F.col("need")).select("neuron_idx", "y"))
        opened = {i: r for i, r in opened.items() if i not in done}
        reach *= 8
    return ranking.union_all(frames)


def select_separation(acts, targets, n_select, *, neurons, **kwargs) -> DataFrame:
    return rank_scores(separation_scores(acts, targets, neurons, **kwargs), n_select)


def feature_scales(acts: DataFrame, rows: DataFrame) -> DataFrame:
    """``neuron_idx, mean, scale`` over all rows, zeros included; constant feature: scale 1."""
    total = rows.agg(F.count("*").cast("double"))
    a = F.col("activation")
    per = acts.groupBy("neuron_idx").agg(F.sum(a).alias("sa"), F.sum(a * a).alias("saa"))
    n = total.scalar()
    mean = F.col("sa") / n
    variance = F.greatest(F.col("saa") / n - mean * mean, F.lit(0.0))
    return per.select(
        "neuron_idx",
        mean.alias("mean"),
        F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0)).alias("scale"),
    )


def feature_vectors(acts: DataFrame, targets: DataFrame, n_neurons: int) -> DataFrame:
    """``label, features``: one scaled sparse vector per row, all-zero rows included.

    Features are divided by their deviation only; the intercept of the fit absorbs the
    means, which keeps the vectors sparse. A row holds at most K entries per model.
    """

    scales = feature_scales(acts, targets).select("neuron_idx", "scale")
    entries = (
        acts.select("row_id", "neuron_idx", "activation")
        .join(F.broadcast(scales), "neuron_idx")
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("neuron_idx", (F.col("activation") / F.col("scale")).alias("v")))).alias("e"))
    )
    # Spark has no expression that makes sparse vectors; its reader of this text format does, without Python rows.
    cells = F.transform("e", lambda e: F.concat((e["neuron_idx"] + 1).cast("string"), F.lit(":"), e["v"].cast("string")))
    line = F.concat_ws(" ", F.col("y").cast("double").cast("string"), F.array_join(cells, " "))
    spark = acts.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    targets.join(entries, "row_id", "left").select(line).write.text(path)
    return spark.read.format("libsvm").option("numFeatures", n_neurons).load(path)


@dataclass
class SparseFit:
    """Coefficients of one L1 fit and the penalty they belong to."""

    alpha: float
    coefficients: list[float]

    @property
    def n_nonzero(self) -> int:
        least = NONZERO * max(map(abs, self.coefficients), default=0.0)
        return sum(abs(c) > least for c in self.coefficients)


def fit_l1(vectors: DataFrame, alpha: float, n_rows: int, *, classification: bool, max_iter: int = 1000) -> SparseFit:
    """One L1-penalized fit: squared loss, or logistic loss under classification."""
    if classification:
        estimator = LogisticRegression(
            elasticNetParam=1.0, regParam=alpha / n_rows, standardization=False, maxIter=max_iter, tol=1e-10
        )
    else:
        # up to 4,096 features Spark solves this from one pass of sums
        estimator = LinearRegression(
            elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=max_iter, tol=1e-10
        )
    return SparseFit(alpha, [float(c) for c in estimator.fit(vectors).coefficients])


@dataclass
class LinearSums:
    """All that linear fits need of the rows: covariances of the scaled features with each other and with the target."""

    covariance: np.ndarray
    pull: np.ndarray

    def fit(self, alpha: float, start: SparseFit | None = None, max_iter: int = 1000) -> SparseFit:
        """Least squares with an L1 penalty by coordinate descent, from the coefficients of an earlier fit.

        Features that the strong rule sets aside (their pull on the residual can hardly reach the new
        penalty) are left out at first; those that break the optimality condition in the end are taken in.
        """
        weights = np.zeros(len(self.pull)) if start is None else np.array(start.coefficients)
        before = max(np.abs(self.pull).max(initial=0.0), alpha) if start is None else start.alpha
        rest = self.pull - self.covariance @ weights
        size = np.diag(self.covariance)
        inside = (size > 0) & ((weights != 0) | (np.abs(rest) >= 2 * alpha - before))
        limit = 1e-13 * max(np.abs(self.pull).max(initial=0.0), 1e-300)
        while True:
            for _ in range(max_iter):
                largest = 0.0
                for j in np.flatnonzero(inside):
                    reach = rest[j] + size[j] * weights[j]
                    new = np.sign(reach) * max(abs(reach) - alpha, 0.0) / size[j]
                    if new != weights[j]:
                        rest -= self.covariance[:, j] * (new - weights[j])
                        largest = max(largest, size[j] * abs(new - weights[j]))
                        weights[j] = new
                if largest <= limit:
                    break
            broken = (size > 0) & ~inside & (np.abs(rest) > alpha * (1 + 1e-12))
            if not broken.any():
                return SparseFit(alpha, [float(w) for w in weights])
            inside |= broken


def linear_sums(acts: DataFrame, targets: DataFrame, width: int) -> LinearSums:
    """Sums of products of all features' activations, and with the target, in one pass over the rows' lists of active features.

    The target is centred first, so that a large mean costs no precision.
    """
    y = F.col("y").cast("double")
    n, mean = targets.agg(F.count("*"), F.avg(y)).first()
    entries = F.array_sort(F.collect_list(F.struct("neuron_idx", "activation")))  # at most K entries a row and model
    rows = with_target(acts, targets).groupBy("row_id").agg(entries.alias("e"), (F.first(y) - F.lit(mean)).alias("y"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, lone = np.zeros(width * width), np.zeros((2, width))
        for batch in batches:
            column, target = batch.column("e"), batch.column("y").to_numpy(zero_copy_only=False)
            lengths = np.asarray(column.value_lengths())
            index, values = (np.zeros((len(lengths), lengths.max(initial=0)), kind) for kind in (np.int64, np.float64))
            there = np.arange(index.shape[1]) < lengths[:, None]
            flat = column.flatten()
            index[there], values[there] = flat.field("neuron_idx").to_numpy(), flat.field("activation").to_numpy()
            for p in range(index.shape[1]):
                np.add.at(lone[0], index[:, p], values[:, p])
                np.add.at(lone[1], index[:, p], values[:, p] * target)
                for q in range(p, index.shape[1]):
                    np.add.at(products, index[:, p] * width + index[:, q], values[:, p] * values[:, q])
        for kind, sums in ((0, products), (1, lone[0]), (2, lone[1])):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), kind, np.int32)), "at": at, "s": sums[at]})

    sums = rows.select("e", "y").mapInArrow(add_up, "kind int, at long, s double").groupBy("kind", "at").agg(F.sum("s").alias("s")).toArrow()
    kind, at, s = (sums.column(c).to_numpy() for c in ("kind", "at", "s"))
    total = [np.zeros(size) for size in (width * width, width, width)]
    for k in range(3):
        total[k][at[kind == k]] = s[kind == k]
    upper = total[0].reshape(width, width)
    centre = total[1] / n
    covariance = (np.triu(upper) + np.triu(upper, 1).T) / n - np.outer(centre, centre)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    scale = np.where(spread > 0, spread, 1.0)
    covariance = covariance / np.outer(scale, scale)
    constant = spread == 0
    covariance[constant], covariance[:, constant] = 0.0, 0.0
    return LinearSums(covariance, np.where(constant, 0.0, total[2] / n / scale))


def search_alpha(fit: Callable[[float], SparseFit], n_select: int) -> SparseFit:
    """Bisect the penalty on a log scale until exactly ``n_select`` features remain."""
    low, high = ALPHA_LOW, ALPHA_HIGH
    for _ in range(ALPHA_FITS):
        result = fit(math.sqrt(low * high))
        if result.n_nonzero == n_select:
            return result
        if result.n_nonzero < n_select:
            high = result.alpha
        else:
            low = result.alpha
    warnings.warn(f"search ended with {result.n_nonzero} features instead of {n_select}", stacklevel=2)
    return result


def select_lasso(
    acts, targets, n_select, *, neurons, classification=False, alpha=None, max_iter=1000
) -> DataFrame:
    """Features with the largest L1 coefficients.

    Linear fits of up to ``GRAM_FEATURES`` features share one matrix of sums, each going on from the one before; other fits
    share one kept table of vectors.
    """
    spark = acts.sparkSession
    width = neurons.agg(F.max("neuron_idx")).first()[0] + 1
    if not classification and width <= GRAM_FEATURES:
        sums, last = linear_sums(acts, targets, width), None

        def fit(value):
            nonlocal last
            last = sums.fit(value, last, max_iter)
            return last

        result = fit(alpha) if alpha is not None else search_alpha(fit, n_select)
    else:
        vectors = feature_vectors(acts, targets, width).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n_rows = vectors.count()

            def fit(value):
                return fit_l1(vectors, value, n_rows, classification=classification, max_iter=max_iter)

            result = fit(alpha) if alpha is not None else search_alpha(fit, n_select)
        finally:
            vectors.unpersist()
    scores = spark.createDataFrame(list(enumerate(result.coefficients)), "neuron_idx int, score double")
    return rank_scores(scores, n_select)


def rank_moments(acts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per-feature sums of ranks, beside those of :func:`moments`, for metrics that depend on order only.

    Ranks run from 1 at the lowest over all rows, zero rows included, ties sharing their mean rank. ``rank_y`` sums a
    row's rank by activation times its target, ``rank_rank`` that times its rank by target; ``rank_2`` and ``target_rank_2`` are the
    sums of both ranks' squares. Equal activations of a feature are one row, ranked by levels; its zero rows
    are one tie, whose sums follow from those over all rows.
    """
    y = F.col("y").cast("double")
    levels = targets.groupBy(y.alias("y")).agg(F.count("*").alias("w"))
    n = targets.agg(F.count("*").cast("double")).first()[0]
    middle = F.lit(n) - F.col("above_w") - F.col("w") + (F.col("w") + 1) / 2
    places = ranking.running_totals(levels, "y", ["w"]).select("y", middle.alias("place"), "w")
    sum_y, rank_sum, squares = places.agg(F.sum(F.col("y") * F.col("w")), F.sum(F.col("place") * F.col("w")), F.sum(F.col("place") * F.col("place") * F.col("w"))).first()
    active = with_target(acts, targets).select("neuron_idx", "activation", y.alias("y")).join(places.select("y", "place"), "y")
    pooled = active.groupBy("neuron_idx", "activation").agg(
        F.count("*").alias("w"), F.sum("y").alias("sy"), F.sum("place").alias("sp")
    )
    per = pooled.groupBy("neuron_idx").agg(
        F.sum("w").alias("n_active"), F.coalesce(F.sum(F.when(F.col("activation") > 0, F.col("w"))), F.lit(0)).alias("n_positive")
    )
    n_zero = F.lit(n) - F.col("n_active")
    ranked = ranking.running_totals(pooled, "activation", ["w"], by=["neuron_idx"]).join(F.broadcast(per), "neuron_idx")  # one row per feature
    above = F.col("above_w") + F.when(F.col("activation") > 0, F.lit(0)).otherwise(n_zero)
    ranked = ranked.withColumn("r", F.lit(n) - above - F.col("w") + (F.col("w") + 1) / 2)
    sums = ranked.groupBy("neuron_idx", "n_active", "n_positive").agg(
        F.sum(F.col("r") * F.col("sy")).alias("ry"), F.sum(F.col("r") * F.col("sp")).alias("rp"),
        F.sum(F.col("r") * F.col("r") * F.col("w")).alias("r2"), F.sum("sy").alias("sy"), F.sum("sp").alias("sp"),
    )
    zero = F.lit(n) - F.col("n_positive") - n_zero + (n_zero + 1) / 2
    return sums.select(
        "neuron_idx",
        (F.col("ry") + zero * (F.lit(sum_y) - F.col("sy"))).alias("rank_y"),
        (F.col("rp") + zero * (F.lit(rank_sum) - F.col("sp"))).alias("rank_rank"),
        (F.col("r2") + zero * zero * n_zero).alias("rank_2"),
        F.lit(squares).alias("target_rank_2"),
    )


def auroc(col: Callable[[str], Column]) -> Column:
    """A metric for :func:`select_custom` with ``ranks``: the share of pairs of a 1 and a 0 that the activation puts in order."""
    ones = col("sum_y")
    return F.try_divide(col("rank_y") - ones * (ones + 1) / 2, ones * (col("n") - ones))


def spearman(col: Callable[[str], Column]) -> Column:
    """A metric for :func:`select_custom` with ``ranks``: the correlation of both ranks."""
    n = col("n").cast("double")
    square = n * (n + 1) * (n + 1) / 4
    return F.try_divide(col("rank_rank") - square, F.sqrt(F.greatest(col("rank_2") - square, F.lit(0.0)) * F.greatest(col("target_rank_2") - square, F.lit(0.0))))


def select_custom(
    acts: DataFrame,
    targets: DataFrame,
    n_select: int,
    *,
    metric_fn: Callable[[Callable[[str], Column]], Column],
    neurons: DataFrame | None = None,
    extra: dict[str, Column] | None = None,
    ranks: bool = False,
) -> DataFrame:
    """Features with the largest raw value of a user's metric, ascending.

    ``metric_fn(col)`` builds a Column from the sums :func:`moments` yields and from the
    ``extra`` aggregates, which run over the active rows with ``activation`` and ``y``; with ``ranks`` also from
    those of :func:`rank_moments`, as :func:`auroc` and :func:`spearman` do.
    What the zero rows add follows from the sums over all rows, so no feature's column
    is ever laid out whole.
    """
    sums = moments(acts, targets, extra)
    if ranks:
        sums = sums.join(rank_moments(acts, targets), "neuron_idx")
    scores = sums.select("neuron_idx", metric_fn(F.col).alias("score"))
    scores = _all_neurons(scores, neurons).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return rank_scores(scores, n_select, by=F.col("score")).orderBy(F.desc("rank"))


METHODS: dict[str, Callable] = {
    "lasso": select_lasso,
    "correlation": select_correlation,
    "separation_score": select_separation,
    "custom": select_custom,
}


def select_neurons(
    acts: DataFrame,
    targets: DataFrame,
    n_select: int,
    *,
    neurons: DataFrame,
    method: str = "lasso",
    classification: bool = False,
    **kwargs,
) -> DataFrame:
    """``neuron_idx, score, rank`` of the chosen features by the named method."""
    if method not in METHODS:
        raise ValueError(f"unknown selection method: {method}")
    if method == "custom" and "metric_fn" not in kwargs:
        raise ValueError("the custom method needs metric_fn")
    if classification and count_classes(targets).first()["n_classes"] > 2:
        raise ValueError("classification needs a target with at most 2 classes")
    total = neurons.count()
    if n_select > total:
        raise ValueError(f"n_select ({n_select}) exceeds the number of features ({total})")
    if method == "lasso":
        kwargs["classification"] = classification
    return METHODS[method](acts, targets, n_select, neurons=neurons, **kwargs)


def count_classes(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count_distinct("y").alias("n_classes"))
