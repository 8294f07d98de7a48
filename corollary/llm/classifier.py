"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators are scaled by the log ratio of their class counts, counted over all labelled training rows, and a linear
hinge-loss model over the scaled rows is fitted by dual coordinate descent on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corollary.llm.common import labels_by_id, small_side

#: Buckets of hashed n-grams, a power of two; most labelled rows that the linear model is fitted on.
BUCKETS = 1 << 17
SAMPLE_ROWS = 8192
#: Cost of a unit of hinge loss, passes of coordinate descent at most, largest violation at which it ends.
COST, PASSES, TOLERANCE = 1.0, 60, 1e-3
#: Score from which a text is predicted to be of class 1; share of rows held out, one in so many.
CUT = 0.3
FOLDS = 5

#: Classes of bytes for the shape of a word: upper case, digit, other ASCII letter or byte of a longer character, the rest as it is.
SHAPES = bytes(
    ord("X") if 65 <= b <= 90 else ord("d") if 48 <= b <= 57 else ord("x") if 97 <= b <= 122 or b >= 128 else b for b in range(256)
)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def indicators(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams.

    Three streams are read over the whole text: words (one and two), shapes of words (one and two), and whether a word is
    the one before it again (four in a row).
    """
    number: dict[bytes, int] = {}
    found = text.encode().split()  # on bytes this splits at 20, 09-0D and nowhere else
    if not found:
        return np.zeros(0, np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    streams = []
    shaped = [w.translate(SHAPES) for w in number]
    for salt, hashes in enumerate((
        np.fromiter(map(crc32, number), np.uint64, len(number)),
        np.fromiter((crc32(s[:1] + s[-3:]) for s in shaped), np.uint64, len(number)),
    )):
        h = hashes[ids] + (np.uint64(salt) << np.uint64(33))
        streams += [h * MIX[0], (h[:-1] * MIX[0] + h[1:] * MIX[1] + np.uint64(1)) * MIX[2]]
    same = np.zeros(len(ids) + 3, np.uint64)
    same[4:] = ids[1:] == ids[:-1]
    runs = same[:-3] * np.uint64(8) + same[1:-2] * np.uint64(4) + same[2:-1] * np.uint64(2) + same[3:] + np.uint64(1 << 40)
    streams.append(runs * MIX[3])
    return np.unique(np.concatenate([s >> shift for s in streams])).astype(np.int64)


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' shares of each bucket, one added to every count."""
    p, q = good + 1.0, bad + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and offset that minimize |w|^2 / 2 + cost * sum of hinge losses, by dual coordinate descent.

    ``rows`` are indicator buckets, scaled by ``ratios`` and to unit length; ``y`` is -1 or 1. The order of each pass is
    drawn with a fixed seed.
    """
    weights, offset = np.zeros(len(ratios)), 0.0
    values = []
    for row in rows:
        v = ratios[row]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)):
            row, v = rows[i], values[i]
            gradient = y[i] * (weights[row] @ v + offset) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)  # a row of length 1 and the offset's 1
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                weights[row] += step * v
                offset += step
        if worst < TOLERANCE:
            break
    return weights, offset


def margins(rows: list[np.ndarray], weights: np.ndarray, offset: float, ratios: np.ndarray) -> np.ndarray:
    """Signed distance of each row; a text without n-grams has the offset alone."""
    out = np.full(len(rows), offset)
    for i, row in enumerate(rows):
        if len(row):
            v = ratios[row]
            out[i] += weights[row] @ v / max(np.sqrt((v * v).sum()), 1e-12)
    return out


def fit_sigmoid(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the share of class 1, by Newton's method on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones(len(m))])
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = b @ x
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -500, 500)))
        gradient = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass(frozen=True)
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, text: Column | str) -> Column:
        """Score of a text column, 0 to 1; null is an empty text."""
        ratios, weights = self.ratios.astype(np.float32), self.weights.astype(np.float32)
        offset, slope, shift = self.offset, self.slope, self.shift

        @arrow_udf("double")
        def of(column: pa.Array) -> pa.Array:
            scores = []
            for t in column:
                m = margins([indicators(t.as_py() or "", len(ratios))], weights, offset, ratios)[0]
                scores.append(1 / (1 + np.exp(-np.clip(slope * float(m) + shift, -500, 500))))
            return pa.array(scores, pa.float64())

        return of(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def class_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per class (0, 1) and bucket, the number of rows of ``text``, ``label`` that hold it; every task adds up its own."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[label, indicators(t.as_py() or "", buckets)] += 1
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "bad": total[0][at], "good": total[1][at]})

    sums = (
        texts.select("text", "label").mapInArrow(add_up, "bucket int, bad long, good long")
        .groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    )
    out = np.zeros((2, buckets), np.int64)
    out[0, sums["bucket"]], out[1, sums["bucket"]] = sums["bad"], sums["good"]
    return out


def fit(labelled: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit a model on rows of ``id``, ``text``, ``label`` (0 or 1).

    Class counts read all rows. The linear model reads the ``sample_rows`` rows whose ids hash lowest, in one task,
    and its scores are calibrated on the same rows. Without rows of both classes every text scores the share of class 1, with one row of each class added.
    """
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return QualityModel(np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, float(np.log(share / (1 - share))))
    bad, good = class_counts(labelled, buckets)
    ratios = log_count_ratios(good, bad)
    chosen = F.broadcast(labelled.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # bounded by sample_rows

    @arrow_udf("array<int>")
    def rows_of(column: pa.Array) -> pa.Array:
        return pa.array([indicators(t.as_py() or "", buckets) for t in column], pa.list_(pa.int32()))

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("id", "ascending")])
        y = np.where(np.array(group.column("label").to_pylist()) == 1, 1.0, -1.0)
        rows = [np.array(r, np.int64) for r in group.column("row").to_pylist()]
        weights, offset = fit_hinge(rows, y, ratios)
        slope, shift = fit_sigmoid(margins(rows, weights, offset, ratios), y)
        return pa.table({"weights": pa.array([weights.tobytes()]), "offset": [offset], "slope": [slope], "shift": [shift]})

    sample = labelled.join(chosen, "id", "left_semi").select(
        "id", "label", F.xxhash64("id").alias("at"), rows_of(F.coalesce("text", F.lit(""))).alias("row"), F.lit(0).alias("one")
    )
    solved = sample.groupBy("one").applyInArrow(solve, "weights binary, offset double, slope double, shift double").first()
    return QualityModel(ratios, np.frombuffer(solved["weights"], np.float64), solved["offset"], solved["slope"], solved["shift"])


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    """Whether the id's CRC-32 is a multiple of ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label: str = "quality", folds: int = FOLDS,
    cut: float = CUT, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: the id, ``held_out``, ``score`` and ``predicted``.

    The model learns from labelled documents that are not held out, and from nothing but their texts. Null and empty texts have
    no n-grams; they learn and are scored as such. Repeated documents are rows of their own; of repeated labels of an id the
    larger counts; labels that are null, not 0 or 1, or of no document are not used. A null id has no label and isn't held out. An
    empty table gives an empty result; without labels of both classes all texts score the share of class 1. Other columns are not read.
    """
    known = small_side(labels_by_id(labels, label).where("__label in (0, 1)"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = own.where(~held_out("id", folds)).join(known, F.col("id") == F.col("__id")).select("id", "text", F.col("__label").alias("label"))
    model = fit(labelled, buckets, sample_rows)
    scored = docs.select(F.col(id_col), held_out(id_col, folds).alias("held_out"), model.score(text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
