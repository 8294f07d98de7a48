"""Sparse features of vectors: inference, reconstruction, errors, initial statistics.

Activations are kept as a long sparse table ``(row_id, neuron_idx, activation)`` that
holds nonzeros only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corollary.operators import ranking
from corollary.session import BROADCAST_BYTES, cut_lineage

#: Cells of one dense block inside a task (rows x neurons or dimensions).
BLOCK_CELLS = 1 << 24


@dataclass
class FeatureModel:
    """A top-K sparse autoencoder. ``enc`` and ``dec`` are ``(M, D)``, row = neuron."""

    enc: np.ndarray
    dec: np.ndarray
    neuron_bias: np.ndarray
    input_bias: np.ndarray
    k: int
    aux_k: int | None = None
    multi_k: int | None = None
    dead_threshold: int = 256
    prefixes: list[int] | None = None
    steps_since_active: np.ndarray | None = None
    fingerprint: str | None = None
    history: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("enc", "dec", "neuron_bias", "input_bias"):
            setattr(self, name, np.asarray(getattr(self, name), dtype=np.float64))
        if not 0 < self.k <= self.m:
            raise ValueError("k must be between 1 and the number of neurons")
        if self.aux_k is None:
            self.aux_k = min(2 * self.k, self.m)
        check_prefixes(self.prefixes, self.m)
        if self.steps_since_active is None:
            self.steps_since_active = np.zeros(self.m, dtype=np.int64)

    @property
    def m(self) -> int:
        return self.enc.shape[0]

    @property
    def dim(self) -> int:
        return self.enc.shape[1]

    def dead(self) -> np.ndarray:
        return self.steps_since_active > self.dead_threshold


def check_prefixes(prefixes: Sequence[int] | None, m: int) -> None:
    if prefixes is None:
        return
    if prefixes[-1] != m:
        raise ValueError("the last prefix must equal the number of neurons")
    if any(b <= a for a, b in zip(prefixes[:-1], prefixes[1:])):
        raise ValueError("prefixes must be strictly increasing")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Dense float64 matrix of a list column whose rows all have one length."""
    flat = column.flatten()
    if flat.null_count or column.null_count:
        raise ValueError("vectors must not be or contain NULL")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_k(pre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise indices and values of the ``k`` largest entries, ties to the lower index."""
    if k >= pre.shape[1]:
        index = np.broadcast_to(np.arange(pre.shape[1]), pre.shape)
        return index, pre
    index = np.argpartition(-pre, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(pre, index, axis=1)
    # a tie across the cut is settled in favour of the lower index
    cut = values.min(axis=1, keepdims=True)
    tied = (pre == cut).sum(axis=1) > (values == cut).sum(axis=1)
    if tied.any():
        index[tied] = np.argsort(-pre[tied], axis=1, kind="stable")[:, :k]
    return index, np.take_along_axis(pre, index, axis=1)


def activations(
    vectors: DataFrame,
    model: FeatureModel,
    *,
    row_id: str = "row_id",
    embedding: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Nonzero activations, ``row_id, neuron_idx, activation`` plus carried columns."""
    return many_activations(vectors, [model], row_id=row_id, embedding=embedding, carry=carry)


def many_activations(
    vectors: DataFrame,
    models: Sequence[FeatureModel],
    *,
    row_id: str = "row_id",
    embedding: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Activations of several models side by side, their neurons numbered one after the other.

    One narrow pass over the vectors for all models: the weights are broadcast, each
    Arrow batch is one matrix product per model. Columns named in ``carry`` (the target,
    say) ride along, which saves joining them to the activations later. A model whose
    weights exceed the broadcast bound is applied in neuron blocks whose top-K lists are
    then merged per row.
    """
    kept = vectors.select(F.col(row_id).cast("long").alias("row_id"), *carry, F.col(embedding).alias("_x"))
    whole, frames, shift, taken = [], [], 0, 0
    for model in models:
        per_block = max(1, BROADCAST_BYTES // (8 * model.dim))
        if model.m > per_block:
            blocks = [
                _top_k_pass(kept, [_encoder(model, shift, at, at + per_block)], positive_only=False)
                for at in range(0, model.m, per_block)
            ]
            order = [F.desc("activation"), F.asc("neuron_idx")]
            merged = ranking.top_n_per_group(ranking.union_all(blocks), ["row_id"], order, model.k)
            frames.append(merged.filter("activation > 0").drop("rank"))
        else:
            if whole and taken + 8 * model.m * model.dim > BROADCAST_BYTES:
                frames.append(_top_k_pass(kept, whole))
                whole, taken = [], 0
            whole.append(_encoder(model, shift))
            taken += 8 * model.m * model.dim
        shift += model.m
    if whole:
        frames.append(_top_k_pass(kept, whole))
    return ranking.union_all(frames)


def _encoder(model: FeatureModel, shift: int, start: int = 0, end: int | None = None) -> tuple:
    """What a task needs of a model's neurons ``start .. end``; the first is ``shift + start``."""
    enc = model.enc[start:end]
    return enc.T.copy(), model.neuron_bias[start:end], model.input_bias, min(model.k, len(enc)), shift + start


def _top_k_pass(kept: DataFrame, encoders: list[tuple], *, positive_only: bool = True) -> DataFrame:
    weights = kept.sparkSession.sparkContext.broadcast(encoders)
    schema = T.StructType(
        [
            *[f for f in kept.schema.fields if f.name != "_x"],
            T.StructField("neuron_idx", T.IntegerType()),
            T.StructField("activation", T.DoubleType()),
        ]
    )
    names = schema.names

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // max(max(enc.shape) for enc, *_ in weights.value))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix_of(part.column("_x"))
                carried = part.drop_columns(["_x"])
                for enc, bias, center, k, first in weights.value:
                    index, values = top_k((x - center) @ enc + bias, k)
                    # model order inside a row, so the output does not depend on argpartition
                    order = np.argsort(index, axis=1)
                    index = np.take_along_axis(index, order, axis=1)
                    values = np.take_along_axis(values, order, axis=1)
                    rows, cols = np.nonzero((values > 0) | (not positive_only))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *carried.take(pa.array(rows)).columns,
                            pa.array((index[rows, cols] + first).astype(np.int32)),
                            pa.array(values[rows, cols]),
                        ],
                        names=names,
                    )

    return kept.mapInArrow(infer, schema)


def neuron_table(spark: SparkSession, models: Sequence[FeatureModel]) -> DataFrame:
    """``neuron_idx, source_m, source_k`` of the concatenated models."""
    schema = "first int, source_m int, source_k int"
    rows, first = [], 0
    for model in models:
        rows.append((first, model.m, model.k))
        first += model.m
    return spark.createDataFrame(rows, schema).select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("source_m") - 1)).alias("neuron_idx"),
        "source_m",
        "source_k",
    )


def reconstruct(vectors: DataFrame, model: FeatureModel, *, row_id: str = "row_id", embedding: str = "embedding") -> DataFrame:
    """``row_id, recon``: decoded activations plus the input bias.

    No shuffle while the weights can be broadcast; a larger model is decoded in slices of the dimensions, which are
    put together per row.
    """
    kept = vectors.select(F.col(row_id).cast("long").alias("row_id"), F.col(embedding).alias("_x"))
    if not _fits(model):
        slices = [
            coded.mapInArrow(_slice_decoder(weights), "row_id long, at int, part array<double>")
            for coded, weights in _sliced(kept, model)
        ]
        parts = F.array_sort(F.collect_list(F.struct("at", "part")))  # one for each slice of the dimensions
        return ranking.union_all(slices).groupBy("row_id").agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("recon"))
    weights = _broadcast_all(vectors.sparkSession, model)

    def decode(batches):
        for ids, x, index, values, parts in _forward_batches(batches, weights.value):
            recon = _decode(parts, index, values)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(
                    np.arange(0, recon.size + 1, recon.shape[1], dtype=np.int32), recon.ravel()
                )],
                names=["row_id", "recon"],
            )

    return kept.mapInArrow(decode, "row_id long, recon array<double>")


def _fits(model: FeatureModel) -> bool:
    return 16 * model.m * model.dim <= 4 * BROADCAST_BYTES


def _broadcast_all(spark, model):
    return spark.sparkContext.broadcast((model.enc, model.dec, model.neuron_bias, model.input_bias, model.k))


def _sliced(kept: DataFrame, model: FeatureModel) -> Iterator[tuple[DataFrame, object]]:
    """Coded rows ``row_id, _x, code``, written once, with the decoder of one slice of the dimensions after another.

    The code of a row is its at most K active features, found in neuron blocks. A slice of the
    decoder has all neurons and as many dimensions as the broadcast bound allows.
    """
    acts = activations(kept, model, embedding="_x")
    codes = acts.groupBy("row_id").agg(F.collect_list(F.struct("neuron_idx", "activation")).alias("code"))  # K at most
    coded = cut_lineage(kept.join(codes, "row_id", "left"))
    width = max(1, BROADCAST_BYTES // (8 * model.m))
    for at in range(0, model.dim, width):
        part = slice(at, at + width)
        yield coded, kept.sparkSession.sparkContext.broadcast((at, model.dec[:, part], model.input_bias[part]))


def _code_matrix(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and activations of each row's active features, filled up with an activation of zero."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    index, values = np.zeros((len(column), k), np.int64), np.zeros((len(column), k))
    there = np.arange(k) < lengths[:, None]
    index[there], values[there] = flat.field("neuron_idx").to_numpy(), flat.field("activation").to_numpy()
    return index, values


def _slice_forward(batches, weights) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    at, dec, _ = weights.value
    for batch in batches:
        k = max(1, int(np.asarray(batch.column("code").value_lengths().fill_null(0)).max(initial=0)))
        step = max(1, BLOCK_CELLS // (k * dec.shape[1]))
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            yield piece, *_code_matrix(piece.column("code"), k)


def _slice_decode(weights, index: np.ndarray, values: np.ndarray, end: int | None = None) -> np.ndarray:
    _, dec, center = weights.value
    kept = values if end is None else np.where(index < end, values, 0.0)
    return np.einsum("rk,rkw->rw", kept, dec[index]) + center


def _slice_decoder(weights):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, index, values in _slice_forward(batches, weights):
            part = _slice_decode(weights, index, values)
            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
            at = pa.array(np.full(len(part), weights.value[0], np.int32))
            yield pa.RecordBatch.from_arrays([piece.column("row_id"), at, lists], names=["row_id", "at", "part"])

    return decode


def _forward_batches(batches, parts):
    enc, dec, bias, center, k = parts
    step = max(1, BLOCK_CELLS // max(enc.shape))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            x = matrix_of(piece.column("_x"))
            index, values = top_k((x - center) @ enc.T + bias, k)
            yield piece.column("row_id"), x, index, np.maximum(values, 0.0), parts


def _decode(parts, index, values, end: int | None = None) -> np.ndarray:
    enc, dec, _, center, _ = parts
    dense = np.zeros((len(index), enc.shape[0]))
    np.put_along_axis(dense, index, values, axis=1)
    return dense[:, :end] @ dec[:end] + center


def reconstruction_errors(
    vectors: DataFrame, model: FeatureModel, *, row_id: str = "row_id", embedding: str = "embedding"
) -> DataFrame:
    """``prefix, normalized_mse`` for every prefix of the model (the whole model if none).

    Squared error over the error of predicting the column mean. One pass, or one for each slice of the
    dimensions of a model beyond the broadcast bound; each task emits one row of sums, which Spark adds up.
    """
    ends = list(model.prefixes or [model.m])
    kept = vectors.select(F.col(row_id).cast("long").alias("row_id"), F.col(embedding).alias("_x"))
    schema = "at int, n long, sx array<double>, sxx array<double>, sse array<double>"

    def record(at, n, sx, sxx, sse):
        return pa.RecordBatch.from_pydict(
            {"at": pa.array([at], pa.int32()), "n": [n], "sx": [sx.tolist()], "sxx": [sxx.tolist()], "sse": [sse.tolist()]}
        )

    def sums_of(weights):
        def sums(batches):
            n, sx, sxx, sse = 0, 0.0, 0.0, np.zeros(len(ends))
            for _, x, index, values, parts in _forward_batches(batches, weights.value):
                n += len(x)
                sx = sx + x.sum(axis=0)
                sxx = sxx + (x * x).sum(axis=0)
                sse += [((_decode(parts, index, values, end) - x) ** 2).sum() for end in ends]
            if n:
                yield record(0, n, sx, sxx, sse)

        return sums

    def slice_sums_of(weights):
        def sums(batches):
            at, dec, _ = weights.value
            n, sx, sxx, sse = 0, 0.0, 0.0, np.zeros(len(ends))
            for piece, index, values in _slice_forward(batches, weights):
                x = matrix_of(piece.column("_x"))[:, at : at + dec.shape[1]]
                n += len(x)
                sx = sx + x.sum(axis=0)
                sxx = sxx + (x * x).sum(axis=0)
                sse += [((_slice_decode(weights, index, values, end) - x) ** 2).sum() for end in ends]
            if n:
                yield record(at, n, sx, sxx, sse)

        return sums

    if _fits(model):
        partial = kept.mapInArrow(sums_of(_broadcast_all(vectors.sparkSession, model)), schema)
    else:
        partial = ranking.union_all([coded.mapInArrow(slice_sums_of(w), schema) for coded, w in _sliced(kept, model)])
    per_dim = (
        partial.select("at", "n", F.posexplode(F.arrays_zip("sx", "sxx")))
        .groupBy((F.col("at") + F.col("pos")).alias("dim"))
        .agg(F.sum("n").alias("n"), F.sum("col.sx").alias("sx"), F.sum("col.sxx").alias("sxx"))
    )
    baseline = per_dim.agg(F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")))
    per_end = partial.select(F.posexplode("sse")).groupBy("pos").agg(F.sum("col").alias("sse"))
    prefix = F.lit(ends)[F.col("pos")]
    return per_end.select(
        prefix.cast("int").alias("prefix"),
        F.try_divide(F.col("sse"), baseline.scalar()).alias("normalized_mse"),
    )


def matryoshka_error(vectors: DataFrame, model: FeatureModel, **kwargs) -> DataFrame:
    """Mean of the normalized errors over the model's prefixes."""
    return reconstruction_errors(vectors, model, **kwargs).agg(
        F.avg("normalized_mse").alias("matryoshka_mse")
    )


def lower_medians(vectors: DataFrame, *, embedding: str = "embedding", exact_rows: int = 2_000) -> DataFrame:
    """``dim, median``: per-dimension lower median.

    ``percentile_disc`` keeps each distinct value of a group in one buffer, so it serves
    up to ``exact_rows`` rows. Beyond, the median's bits are found eight at a time by
    counting, which shuffles 256 counts per dimension and task instead of the values.
    """
    n = vectors.count()
    if n <= exact_rows:
        long = vectors.select(F.posexplode(embedding).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
        return long.groupBy("dim").agg(
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("median")
        )
    wide = vectors.schema[embedding].dataType.elementType == T.DoubleType()
    bits, unsigned, real = (64, np.uint64, np.float64) if wide else (32, np.uint32, np.float32)
    dim = vectors.select(F.size(embedding)).first()[0]
    prefix = np.zeros(dim, dtype=unsigned)
    rank = np.full(dim, (n - 1) // 2)
    for shift in range(bits - 8, -1, -8):
        counts = _digit_counts(vectors.select(F.col(embedding).alias("_x")), prefix, shift, bits, unsigned, real)
        table = np.zeros((dim, 256), dtype=np.int64)
        for d, digit, count in counts:
            table[d, digit] = count
        upto = table.cumsum(axis=1)
        digit = (upto <= rank[:, None]).sum(axis=1)
        rank = rank - np.where(digit > 0, upto[np.arange(dim), np.maximum(digit - 1, 0)], 0)
        prefix |= digit.astype(unsigned) << unsigned(shift)
    top = unsigned(1) << unsigned(bits - 1)
    medians = np.where(prefix & top, prefix ^ top, ~prefix).view(real).astype(float)
    return vectors.sparkSession.createDataFrame(list(enumerate(medians.tolist())), "dim int, median double")


def _digit_counts(column: DataFrame, prefix: np.ndarray, shift: int, bits: int, unsigned, real) -> list:
    """Per dimension, how many values that agree with the prefix above have each next digit."""
    above = shift + 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(prefix), 256), dtype=np.int64)
        top = unsigned(1) << unsigned(bits - 1)
        for batch in batches:
            raw = matrix_of(batch.column("_x")).astype(real).view(unsigned)
            # order-preserving integers: flip the sign bit, or all bits of a negative
            key = np.where(raw & top, ~raw, raw | top)
            same = np.ones(key.shape, dtype=bool) if above == bits else (key >> unsigned(above)) == (prefix >> unsigned(above))
            digit = ((key >> unsigned(shift)) & unsigned(255)).astype(np.int64)
            rows, dims = np.nonzero(same)
            total += np.bincount(dims * 256 + digit[rows, dims], minlength=total.size).reshape(total.shape)
        dims, digits = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"dim": dims, "digit": digits, "n": total[dims, digits]})

    counts = column.mapInArrow(count, "dim long, digit long, n long")
    return counts.groupBy("dim", "digit").agg(F.sum("n")).collect()


def never_active(neurons: DataFrame, acts: DataFrame) -> DataFrame:
    """Neurons without a single activation."""
    seen = acts.select("neuron_idx").distinct()
    return neurons.join(F.broadcast(seen), "neuron_idx", "left_anti")
