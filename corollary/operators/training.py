"""Training a top-K sparse autoencoder as a sequence of Spark jobs.

The vectors of an epoch are packed into blocks of each step's rows. The loss is a sum of
ratios whose parts all add over rows, so the result does not depend on how the rows are
partitioned. A step of many rows is one job: every task computes the sums its rows
contribute to the loss and to the gradient, the sums are added up in a tree, and the driver
applies one Adam update to the weights, whose size depends on the model only. Steps that are
one task each can only follow one another, so a chunk of them is one job with one task,
which takes the weights and hands them on. An epoch of several chunks is written to a folder
each, and a job opens the folder of its own chunk only.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.operators.features import (
    BLOCK_CELLS,
    FeatureModel,
    check_prefixes,
    lower_medians,
    matrix_of,
    top_k,
)
from corollary.operators.ranking import HASH_RANGE, hash_position
from corollary.session import folder_exists, scratch_folder
from corollary.sources import models

#: Rows per step unless the caller says otherwise, whatever the number of rows.
STEP_ROWS = 512
#: Bytes of vectors in one packed block and in one training partition.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 32 << 20
#: Bytes of partial sums the driver takes at once, and tasks added up by one task.
COLLECT_BYTES, FAN_IN = 256 << 20, 32
#: Steps that one task takes after one another, and bytes of their vectors at most.
CHUNK_STEPS, CHUNK_BYTES = 64, 64 << 20
#: Fewest rows of a step worth a task of their own, since every task sends a gradient.
TASK_ROWS = 512
#: Rows times dimensions times features of a step from which its tasks outweigh the job that starts them; below, steps follow one another in a task.
STEP_CELLS = 1 << 28
#: Kinds of numbers in which tasks compute and send; sums are added in double precision.
PRECISIONS = {"double": "<f8", "single": "<f4"}
# Adam's usual constants and the guard of the gradient norm
BETA_1, BETA_2, EPSILON, NORM_GUARD = 0.9, 0.999, 1e-8, 1e-6
#: What training changes in a model.
FITTED = ("enc", "dec", "neuron_bias", "input_bias", "steps_since_active")


@dataclass
class TrainConfig:
    prefixes: list[int] | None = None
    aux_k: int | None = None
    multi_k: int | None = None
    dead_neuron_threshold_steps: int = 256
    batch_size: int | None = None
    learning_rate: float = 5e-4
    n_epochs: int = 100
    aux_coef: float = 1 / 32
    multi_coef: float = 0.0
    patience: int = 3
    clip_grad: float | None = 1.0
    seed: int = 0
    partitions: int | None = None
    precision: str = "double"
    #: Validation loss as the mean over batches of ``batch_size`` rows, each against its own spread, instead of over all rows at once.
    batch_validation: bool = False


# --- one task's share of a step ---------------------------------------------------------


def _code(pre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense activations after top-K and ReLU, and the indices that made the top K."""
    index, values = top_k(pre, k)
    dense = np.zeros_like(pre)
    np.put_along_axis(dense, index, np.maximum(values, 0.0), axis=1)
    return dense, index


def main_sums(x: np.ndarray, model: FeatureModel, multi_coef: float, gradient: bool) -> dict[str, np.ndarray]:
    """Sums for the main and the multi-K term over the rows of ``x``.

    Gradients are of ``mean over prefixes of SSE + multi_coef * SSE_multi``; the driver
    divides them by the baseline, which needs all rows.
    """
    centered = x - model.input_bias
    pre = centered @ model.enc.T + model.neuron_bias
    code, index = _code(pre, model.k)
    ends = list(model.prefixes or [model.m])
    fired = np.zeros(model.m)
    fired[np.unique(index)] = 1.0
    terms = [(code, end, 1.0 / len(ends)) for end in ends]
    if multi_coef and model.multi_k:
        terms.append((_code(pre, model.multi_k)[0], model.m, multi_coef))
    sse, out = [], {}
    if gradient:
        out = {
            "g_enc": np.zeros_like(model.enc), "g_dec": np.zeros_like(model.dec),
            "g_neuron": np.zeros_like(model.neuron_bias), "g_input": np.zeros_like(model.input_bias),
        }
    for active, end, weight in terms:
        miss = active[:, :end] @ model.dec[:end] + model.input_bias - x
        sse.append((miss**2).sum())
        if end == model.m and active is code:
            residual = -miss
        if gradient:
            slope = 2.0 * weight * miss
            back = (slope @ model.dec[:end].T) * (active[:, :end] > 0)
            out["g_dec"][:end] += active[:, :end].T @ slope
            out["g_enc"][:end] += back.T @ centered
            out["g_neuron"][:end] += back.sum(axis=0)
            out["g_input"] += slope.sum(axis=0) - back.sum(axis=0) @ model.enc[:end]
    return out | {
        "n": np.array([float(len(x))]),
        "sx": x.sum(axis=0),
        "sxx": np.array([(x * x).sum()]),
        "sse": np.array(sse),
        "se": residual.sum(axis=0),
        "see": np.array([(residual**2).sum()]),
        "fired": fired,
    }


def aux_sums(x: np.ndarray, model: FeatureModel, dead: np.ndarray, gradient: bool) -> dict[str, np.ndarray]:
    """Sums for the auxiliary term: dead features reconstruct what the others miss."""
    centered = x - model.input_bias
    pre = centered @ model.enc.T + model.neuron_bias
    residual = x - (_code(pre, model.k)[0] @ model.dec + model.input_bias)
    code, _ = _code(pre[:, dead], min(model.aux_k, len(dead)))
    miss = code @ model.dec[dead] - residual
    out = {"sse": np.array([(miss**2).sum()])}
    if gradient:
        slope = 2.0 * miss
        back = (slope @ model.dec[dead].T) * (code > 0)
        out |= {
            "g_enc": back.T @ centered,
            "g_dec": code.T @ slope,
            "g_neuron": back.sum(axis=0),
            "g_input": -back.sum(axis=0) @ model.enc[dead],
        }
    return out


# --- Spark side -------------------------------------------------------------------------


def pack(
    vectors: DataFrame, embedding: str, row_id: str, steps: int, seed: int, dim: int, epoch: int = 0,
    partitions: int = 1, spread: int = 1, chunk_steps: int = 1,
) -> DataFrame:
    """``step, block``: single-precision blocks of each step's rows, in order of steps.

    A row's step follows from a hash of the epoch and its id, so every epoch draws its steps
    anew. The rows of a chunk of steps are brought together in ``spread`` of the partitions.
    """
    step = (hash_position("train", seed, F.lit(epoch), F.col(row_id)) / F.lit(HASH_RANGE / steps)).cast("int")
    rows = vectors.select(
        F.least(step, F.lit(steps - 1)).alias("step"), F.col(embedding).alias("x"),
        F.pmod(F.xxhash64(row_id), F.lit(spread)).alias("slot"),
    ).withColumn("chunk", F.floor(F.col("step") / chunk_steps))
    rows = rows.repartition(partitions, "chunk", "slot").sortWithinPartitions("step").drop("slot", "chunk")
    most = max(1, BLOCK_BYTES // (4 * dim))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}

        def block(s):
            joined = np.concatenate(waiting.pop(s)).astype(np.float32)
            return pa.RecordBatch.from_pydict({"step": pa.array([s], pa.int32()), "block": [joined.tobytes()]})

        for batch in batches:
            x = matrix_of(batch.column("x"))
            if x.size and x.shape[1] != dim:
                raise ValueError(f"vector of {x.shape[1]} instead of {dim} dimensions")
            of = batch.column("step").to_numpy()
            for s in np.unique(of).tolist():
                for done in [w for w in waiting if w < s]:
                    yield block(done)
                waiting.setdefault(s, []).append(x[of == s])
                if sum(map(len, waiting[s])) >= most:
                    yield block(s)
        for s in sorted(waiting):
            yield block(s)

    return rows.mapInArrow(pack_rows, "step int, block binary")


def _add_up(partials: DataFrame, tasks: int, message_bytes: int) -> dict[str, np.ndarray]:
    """Total of one ``part, sums`` record per task, through a tree of partial totals."""
    at_once = max(FAN_IN, COLLECT_BYTES // max(message_bytes, 1))
    if message_bytes * FAN_IN > COLLECT_BYTES:
        at_once = max(1, COLLECT_BYTES // message_bytes)
    while tasks > at_once:
        tasks = max(1, -(-tasks // FAN_IN))
        partials = (
            partials.repartition(tasks, F.pmod("part", F.lit(tasks)))
            .sortWithinPartitions("part")
            .mapInArrow(_sum_records, "part int, sums binary")
        )
    total: dict[str, np.ndarray] = {}
    for row in sorted(partials.toArrow().to_pylist(), key=lambda r: r["part"]):
        _accumulate(total, _unpack(row["sums"]))
    return total


def _accumulate(total: dict, more: dict) -> None:
    for name, value in more.items():
        total[name] = total[name] + value if name in total else value.astype(np.float64)


def _packed(total: dict, kind: str) -> bytes:
    head = ",".join([kind, *(f"{k}:{'x'.join(map(str, v.shape))}" for k, v in total.items())]).encode()
    body = b"".join(np.ascontiguousarray(v, dtype=kind).tobytes() for v in total.values())
    return len(head).to_bytes(4, "little") + head + body


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    at, out = 4 + int.from_bytes(raw[:4], "little"), {}
    kind, *entries = raw[4:at].decode().split(",")
    kind = np.dtype(kind)
    for entry in entries:
        name, shape = entry.split(":")
        shape = tuple(int(n) for n in shape.split("x"))
        count = math.prod(shape)
        out[name] = np.frombuffer(raw, kind, count, at).reshape(shape).astype(np.float64)
        at += kind.itemsize * count
    return out


def _kind_of(raw: bytes) -> str:
    return raw[4 : 4 + int.from_bytes(raw[:4], "little")].decode().split(",")[0]


def _record(total: dict, kind: str) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [_packed(total, kind)]})


def _sum_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    kind = ""
    for batch in batches:
        for raw in batch.column("sums"):
            kind = kind or _kind_of(raw.as_py())
            _accumulate(total, _unpack(raw.as_py()))
    if total:
        yield _record(total, kind)


def _as_type(model: FeatureModel, kind) -> FeatureModel:
    out = copy.copy(model)
    for name in ("enc", "dec", "neuron_bias", "input_bias"):
        setattr(out, name, getattr(model, name).astype(kind))
    return out


def _sum_shares(total: dict, x: np.ndarray, weights: FeatureModel, share, kind) -> None:
    """Add ``share(x, weights)`` to the total, a bounded number of rows at a time."""
    step = max(1, BLOCK_CELLS // max(weights.m, weights.dim))
    for at in range(0, len(x), step):
        _accumulate(total, share(x[at : at + step].astype(kind), weights))


@dataclass
class _Blocks:
    """Blocks in a frame, and the number of tasks that read them."""

    frame: DataFrame
    tasks: int

    def total(self, model: FeatureModel, share, message_bytes: int, precision: str) -> dict[str, np.ndarray]:
        """Sum ``share(x, model)`` over all rows of the blocks."""
        spark = self.frame.sparkSession
        sent = PRECISIONS[precision]
        kind = np.dtype(sent)
        weights = spark.sparkContext.broadcast(_as_type(model, kind))
        dim = model.dim

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for raw in batch.column("block"):
                    x = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, dim)
                    _sum_shares(total, x, weights.value, share, kind)
            if total:
                yield _record(total, sent)

        try:
            return _add_up(self.frame.mapInArrow(work, "part int, sums binary"), self.tasks, message_bytes)
        finally:
            weights.destroy()


@dataclass
class _Held:
    """The blocks of a step within a task."""

    blocks: list[np.ndarray]

    def total(self, model: FeatureModel, share, message_bytes: int, precision: str) -> dict[str, np.ndarray]:
        kind, total = np.dtype(PRECISIONS[precision]), {}
        for x in self.blocks:
            _sum_shares(total, x, _as_type(model, kind), share, kind)
        return total


def _loss_and_gradient(blocks, model: FeatureModel, cfg: TrainConfig, gradient: bool, track: bool):
    """Loss of one step over ``blocks`` and, if asked for, its gradient."""
    message = 16 * model.m * model.dim if gradient else 8 * (model.m + 3 * model.dim)
    multi = cfg.multi_coef
    # The features that are dead before the step nearly always are those dead in it, so their
    # sums are taken along; only where the step changes the set does it take a second job.
    dead_before = np.flatnonzero(model.dead()) if cfg.aux_coef else np.zeros(0, dtype=int)

    def share(x, m):
        sums = main_sums(x, m, multi, gradient)
        if len(dead_before):
            sums |= {f"aux_{name}": value for name, value in aux_sums(x, m, dead_before, gradient).items()}
        return sums

    total = blocks.total(model, share, message, cfg.precision)
    if not total:
        return None, None
    n = total["n"][0]
    baseline = total["sxx"][0] - (total["sx"] ** 2).sum() / n
    n_prefix = len(model.prefixes or [model.m])
    loss = total["sse"][:n_prefix].mean() / baseline + multi * total["sse"][n_prefix:].sum() / baseline
    grads = {k: total[k] / baseline for k in ("g_enc", "g_dec", "g_neuron", "g_input")} if gradient else None
    if track:
        # a feature in any row's top K counts as active, even if its ReLU gave zero
        model.steps_since_active = np.where(total["fired"] > 0, 0, model.steps_since_active + 1)
    if cfg.aux_coef:
        aux_baseline = total["see"][0] - (total["se"] ** 2).sum() / n
        dead = np.flatnonzero(model.dead())
        if len(dead):
            if np.array_equal(dead, dead_before):
                aux = {name[4:]: value for name, value in total.items() if name.startswith("aux_")}
            else:
                aux = blocks.total(model, lambda x, m: aux_sums(x, m, dead, gradient), message, cfg.precision)
            loss += cfg.aux_coef * aux["sse"][0] / aux_baseline
            if gradient:
                scale = cfg.aux_coef / aux_baseline
                for name in ("g_enc", "g_dec", "g_neuron"):
                    grads[name][dead] += scale * aux[name]
                grads["g_input"] += scale * aux["g_input"]
        else:
            loss += cfg.aux_coef * total["see"][0] / aux_baseline
    return float(loss), grads


def initial_model(vectors: DataFrame, m: int, k: int, cfg: TrainConfig, embedding: str) -> FeatureModel:
    """Input bias at the per-dimension lower median; unit decoder rows; encoder = decoder."""
    medians = sorted(lower_medians(vectors, embedding=embedding).collect())
    center = np.array([r["median"] for r in medians])
    dim = len(center)
    bound = math.sqrt(6.0 / (dim + m))
    dec = np.random.default_rng(cfg.seed).uniform(-bound, bound, size=(m, dim))
    dec /= np.linalg.norm(dec, axis=1, keepdims=True)
    return FeatureModel(
        enc=dec.copy(), dec=dec, neuron_bias=np.zeros(m), input_bias=center, k=k, aux_k=cfg.aux_k,
        multi_k=cfg.multi_k, dead_threshold=cfg.dead_neuron_threshold_steps, prefixes=cfg.prefixes,
    )


class _Adam:
    """Adam over the four parameter arrays of a model, with the decoder kept on unit rows."""

    FIELDS = {"g_enc": "enc", "g_dec": "dec", "g_neuron": "neuron_bias", "g_input": "input_bias"}

    def __init__(self, cfg: TrainConfig) -> None:
        self.cfg, self.step = cfg, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def update(self, model: FeatureModel, grads: dict[str, np.ndarray]) -> None:
        along = (model.dec * grads["g_dec"]).sum(axis=1, keepdims=True)
        grads["g_dec"] = grads["g_dec"] - along * model.dec
        if self.cfg.clip_grad is not None:
            norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            shrink = min(1.0, self.cfg.clip_grad / (norm + NORM_GUARD))
            grads = {k: g * shrink for k, g in grads.items()}
        self.step += 1
        for name, attribute in self.FIELDS.items():
            g = grads[name]
            m = self.first[name] = BETA_1 * self.first.get(name, 0.0) + (1 - BETA_1) * g
            v = self.second[name] = BETA_2 * self.second.get(name, 0.0) + (1 - BETA_2) * g * g
            m_hat, v_hat = m / (1 - BETA_1**self.step), v / (1 - BETA_2**self.step)
            moved = getattr(model, attribute) - self.cfg.learning_rate * m_hat / (np.sqrt(v_hat) + EPSILON)
            setattr(model, attribute, moved)
        model.dec = model.dec / np.linalg.norm(model.dec, axis=1, keepdims=True)

    def moments(self) -> dict[str, np.ndarray]:
        return {f"first_{k}": v for k, v in self.first.items()} | {f"second_{k}": v for k, v in self.second.items()}

    def resume(self, moments: dict[str, np.ndarray], steps: int) -> None:
        """Go on from the moments after so many further steps."""
        self.step += steps
        self.first = {name: moments[f"first_{name}"] for name in self.FIELDS}
        self.second = {name: moments[f"second_{name}"] for name in self.FIELDS}


def _partitions(vectors, cfg, dim, n_rows: int, steps: int) -> tuple[int, int]:
    """Partitions of the packed blocks, which follow the size of the data, and tasks that share a step."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    by_size, by_rows = -(-n_rows * dim * 4 // PARTITION_BYTES), -(-n_rows // TASK_ROWS)
    parts = cfg.partitions or max(1, by_size, min(cores, by_rows))
    return parts, max(1, min(parts, -(-n_rows // (steps * TASK_ROWS))))


def _cached_blocks(vectors, embedding, row_id, cfg, dim, n_rows) -> _Blocks:
    """Blocks of a single step over all rows, kept."""
    parts, spread = _partitions(vectors, cfg, dim, n_rows, 1)
    frame = pack(vectors, embedding, row_id, 1, cfg.seed, dim, 0, parts, spread)
    return _Blocks(frame.persist(StorageLevel.MEMORY_AND_DISK), spread)


@dataclass
class _Epoch:
    """The chunks of an epoch's steps, and how to read one."""

    chunks: int
    tasks: int
    read: Callable[[int], DataFrame]


def _is_light(cfg: TrainConfig, step_rows: int, dim: int, m: int | None) -> bool:
    """Whether a step is done sooner than a job starts, and its rows fit one task. A given number of partitions is kept to."""
    return m is not None and cfg.partitions is None and 4 * step_rows * dim <= CHUNK_BYTES and step_rows * dim * m <= STEP_CELLS


@contextmanager
def _epoch(
    vectors, embedding, row_id, steps: int, cfg: TrainConfig, dim: int, n_rows: int, epoch: int, m: int | None = None,
) -> Iterator[_Epoch]:
    """An epoch's steps in chunks. A single chunk is read where it comes from, several from a folder each.

    Steps of a model of ``m`` features that are light follow one another in one task a chunk, however many rows they have.
    """
    parts, tasks = _partitions(vectors, cfg, dim, n_rows, steps)
    if _is_light(cfg, -(-n_rows // steps), dim, m):
        tasks = 1
    size = max(1, min(CHUNK_STEPS, CHUNK_BYTES * steps // (4 * dim * n_rows))) if tasks == 1 else 1
    chunks = -(-steps // size)
    if chunks == 1:
        frame = pack(vectors, embedding, row_id, steps, cfg.seed, dim, epoch, tasks, tasks, size)
        yield _Epoch(1, tasks, lambda _: frame)
        return
    spark = vectors.sparkSession
    with scratch_folder(spark, "epoch") as folder:
        packed = pack(vectors, embedding, row_id, steps, cfg.seed, dim, epoch, parts, tasks, size)
        packed.withColumn("chunk", F.floor(F.col("step") / size)).write.partitionBy("chunk").parquet(folder)
        schema = "step int, block binary"

        def read(chunk: int) -> DataFrame:
            # a chunk to which no row was dealt has no folder
            path = f"{folder}/chunk={chunk}"
            return spark.read.schema(schema).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], schema)

        yield _Epoch(chunks, tasks, read)


def _chain(frame: DataFrame, model: FeatureModel, adam: _Adam, cfg: TrainConfig) -> list[float]:
    """Take the steps of a chunk after one another in one task; the model and the optimizer go on from where it ends."""
    sent = frame.sparkSession.sparkContext.broadcast((model, adam))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, steps, losses = copy.deepcopy(sent.value[0]), copy.deepcopy(sent.value[1]), []
        rows = ((step, raw) for b in batches for step, raw in zip(b.column("step").to_pylist(), b.column("block"), strict=True))
        for _, blocks in groupby(rows, key=lambda r: r[0]):
            held = _Held([np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, own.dim) for _, raw in blocks])
            loss, grads = _loss_and_gradient(held, own, cfg, gradient=True, track=True)
            steps.update(own, grads)
            losses.append(loss)
        if losses:
            state = {name: getattr(own, name) for name in FITTED} | steps.moments() | {"losses": np.array(losses)}
            yield pa.RecordBatch.from_pydict({"state": [_packed(state, PRECISIONS["double"])]})

    try:
        ended = frame.coalesce(1).sortWithinPartitions("step").mapInArrow(work, "state binary").toArrow().column("state").to_pylist()
    finally:
        sent.destroy()
    if not ended:
        return []
    state = _unpack(ended[0])
    for name in FITTED:
        setattr(model, name, state[name])
    model.steps_since_active = model.steps_since_active.astype(int)
    adam.resume(state, len(state["losses"]))
    return state["losses"].tolist()


def train_sae(
    vectors: DataFrame,
    m: int,
    k: int,
    *,
    val_vectors: DataFrame | None = None,
    checkpoint_dir: str | None = None,
    overwrite_checkpoint: bool = False,
    embedding: str = "embedding",
    row_id: str = "row_id",
    start: FeatureModel | None = None,
    **options,
) -> FeatureModel:
    """Train a model, or load the one trained before on the same vectors.

    ``options`` are the fields of :class:`TrainConfig`. ``batch_size=None`` takes 512 rows per
    step, about, at every size: a row's step is drawn by a hash of the epoch and its id.
    ``start`` is a model to go on from instead of fresh weights; it stays as it is.
    """
    spark = vectors.sparkSession
    cfg = TrainConfig(**options)
    check_prefixes(cfg.prefixes, m)
    n_rows, mark = vectors.agg(F.count("*"), F.bit_xor(F.xxhash64(row_id, embedding))).first()
    if not n_rows:
        raise ValueError("no vectors to train on")
    fingerprint = f"{n_rows}:{mark}"
    path = None
    if checkpoint_dir is not None:
        dim = vectors.select(F.size(embedding)).first()[0]
        path = f"{checkpoint_dir}/{models.folder_name(dim, m, k, cfg.prefixes, fingerprint)}"
        if not overwrite_checkpoint and models.exists(spark, path):
            return models.load_model(spark, path, fingerprint=fingerprint)
    model = copy.deepcopy(start) if start is not None else initial_model(vectors, m, k, cfg, embedding)
    model.fingerprint = fingerprint
    size = cfg.batch_size or STEP_ROWS
    steps = max(1, -(-n_rows // size))
    val_blocks = None
    if val_vectors is not None:
        val_blocks = _validation_blocks(val_vectors, embedding, row_id, size if cfg.batch_validation else None, cfg, model.dim)
    try:
        if steps == 1:
            _fit_whole(model, _cached_blocks(vectors, embedding, row_id, cfg, model.dim, n_rows), val_blocks, cfg)
        else:
            _fit(model, lambda e: _epoch(vectors, embedding, row_id, steps, cfg, model.dim, n_rows, e, m), val_blocks, cfg)
    finally:
        if val_blocks is not None:
            val_blocks.frame.unpersist()
    if path is not None:
        models.save_model(spark, model, path)
    return model


class _Patience:
    """Early stopping; the last weights are kept, not the best."""

    def __init__(self, cfg: TrainConfig) -> None:
        self.cfg, self.best, self.waited = cfg, math.inf, 0

    def ends(self, val_loss: float | None) -> bool:
        if val_loss is None:
            return False
        if val_loss < self.best:
            self.best, self.waited = val_loss, 0
        else:
            self.waited += 1
        return self.waited >= self.cfg.patience


def _fit_whole(model: FeatureModel, blocks: _Blocks, val_blocks, cfg: TrainConfig) -> None:
    """Epochs of one step over all rows: all are the same."""
    adam, patience = _Adam(cfg), _Patience(cfg)
    try:
        for epoch in range(cfg.n_epochs):
            loss, grads = _loss_and_gradient(blocks, model, cfg, gradient=True, track=True)
            adam.update(model, grads)
            if patience.ends(_epoch_ends(model, epoch, [loss], val_blocks, cfg)):
                break
    finally:
        blocks.frame.unpersist()


def _fit(model: FeatureModel, epoch_of, val_blocks, cfg: TrainConfig) -> None:
    """Epochs of steps, in chunks: one job each, or one for each step of more than one task."""
    adam, patience = _Adam(cfg), _Patience(cfg)
    for epoch in range(cfg.n_epochs):
        losses = []
        with epoch_of(epoch) as steps:
            for chunk in range(steps.chunks):
                if steps.tasks == 1:
                    losses += _chain(steps.read(chunk), model, adam, cfg)
                    continue
                loss, grads = _loss_and_gradient(_Blocks(steps.read(chunk), steps.tasks), model, cfg, gradient=True, track=True)
                if grads is not None:
                    adam.update(model, grads)
                    losses.append(loss)
        if patience.ends(_epoch_ends(model, epoch, losses, val_blocks, cfg)):
            break


def _epoch_ends(model: FeatureModel, epoch: int, losses: list[float], val_blocks, cfg: TrainConfig) -> float | None:
    """Add a line to the model's history; return the validation loss."""
    line = {
        "epoch": epoch, "train_loss": float(np.mean(losses)), "val_loss": None, "dead_ratio": float(model.dead().mean()),
    }
    model.history.append(line)
    if val_blocks is not None:
        line["val_loss"] = _validation_loss(val_blocks, model, cfg)
    return line["val_loss"]


def _validation_blocks(vectors, embedding, row_id, size: int | None, cfg, dim) -> _Blocks:
    """Kept blocks of the validation rows: one batch of all, or batches of about ``size`` rows drawn by a hash of their ids."""
    n = vectors.count()
    if size is None:
        return _cached_blocks(vectors, embedding, row_id, cfg, dim, n)
    batches = max(1, -(-n // size))
    parts, _ = _partitions(vectors, cfg, dim, n, 1)
    frame = pack(vectors, embedding, row_id, batches, cfg.seed, dim, -1, parts, 1)
    return _Blocks(frame.persist(StorageLevel.MEMORY_AND_DISK), parts)


def _validation_loss(blocks: _Blocks, model: FeatureModel, cfg: TrainConfig) -> float:
    """Loss of all rows at once, or the mean of the losses of batches: each batch lies in one task, which needs no other."""
    if not cfg.batch_validation:
        return _loss_and_gradient(blocks, model, cfg, gradient=False, track=False)[0]
    weights = blocks.frame.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, losses = weights.value, []
        rows = ((step, raw) for b in batches for step, raw in zip(b.column("step").to_pylist(), b.column("block"), strict=True))
        for _, held in groupby(rows, key=lambda r: r[0]):
            held = _Held([np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, own.dim) for _, raw in held])
            losses.append(_loss_and_gradient(held, own, cfg, gradient=False, track=False)[0])
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(losses)], pa.int64()), "loss": pa.array([float(np.sum(losses))])})

    try:
        sums = blocks.frame.mapInArrow(work, "n long, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
    finally:
        weights.destroy()
    return sums["loss"] / sums["n"] if sums["n"] else math.nan


def model_loss(
    vectors: DataFrame, model: FeatureModel, *, embedding: str = "embedding", row_id: str = "row_id", **options
) -> float:
    """The training loss of a given model over all rows, without changing the model.

    ``options`` are those of :class:`TrainConfig`; ``multi_coef`` and ``aux_coef`` weigh
    the two extra terms, of which the second uses the features idle for too many steps.
    """
    cfg = TrainConfig(**options)
    blocks = _cached_blocks(vectors, embedding, row_id, cfg, model.dim, vectors.count())
    try:
        return _loss_and_gradient(blocks, model, cfg, gradient=False, track=False)[0]
    finally:
        blocks.frame.unpersist()


def gradient_table(
    vectors: DataFrame, model: FeatureModel, *, embedding: str = "embedding", row_id: str = "row_id", **options
) -> DataFrame:
    """``neuron_idx, enc, dec, bias``: the loss gradient of a given model over all rows.

    Before projection and clipping. Tells which features a further step would move.
    """
    cfg = TrainConfig(**options)
    blocks = _cached_blocks(vectors, embedding, row_id, cfg, model.dim, vectors.count())
    try:
        _, grads = _loss_and_gradient(blocks, model, cfg, gradient=True, track=False)
    finally:
        blocks.frame.unpersist()
    rows = [
        (i, grads["g_enc"][i].tolist(), grads["g_dec"][i].tolist(), float(grads["g_neuron"][i])) for i in range(model.m)
    ]
    return vectors.sparkSession.createDataFrame(
        rows, "neuron_idx int, enc array<double>, dec array<double>, bias double"
    )


def history_table(spark, model: FeatureModel) -> DataFrame:
    """``epoch, train_loss, val_loss, dead_ratio``."""
    rows: Sequence[tuple] = [
        (h["epoch"], h["train_loss"], h["val_loss"], h["dead_ratio"]) for h in model.history
    ]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, dead_ratio double")
