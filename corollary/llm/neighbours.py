"""Nearest neighbours by a block matrix join: products of int8 tiles bound every score, pairs that may count are scored in full.

Vectors are dealt to cells around a bounded sample of anchors and cut into blocks. A floor for each query, its k-th best score in another bounded sample, tells which cells
it need not visit. A task holds one block and one slice of the queries; it multiplies their int8 forms, and the error bounds of
the rounding tell which pairs can't be among the best. The others are scored in double precision and kept in heaps.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corollary.session import ensure_checkpoint_dir

#: Results of a query; vectors of a block, queries of a slice, queries multiplied at once.
K = 20
CANDIDATES, QUERIES, STRIP = 32_768, 8_192, 256
#: Most cells, and vectors of the sample that floors come from.
CELLS, FLOOR_SAMPLE = 1_024, 2_048
#: Dimensions whose int8 products add up exactly in single precision, and pairs scored at once.
EXACT_DIMS, PAIRS = 1_024, 1 << 18
#: Rounding errors of sums of products, relative to the product of the norms.
SLACK = 1e-9


# --- one tile ---------------------------------------------------------------------------


class Quantized:
    """Rows as int8 times a scale each, and what is needed to bound the error of their products."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.full = vectors.astype(np.float64)
        with np.errstate(all="ignore"):
            self.scale = np.abs(self.full).max(axis=1, initial=0.0) / 127
            step = np.where(self.scale > 0, self.scale, 1.0)
            self.small = np.rint(self.full / step[:, None]).clip(-127, 127).astype(np.int8)
            near = self.small * self.scale[:, None]
            self.norm, self.near_norm = (np.sqrt((m * m).sum(axis=1)) for m in (self.full, near))
            rest = self.full - near
            self.rest_norm = np.sqrt((rest * rest).sum(axis=1))

    def rows(self, at: slice) -> Quantized:
        out = object.__new__(Quantized)
        for name, value in self.__dict__.items():
            setattr(out, name, value[at])
        return out

    def bounds(self, other: Quantized) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of all rows with all rows of ``other``.

        q.x is (q' + q'').(x' + x'') with the int8 parts ' and the rests ''; what q'.x' leaves out is at most |q||x''| + |q''||x'|.
        """
        product = np.zeros((len(self.small), len(other.small)))
        for at in range(0, self.small.shape[1], EXACT_DIMS):  # whole numbers below 2 ** 24: single precision is exact
            part = slice(at, at + EXACT_DIMS)
            product += self.small[:, part].astype(np.float32) @ other.small[:, part].astype(np.float32).T
        with np.errstate(all="ignore"):
            product *= self.scale[:, None]
            product *= other.scale
            error = np.outer(self.norm, other.rest_norm + SLACK * other.norm) + np.outer(self.rest_norm, other.near_norm)
            return product - error, product + error


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of equal number, added up component by component in double precision."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
    return total


def kept_best(heap: list, score: float, item: int, most: int) -> None:
    """Keep the ``most`` best of (score, smaller item) in a heap whose first is the worst. A score that isn't a number is the lowest."""
    entry = (score if score == score else -np.inf, -item)
    if len(heap) < most:
        heapq.heappush(heap, entry)
    elif entry > heap[0]:
        heapq.heapreplace(heap, entry)


def search_tile(queries: Quantized, floors: np.ndarray, block: Quantized, ids: list[list[int]], most: int) -> tuple[list[list], int]:
    """For each query a heap of the ``most`` best (score, -id) of a block, and the number of pairs that were scored.

    A query's floor is a score that ``most`` rows are known to reach; the lower bounds within the block may raise it.
    """
    heaps: list[list] = [[] for _ in range(len(queries.full))]
    scored = 0
    for at in range(0, len(heaps), STRIP):
        strip = queries.rows(slice(at, at + STRIP))
        low, high = strip.bounds(block)
        floor = floors[at : at + STRIP]
        if low.shape[1] >= most:
            floor = np.fmax(floor, np.partition(low, -most, axis=1)[:, -most])
        who, which = np.nonzero(~(high < floor[:, None]))
        scored += len(who)
        for start in range(0, len(who), PAIRS):
            i, j = who[start : start + PAIRS], which[start : start + PAIRS]
            for q, x, score in zip(i.tolist(), j.tolist(), inner(strip.full[i], block.full[j]).tolist(), strict=True):
                for item in ids[x]:
                    kept_best(heaps[at + q], score, item, most)
    return heaps, scored


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


# --- Spark side -------------------------------------------------------------------------


def _written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/neighbours-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def usable(vector: str) -> Column:
    """Whether a vector is not null, holds no null and no component that isn't finite, and is not zero."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def _sample(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """At most ``n`` distinct vectors, those of lowest hash."""
    taken = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(n).toArrow()
    return matrix(taken.column("v"), width) if len(taken) else np.zeros((0, width))


def nearest(
    embeddings: DataFrame, is_query: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K,
    block_candidates: int = CANDIDATES, block_queries: int = QUERIES, cells: int = CELLS, floor_sample: int = FLOOR_SAMPLE,
) -> DataFrame:
    """Return ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` rows of largest inner product.

    Queries are the rows for which ``is_query``, a Column or SQL, holds, candidates all rows but those of the query's own id. The score is the inner
    product in double precision, ties go to the smaller id; a product that overflows and isn't a number ranks last. The result is exact: bounds only drop pairs that can't count.

    Vectors that are null, zero, or hold null or non-finite components, and rows without id, take no part; shorter vectors count as filled up with
    zeros. A row repeated whole counts once; an id with several vectors is a candidate with each, and one query, of the least. A query with fewer candidates returns them
    all. Empty tables give an empty result, other columns are not read.

    Equal vectors are compared once, as a query and as a candidate, however many ids have them: of the ids of one vector only the ``k`` + 1 smallest can be
    among a query's best. Cells follow the data up to ``cells``, beyond that their blocks do. The driver holds the anchors, the floor sample and three
    numbers per cell. A vector is copied once for each slice of ``block_queries`` queries that visit its cell.
    """
    spark, most = embeddings.sparkSession, k + 1
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = embeddings.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    # The smallest ids of each vector; every partition keeps its own smallest before the shuffle.
    order = Window.partitionBy("v").orderBy("id")
    smallest = rows.select("v", "id").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most)
    candidates = _written(smallest.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    n, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    anchors = _sample(candidates, min(cells, max(1, -(-n // block_candidates))), width)
    sample = Quantized(_sample(candidates, floor_sample, width))
    squares = (anchors * anchors).sum(axis=1)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest anchor and the distance to it."""
        with np.errstate(all="ignore"):
            at = np.argmin(squares - 2 * (x @ anchors.T), axis=1)
            rest = x - anchors[at]
            return at, np.sqrt((rest * rest).sum(axis=1))

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = place(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["v", "ids", "cell", "far"])

    element = candidates.schema["v"].dataType.simpleString()
    placed = _written(candidates.mapInArrow(with_cell, f"v {element}, ids array<long>, cell int, far double"))
    sizes = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # one row per anchor
    at = sorted(sizes)
    radius, n_blocks = np.array([sizes[c][1] for c in at]), {c: -(-sizes[c][0] // block_candidates) for c in at}

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score that ``most`` rows of the sample reach, and the cells whose rows may reach it."""
        for batch in batches:
            x = matrix(batch.column("v"), width)
            norms = np.sqrt((x * x).sum(axis=1))
            floors = np.full(len(x), -np.inf)
            if len(sample.full) >= most:
                with np.errstate(all="ignore"):
                    size = sample.norm.max() * norms
                    floors = np.partition(x @ sample.full.T, -most, axis=1)[:, -most] - SLACK * size
            with np.errstate(all="ignore"):
                reach = x @ anchors[at].T + norms[:, None] * (radius * (1 + SLACK) + SLACK * np.abs(anchors[at]).sum(axis=1))
            visits = [pa.scalar([at[j] for j in np.flatnonzero(row)], pa.list_(pa.int32())) for row in ~(reach < floors[:, None])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(floors), pa.array([v.as_py() for v in visits], pa.list_(pa.int32()))], names=["key", "v", "floor", "visits"],
            )

    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    distinct = asked.groupBy("v").agg(F.min("id").alias("key"))
    queries = _written(distinct.select("key", "v").mapInArrow(with_floor, f"key long, v {element}, floor double, visits array<int>"))
    visitors = {r["cell"]: r["count"] for r in queries.select(F.explode("visits").alias("cell")).groupBy("cell").count().collect()}  # one row per anchor
    plan = F.broadcast(spark.createDataFrame(  # one row per anchor
        [(c, n_blocks[c], -(-visitors[c] // block_queries)) for c in at if c in visitors], "cell int, blocks int, slices int",
    ))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = placed.join(plan, "cell").select("cell", of("v", "blocks").alias("block"), spread("slices").alias("slice"), "v", "ids")
    right = (
        queries.select("key", "v", "floor", F.explode("visits").alias("cell")).join(plan, "cell")
        .select("cell", spread("blocks").alias("block"), of("key", "slices").alias("slice"), "key", "v", "floor")
    )

    def search(block: pa.Table, asking: pa.Table) -> pa.Table:
        keys, scores, found = [], [], []
        if len(block) and len(asking):
            heaps, _ = search_tile(
                Quantized(matrix(asking.column("v"), width)), asking.column("floor").to_numpy(), Quantized(matrix(block.column("v"), width)),
                block.column("ids").to_pylist(), most,
            )
            for key, heap in zip(asking.column("key").to_pylist(), heaps, strict=True):
                keys += [key] * len(heap)
                scores += [s for s, _ in heap]
                found += [-i for _, i in heap]
        return pa.table({"key": pa.array(keys, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    tiles = left.groupBy("cell", "block", "slice").cogroup(right.groupBy("cell", "block", "slice"))
    parts = tiles.applyInArrow(search, "key long, id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One heap at a time: the rows come sorted by key."""
        rows = ((key, i, s) for b in batches for key, i, s in zip(*(b.column(c).to_pylist() for c in ("key", "id", "score")), strict=True))
        kind = pa.schema([("key", pa.int64()), ("best", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))])
        waiting = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            heap: list = []
            for _, i, s in group:
                kept_best(heap, s, i, most)
            waiting.append({"key": key, "best": [{"id": -i, "score": s} for s, i in sorted(heap, reverse=True)]})
            if len(waiting) >= 1024:
                yield pa.RecordBatch.from_pylist(waiting, schema=kind)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=kind)

    merged = parts.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "key long, best array<struct<id long, score double>>")
    keyed = asked.join(distinct, "v").select("id", "key")
    best = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    ranked = keyed.join(merged, "key").select(F.col("id").alias("query_id"), F.posexplode(best).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), "b.score")
