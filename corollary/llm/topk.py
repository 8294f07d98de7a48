"""Exact top-k inner products by bounds over segments, coarse to fine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Results of a query, factor before rounding down, numbers of segments from coarse to fine, rows of a block.
K = 20
SCALE = 64
SEGMENTS = (2, 8, 16)
#: Largest score that a column of 64 bits holds; larger ones are given as this.
LARGEST = (1 << 63) - 1
CANDIDATES, QUERIES = 4096, 2048


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector, sqrt(length) * mean and sqrt(length) * standard deviation of each segment, side by side.

    For two vectors the sum over segments of the squared differences of these is at most their squared distance, so
    the inner product of two such rows is at least the inner product of the vectors.
    """
    parts = np.array_split(np.arange(vectors.shape[1]), min(segments, vectors.shape[1]))
    out = []
    for part in parts:
        sub = vectors[:, part]
        out += [sub.mean(axis=1) * np.sqrt(len(part)), sub.std(axis=1) * np.sqrt(len(part))]
    return np.stack(out, axis=1)


def whole(vectors: np.ndarray, kind) -> np.ndarray:
    """Whole numbers held as doubles, as numbers of another kind."""
    if kind is object:
        return np.array([[int(v) for v in row] for row in vectors], object).reshape(vectors.shape)
    return vectors.astype(kind)


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, segments: tuple[int, ...] = SEGMENTS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and vectors, and scores, of each query's k best in this block; ties go to the smaller id.

    The squared distance of a query and a vector is at least that of their segment statistics, which with the norms bounds the score from above. The k vectors of
    best coarse bound are scored first. Their lowest score is one that the k best reach, so vectors whose bound is less
    are dropped, at every finer resolution again; the survivors are scored.
    """
    if not len(queries) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * vectors.shape[1]
    # Doubles add whole numbers exactly up to here, 64 bits up to there, Python's integers beyond.
    exact = np.float64 if largest < 2.0 ** 53 else np.int64 if largest < 2.0 ** 63 else object
    q, x = whole(queries, exact), whole(vectors, exact)
    floats, levels = vectors.astype(np.float64), []
    with np.errstate(all="ignore"):
        for n in segments:
            levels.append((segment_statistics(queries.astype(np.float64), n), segment_statistics(floats, n)))
    slack = 1e-9 * largest + 1e-6
    # Squares of such numbers would not be finite: no bounds then.
    coarse = levels[0][0] @ levels[0][1].T + slack if largest < 1e300 else np.full((len(q), len(x)), np.inf)
    who, found, scores = [], [], []
    for i in range(len(q)):
        bound = coarse[i]
        bound[ids == query_ids[i]] = -np.inf
        candidates = np.flatnonzero(bound > -np.inf)
        if len(candidates) > k and largest < 1e300:
            first = candidates[np.argpartition(-bound[candidates], k - 1)[:k]]
            floor = (x[first] @ q[i]).min()
            if exact is object:  # scores beyond 64 bits are equal
                floor = -np.inf if floor <= -LARGEST else float(min(floor, LARGEST))
            candidates = candidates[bound[candidates] >= floor]
            for of_q, of_x in levels[1:]:
                candidates = candidates[of_x[candidates] @ of_q[i] + slack >= floor]
        score = x[candidates] @ q[i]
        score = np.array([min(max(s, -LARGEST), LARGEST) for s in score], np.int64) if exact is object else score.astype(np.int64)
        best = np.lexsort((ids[candidates], -score))[:k]
        who.append(np.full(len(best), i))
        found.append(candidates[best])
        scores.append(score[best])
    return np.concatenate(who), np.concatenate(found), np.concatenate(scores)


def quantized(vector: str, scale: int = SCALE):
    """floor(scale * x) of each component, whole numbers as doubles; null for a vector that is null or holds a null or a component that isn't finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    # from 2 ** 53 on every double is a whole number
    floor = lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: floor(x.cast("double") * scale)))


def top_k(
    embeddings: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, scale: int = SCALE,
    segments: tuple[int, ...] = SEGMENTS, block_candidates: int = CANDIDATES, block_queries: int = QUERIES,
) -> DataFrame:
    """Return ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best rows by integer inner product.

    Components become floor(``scale`` * x). Queries are the rows for which the Column ``is_query`` holds; candidates are all rows but
    those of the query's own id. Ties go to the smaller id. Vectors that are null, or hold null or non-finite
    components, and rows without id take no part; shorter vectors count as if filled up with zeros. An id that repeats is one
    query (of its least vector) and as many candidates; a query with fewer candidates returns them all. Empty tables give an empty
    result, other columns are not read. A score beyond 64 bits counts as the largest number of its sign, 2^63 - 1, and ties with others like it. A component that
    isn't finite after scaling counts as non-finite.

    Candidates and queries are dealt by a hash to blocks of about ``block_candidates`` and ``block_queries`` rows, and each
    pair of blocks is one task of bounded size: a row is copied once per block of the other side, and a task returns at most ``k`` rows for each of its queries.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), quantized(vector_col, scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks, q_blocks, width = max(1, -(-sizes[0] // block_candidates)), max(1, -(-sizes[1] // block_queries)), max(1, sizes[2])
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("c"), spread(q_blocks).alias("q"), "id", "v", F.lit(False).alias("asks"))
    queries = asked.select(spread(n_blocks).alias("c"), F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("q"), "id", "v", F.lit(True).alias("asks"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        lengths = np.asarray(lists.value_lengths())
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
        return out

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, vectors = group.column("id").to_numpy().astype(np.int64), matrix(group.column("v"))
        who, found, scores = search_block(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k, segments)
        return pa.table({"query_id": ids[asks][who], "vec_id": ids[~asks][found], "score": scores})

    found = candidates.unionAll(queries).groupBy("c", "q").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
