"""Conflict-constrained best-fit packing of documents into training sequences of a fixed length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import BLANK, WORD

#: Words of a bin, and packed pieces of a block, about.
CAPACITY = 2048
BLOCK_ROWS = 2048


class Bins:
    """Open bins in the order of what they have left, each with bitmaps of the sources and clusters in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (left, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece whose source and cluster are single bits (0: in conflict with nothing); return bin and offset.

        The search begins at the bin with the least sufficient room and goes on to its successors until one has neither
        bit: the tightest compatible bin, of the earliest among equals. Without one a bin is opened.
        """
        order, sources, clusters = self.order, self.sources, self.clusters
        for at in range(bisect_left(order, (length, -1)), len(order)):
            left, b = order[at]
            if not (sources[b] & source or clusters[b] & cluster):
                del order[at]
                break
        else:
            left, b = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            self.filled.append(0)
        offset = self.filled[b]
        sources[b] |= source
        clusters[b] |= cluster
        self.filled[b] += length
        insort(order, (left - length, b))
        return b, offset


def _bits(keys: Iterable) -> list[int]:
    """A bit for every key that occurs, in the order of first occurrence; none for null."""
    found: dict = {}
    return [0 if k is None else 1 << found.setdefault(k, len(found)) for k in keys]


def pack_block(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece of one block; pieces come in the order in which they are placed."""
    bins = Bins(capacity)
    placed = [bins.put(*piece) for piece in zip(lengths, _bits(sources), _bits(clusters), strict=True)]
    return [p[0] for p in placed], [p[1] for p in placed]


def word_count(text: Column | str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD))


def copy_key(text: Column | str = "text") -> Column:
    """Cluster of exact copies, but for case and white space: a 128-bit digest; null for texts without a word."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), BLANK + "+", " "))
    return F.when(plain != "", F.md5(plain))


def pack(
    items: DataFrame, id_col: str, length: Column | str, source: Column | str, cluster: Column | str, *,
    capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Return one row per piece: the id, ``piece`` (from 0), ``start`` and ``length`` within the document, ``bin``, ``offset``.

    A document longer than ``capacity`` is cut into pieces; all but the last fill a bin each and need no search. The
    rest, one piece per document, are dealt by a hash to blocks of about ``block_rows``, whose number grows with the
    table, and each block is packed in one task, longest first, ties by id and cluster. No bin holds two pieces of one
    source or of one duplicate cluster, nor more than ``capacity``. Equal keys need not meet, so a source or
    cluster with a third of all rows is spread over all blocks; as only one piece of it fits a bin, it then sets the
    number of bins.

    A null source or cluster is in conflict with nothing. A null or negative length counts as 0: such a document is a
    piece of length 0 in some bin. Repeated rows are pieces of their own (a full piece gets the repeat's number in its
    bin's name); equal rows may swap places. An empty table gives an empty result; other columns are not read.
    """
    spark = items.sparkSession
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    base = items.select(
        F.col(id_col).alias("id"), F.greatest(F.coalesce(as_column(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
        as_column(source).alias("source"), as_column(cluster).alias("cluster"),
    ).withColumn("full", F.when(F.col("n") > capacity, F.expr(f"(n - 1) div {capacity}")).otherwise(F.lit(0)).cast("long"))
    blocks = max(1, -(-items.count() // block_rows))
    # A salt that differs between the rows of a partition, and is the same when a task is run again.
    whole = base.where("full > 0").select("id", "full", F.monotonically_increasing_id().alias("row")).select(
        "id", "row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece")
    ).select(
        "id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * capacity).cast("long").alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("row").cast("string")).alias("bin"),
        F.lit(0).cast("long").alias("offset"),
    )

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rest", "descending"), ("id", "ascending"), ("cluster", "ascending")])
        rest = group.column("rest")
        bins, offsets = pack_block(rest.to_pylist(), group.column("source").to_pylist(), group.column("cluster").to_pylist(), capacity)
        number = group.column("block")[0].as_py()
        return pa.table({
            "id": group.column("id"), "piece": group.column("full"),
            "start": pa.array(np.asarray(group.column("full").to_numpy()) * capacity), "length": rest,
            "bin": pa.array([f"{number}-{b}" for b in bins]), "offset": pa.array(offsets, pa.int64()),
        })

    kind = dict(base.dtypes)["id"]
    packed = (
        base.withColumn("rest", F.col("n") - F.col("full") * capacity)
        .withColumn("block", F.pmod(F.xxhash64("id", "n", "cluster", F.lit("block")), F.lit(blocks)))
        .select("block", "id", "full", "rest", "source", "cluster").groupBy("block")
        .applyInArrow(block, f"id {kind}, piece long, start long, length long, bin string, offset long")
    )
    return packed.unionAll(whole).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pack documents by their number of words; sources are column ``source``, clusters are exact copies of a text."""
    return pack(docs, "doc_id", word_count(), "source", copy_key(), capacity=capacity, block_rows=block_rows)
