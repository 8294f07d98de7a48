"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index over them, and the groups it links.

A fingerprint is the majority vote of 64-bit shingle hashes. Distinct fingerprints are sorted by their rank in the
reflected Gray code, in which neighbours share most bits. Contiguous runs of that order are the nodes of an index: a node
keeps the bits that all its fingerprints share and its parent's do not, as a mask and a pattern. A search goes down
from the root, adds up the differences from the patterns passed so far, and drops a whole node as soon as they exceed the
allowed distance. The top of the index, a tree over prefixes, is small; it deals fingerprints to cells. Below it each cell
is one task with an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corollary.llm.components import connected_components
from corollary.session import cut_lineage

#: Words of a shingle and differing bits of a link.
SHINGLE = 3
DISTANCE = 2
#: Seed of the shingle hash.
SEED = 42
#: Fingerprints of a cell, about, and the longest prefix that the cells' tree may look at.
CELL_ROWS = 8192
PREFIX_BITS = 24
#: Fingerprints of a leaf run, children of an upper node, searches that go down together.
LEAF, FAN, TOGETHER = 16, 8, 512
#: Shingles whose votes are added at once.
VOTES = 1 << 16


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned, of one UTF-8 text; zero if it has no word."""
    found = text.lower().split()  # on bytes: A-Z only, and splitting at 20, 09-0D
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = ends - [len(w) + 1 for w in found]
    n = max(1, len(found) - shingle + 1)
    last = (ends[shingle - 1:] if len(found) >= shingle else ends[-1:]) - 1
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, VOTES):
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[at:at + VOTES].tolist(), last[at:at + VOTES].tolist(), strict=False)]
        votes = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += votes.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprint(text: Column | str, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed 64-bit integer; null and blank texts have zero."""

    @arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        values = [fingerprint_of(t or b"", shingle) for t in column.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return of(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray code: every bit becomes the parity of the bits from the top to it."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Masked bit patterns over a Gray-sorted array of distinct codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (first child, mask, pattern), leaves' parents first
        every, some = self.codes, self.codes
        size = LEAF
        masks, patterns = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        starts = []
        while len(every) > 1 or not starts:
            first = np.arange(0, len(every), size)
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            starts.append(first)
            masks.append(~(every ^ some))
            patterns.append(every)
            size = FAN
        for k, first in enumerate(starts):
            own = masks[k].copy()
            parent = np.repeat(masks[k + 1], np.diff(np.append(first, len(own))))
            own &= ~parent  # bits that the parent has settled aren't looked at again
            self.levels.append((np.append(first, len(own)), own, patterns[k]))
        self.root = (masks[-1], patterns[-1])

    def search(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in ``queries``, position in ``self.codes``) within ``distance``, a part at a time."""
        for at in range(0, len(queries), TOGETHER):
            q = queries[at:at + TOGETHER]
            so_far = np.bitwise_count((q ^ self.root[1][0]) & self.root[0][0]).astype(np.int16)
            who = np.flatnonzero(so_far <= distance)
            node, so_far = np.zeros(len(who), np.int64), so_far[who]
            for first, mask, pattern in reversed(self.levels):
                count = first[node + 1] - first[node]
                child = np.repeat(first[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
                who, so_far = np.repeat(who, count), np.repeat(so_far, count)
                so_far = so_far + np.bitwise_count((q[who] ^ pattern[child]) & mask[child])
                keep = so_far <= distance
                who, node, so_far = who[keep], child[keep], so_far[keep]
            yield who + at, node


class Forest:
    """Disjoint sets of 0 .. n-1, each named by its smallest member, that take many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class CellTree:
    """Upper nodes of the index: a tree over prefixes, whose leaves are cells."""

    def __init__(self, counts: dict[int, int], bits: int, cell_rows: int):
        self.cells: list[tuple[int, int]] = []  # (prefix, its bits)
        totals = [counts]
        for _ in range(bits):
            up: dict[int, int] = {}
            for prefix, n in totals[-1].items():
                up[prefix >> 1] = up.get(prefix >> 1, 0) + n
            totals.append(up)
        totals.reverse()
        self.children: dict[tuple[int, int], int] = {}
        stack = [(0, 0)]
        while stack:
            prefix, depth = stack.pop()
            if depth == bits or totals[depth].get(prefix, 0) <= cell_rows:
                self.children[prefix, depth] = len(self.cells)
                self.cells.append((prefix, depth))
            else:
                stack += [(prefix * 2 + 1, depth + 1), (prefix * 2, depth + 1)]

    def route(self, codes: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, positions, differences from its prefix) for all cells that may hold codes within ``distance``."""
        stack = [(0, 0, np.arange(len(codes)), np.zeros(len(codes), np.int16))]
        while stack:
            prefix, depth, at, so_far = stack.pop()
            if not len(at):
                continue
            cell = self.children.get((prefix, depth))
            if cell is not None:
                yield cell, at, so_far
                continue
            bit = ((codes[at] >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int16)
            for side in (0, 1):
                n = so_far + (bit != side)
                keep = n <= distance
                stack.append((prefix * 2 + side, depth + 1, at[keep], n[keep]))


def links(fingerprints: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct codes of column ``fp`` within ``distance`` bits.

    Not every pair: a task links the codes it holds, and returns one edge from each to the smallest of its set, so a
    dense group makes as many rows as it has codes. A code goes to its own cell, and as a visitor to the cells whose
    prefix is near; of two cells one visits the other.
    """
    spark = fingerprints.sparkSession
    n = fingerprints.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    bits = min(PREFIX_BITS, max(1, int(np.ceil(np.log2(max(2, n / cell_rows)))) + 4))
    # A bounded table: at most 2 ** bits rows, which is 32 prefixes for each cell.
    counts = {r[0]: r[1] for r in fingerprints.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p")).count().collect()}
    tree = CellTree(counts, bits, cell_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            routes = list(tree.route(codes, distance))
            home = np.empty(len(codes), np.int64)
            for cell, at, _ in routes:
                depth = tree.cells[cell][1]
                prefix = np.uint64(tree.cells[cell][0])
                inside = (codes[at] >> np.uint64(64 - depth) if depth else codes[at] & np.uint64(0)) == prefix
                home[at[inside]] = cell
            for cell, at, so_far in routes:
                own = home[at] == cell
                # Of two cells, the lower visits if the sum of their numbers is even, else the higher.
                visits = ~own & (((home[at] + cell) % 2 == 0) == (home[at] < cell))
                take = own | visits
                if take.any():
                    yield pa.record_batch({
                        "cell": pa.array(np.full(take.sum(), cell, np.int32)),
                        "fp": pa.array(codes[at[take]].view(np.int64)),
                        "visits": pa.array(visits[take]),
                    })

    def connect(group: pa.Table) -> pa.Table:
        codes = group.column("fp").to_numpy().view(np.uint64)
        visits = group.column("visits").to_numpy()
        index = GrayIndex(codes[~visits]) if (~visits).any() else None
        if index is None:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        every = np.concatenate([index.codes, codes[visits]])
        forest = Forest(len(every))
        for who, found in index.search(every, distance):
            forest.link(who, found)
        moved = np.flatnonzero(forest.root != np.arange(len(every)))
        return pa.table({"a": pa.array(every[moved].view(np.int64)), "b": pa.array(every[forest.root[moved]].view(np.int64))})

    dealt = fingerprints.select("fp").mapInArrow(deal, "cell int, fp long, visits boolean")
    return dealt.groupBy("cell").applyInArrow(connect, "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, distance: int = DISTANCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    Texts are lower-cased (A-Z), cut into words and shingles of ``shingle`` words; shorter texts are one shingle, texts
    without a word (null, empty, blank) have fingerprint zero and are linked like any other. Documents are linked if
    their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id that links reach, itself
    included. Repeated rows and ids stay as they are. A null id keeps its row and is never the smallest; a group in which
    all ids are null has a null ``component_id``. Other columns are not read, an empty table gives an empty result.

    Texts are read once, their fingerprints are written to the checkpoint folder; nothing but fingerprints is shuffled.
    Exact copies are one fingerprint each from the first aggregate on.
    """
    marked = cut_lineage(docs.select(F.col(id_col).alias(id_col), fingerprint(text_col, shingle).alias("fp")))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(distinct.select("fp"), distance, cell_rows))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "root").select("fp", "component_id")
    # Copies meet in one key here; the rows are two numbers, and adaptive execution splits the partition.
    return marked.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, distance: int = DISTANCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of every group: that of the smallest id, then of the smallest hash of its text.

    Groups are those of :func:`simhash_groups`, over all rows. Rows that share an id but not the text are documents of their own; rows equal in both are one document, of
    which one row stays, that of the smallest hash of its columns. Documents without an id come last in a group. Only fingerprints and hashes are
    shuffled to find them.
    """
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marks = {
        "__id": F.col(f"`{id_col}`"), "__text": F.xxhash64(F.col(f"`{text_col}`")), "__row": F.xxhash64(*(F.col(f"`{c}`") for c in hashable)),
    }
    marked = cut_lineage(docs.select(*(c.alias(name[2:]) for name, c in marks.items()), fingerprint(text_col, shingle).alias("fp")))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(place).alias("least")))
    roots = connected_components(links(distinct.select("fp"), distance, cell_rows))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("of"), F.col("least.text").alias("with"))
    rows = marked.groupBy("id", "text", "row").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(first, F.col("id").eqNullSafe(F.col("of")) & (F.col("text") == F.col("with")), "left_semi")
    chosen = cut_lineage(rows.groupBy("id", "text").agg(F.min(F.struct("row", "n")).alias("r")).select("id", "text", "r.row", "r.n"))

    keyed = docs.select(*(c.alias(name) for name, c in marks.items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__all"))

    def rows_of(which: str) -> DataFrame:
        named = chosen.where(which)
        same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__text") == F.col("text")) & (F.col("__row") == F.col("row"))
        return keyed.join(named, same, "left_semi")

    whole = rows_of("n > 1").dropDuplicates(list(marks))  # rows that repeat whole
    return rows_of("n = 1").unionAll(whole).select(*(F.col("__all")[c].alias(c) for c in docs.columns))
