"""Tables of finished model work, so that no text is embedded or annotated twice.

A store is a folder of Parquet. Rows are keyed by the SHA-256 of the whole text, and lie in
folders by commit and by the key's first digit. Next to them a list of files has one row per file:
its rows, a checksum and a Bloom filter of its keys. What is not in the list does not
count, so a commit that broke off leaves nothing behind. A reader opens listed files only, and of
those only the ones that may hold a key it wants.
"""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.session import folder_exists

#: Rows per file at most.
CHUNK_ROWS = 50_000
#: Wanted keys up to which the files' filters are asked; more keys than that are in nearly all files.
FILTER_KEYS = 10_000
#: Bits per key of a filter, and bits that a key sets.
FILTER_BITS, FILTER_PROBES = 10, 7
FILES_SCHEMA = "commit string, seen long, bucket string, file string, rows long, checksum long, filter binary"


def _probes(keys: Sequence[str], bits: int) -> np.ndarray:
    """The bits of each key, in equal steps from a start."""
    hashes = np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2)
    start, step = hashes[:, :1], hashes[:, 1:] | np.uint64(1)
    return ((start + np.arange(FILTER_PROBES, dtype=np.uint64) * step) % np.uint64(bits)).astype(np.int64)


def bloom_filter(keys: Sequence[str]) -> bytes:
    bits = np.zeros(max(64, -(-len(keys) * FILTER_BITS // 8) * 8), bool)
    if len(keys):
        bits[_probes(keys, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_bytes: bytes, keys: Sequence[str]) -> bool:
    """Whether a file may hold one of the keys. Never wrongly false."""
    bits = np.unpackbits(np.frombuffer(filter_bytes, np.uint8)).astype(bool)
    return bool(len(keys)) and bool(bits[_probes(keys, len(bits))].all(axis=1).any())


@dataclass(frozen=True)
class File:
    commit: str
    seen: int
    bucket: str
    file: str
    rows: int


@dataclass(frozen=True)
class Store:
    """The rows stored under one ``cache_name``."""

    path: str
    cache_name: str
    schema: str
    keys: tuple[str, ...]

    @property
    def root(self) -> str:
        return f"{self.path}/cache_name={self.cache_name}"

    def files(self, spark: SparkSession) -> DataFrame:
        """The list of files, one row each."""
        try:
            return spark.read.schema(FILES_SCHEMA).parquet(f"{self.root}/files")
        except AnalysisException:
            return spark.createDataFrame([], FILES_SCHEMA)

    def snapshot(self, spark: SparkSession, wanted: DataFrame | None = None) -> list[File]:
        """The listed files that may hold a wanted key: one short record for each file of thousands of rows."""
        files = self.files(spark)
        if wanted is not None:
            keys = sorted(r[0] for r in wanted.select("text_key").distinct().limit(FILTER_KEYS + 1).collect())
            if len(keys) <= FILTER_KEYS:
                files = _filtered(files, keys)
        columns = ["commit", "seen", "bucket", "file", "rows"]
        return sorted((File(*r) for r in files.select(*columns).distinct().collect()), key=lambda f: (f.seen, f.commit, f.file))

    def commits(self, spark: SparkSession) -> set[str]:
        return {r[0] for r in self.files(spark).select("commit").distinct().collect()}

    def _open(self, spark: SparkSession, files: Sequence[File]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.root}/data/{f.file}" for f in files))

    def damaged(self, spark: SparkSession, files: Sequence[File]) -> list[File]:
        """Files that are gone, can't be opened, or have another number of rows than listed. Reads the files' ends only."""
        there = [f for f in files if folder_exists(spark, f"{self.root}/data/{f.file}")]
        if not there:
            return list(files)
        found = spark.read.schema(self.schema).option("ignoreCorruptFiles", True).parquet(*(f"{self.root}/data/{f.file}" for f in there))
        counts = {
            r["name"]: r["count"]
            for r in found.groupBy(F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("name")).count().collect()
        }
        return [f for f in files if counts.get(f.file, 0) != f.rows]

    def verify(self, spark: SparkSession) -> DataFrame:
        """``file, rows, found_rows, intact``: every listed file read in full and held against its checksum."""
        listed = self.files(spark).select("file", "rows", "checksum").distinct()
        names = self.snapshot(spark)
        bad = set(self.damaged(spark, names))
        read = self._open(spark, [f for f in names if f not in bad])
        found = read.groupBy(F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("file")).agg(
            F.count("*").alias("found_rows"), F.bit_xor(F.xxhash64(*read.columns)).alias("found_checksum")
        )
        return listed.join(found, "file", "left").select(
            "file", "rows", F.coalesce("found_rows", F.lit(0)).alias("found_rows"),
            F.coalesce((F.col("rows") == F.col("found_rows")) & F.col("checksum").eqNullSafe(F.col("found_checksum")), F.lit(False)).alias("intact"),
        )

    def read(self, spark: SparkSession, wanted: DataFrame | None = None, snapshot: Sequence[File] | None = None) -> DataFrame:
        """Stored rows, each key once; of the keys in ``wanted`` if that is given.

        Files that can't be read are named in a warning, and their keys count as not stored. A commit leaves out what earlier ones hold, so
        rows needn't be grouped; only commits that were published at the same moment may hold a key twice, and are made unique here.
        """
        files = self.snapshot(spark, wanted) if snapshot is None else list(snapshot)
        bad = self.damaged(spark, files) if files else []
        if bad:
            warnings.warn(f"the store has lost {', '.join(f'{self.root}/data/{f.file}' for f in bad)}; their keys count as not stored", stacklevel=2)
            files = [f for f in files if f not in bad]
        # Commits in sequence have seen 0, 1, 2 .. others. From the first number that occurs twice on, commits may not know of each other.
        commits = sorted({(f.seen, f.commit) for f in files})
        twice = [a for (a, _), (b, _) in zip(commits, commits[1:], strict=False) if a == b]
        first = min(twice, default=None)
        rows = self._open(spark, [f for f in files if first is None or f.seen < first])
        if first is not None:
            raced = self._open(spark, [f for f in files if f.seen >= first])
            rows = rows.unionByName(raced.dropDuplicates(list(self.keys)))
        return rows if wanted is None else rows.join(wanted.select(*(c for c in wanted.columns if c in self.keys)).distinct(), [c for c in wanted.columns if c in self.keys], "left_semi")

    def append(self, rows: DataFrame, *, commit: str | None = None, snapshot: Sequence[File] | None = None) -> None:
        """Add rows as one commit, published when all of its files are written.

        ``snapshot`` are the files that the rows are known not to repeat; keys of files listed since are left out. A
        commit of a name that is already published is not written again.
        """
        spark = rows.sparkSession
        commit = commit or uuid.uuid4().hex
        listed = self.snapshot(spark)
        published = {f.commit for f in listed}
        if commit in published:
            return
        if snapshot is None:
            rows = rows.dropDuplicates(list(self.keys))
        known = {f.file for f in snapshot or ()}
        since = [f for f in listed if f.file not in known]
        if since:
            bad = self.damaged(spark, since)
            rows = rows.join(self._open(spark, [f for f in since if f not in bad]).select(*self.keys), list(self.keys), "left_anti")
        folder = f"{self.root}/data/commit={commit}"
        # One file per bucket where it is small; adaptive execution splits a large one.
        (
            rows.withColumn("bucket", F.substring("text_key", 1, 1)).hint("rebalance", "bucket")
            .write.mode("overwrite").option("maxRecordsPerFile", CHUNK_ROWS).partitionBy("bucket").parquet(folder)
        )
        schema = f"{self.schema}, bucket string"
        names = spark.read.schema(schema).parquet(folder).select(
            "bucket", F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("file"), "text_key",
            F.xxhash64(*(f.name for f in self._open(spark, []).schema)).alias("hash"),
        )

        def describe(group: pa.Table) -> pa.Table:
            hashes = group.column("hash").to_numpy()
            return pa.table({
                "commit": [commit], "seen": pa.array([len(published)], pa.int64()), "bucket": group.column("bucket")[:1], "file": group.column("file")[:1],
                "rows": pa.array([len(group)], pa.int64()), "checksum": pa.array([np.bitwise_xor.reduce(hashes)], pa.int64()),
                "filter": pa.array([bloom_filter(group.column("text_key").to_pylist())], pa.binary()),
            })

        # groups are files, of CHUNK_ROWS rows at most
        names.groupBy("file").applyInArrow(describe, FILES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/files")


def _filtered(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose bucket and filter admit one of at most ``FILTER_KEYS`` keys."""
    by_bucket: dict[str, list[str]] = {}
    for key in keys:
        by_bucket.setdefault(key[:1], []).append(key)

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [by_bucket.get(b, []) for b in batch.column("bucket").to_pylist()]
            yield batch.filter(pa.array([may_hold(f.as_py(), w) for f, w in zip(batch.column("filter"), wanted, strict=True)], pa.bool_()))

    return files.mapInArrow(admit, FILES_SCHEMA)


def embedding_store(path: str, cache_name: str) -> Store:
    return Store(path, cache_name, "text_key string, text string, embedding array<float>", ("text_key",))


def annotation_store(path: str, cache_name: str) -> Store:
    return Store(path, cache_name, "concept string, text_key string, value int", ("concept", "text_key"))
