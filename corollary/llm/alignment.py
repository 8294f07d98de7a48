"""Alignment of the tokens of two tokenizers, and how often the corpus links each pair of ids.

Each text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B). Byte offsets where a token of each ends cut the text into groups, and all
tokens of a group are linked. A pair's count is the number of documents that hold it.

Counting is external: tasks partition their (pair, document) records by a radix of the A id into sorted runs, compressed with zstd and written to
a table. Groups of runs of bounded size are merged through a heap, which counts each pair; as the order is by A id, its highest count is known when its last pair has passed. The runs are then
read a second time beside the totals, and what each record adds flows back to its document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.session import ensure_checkpoint_dir

#: Partitions of the A ids; links that a task sorts at once; bytes of text that it encodes at once.
RADIXES, RUN_LINKS, TEXT_BYTES = 16, 1 << 22, 1 << 20
#: Records that one group of runs holds at most and at least, about; groups of partial counts that one task adds up.
GROUP_RECORDS, LEAST_RECORDS, FAN_IN = 1 << 25, 1 << 20, 32
#: A document with more links is reduced to distinct ids of each group first, and is a run of its own.
HEAVY_LINKS = 1 << 20
#: Bits of a task's document number, of its number within a run at least and at most.
ROW_BITS, LEAST_BITS, MOST_BITS = 40, 12, 24
# How the byte-level tokenizer cuts texts before merging, and bytes that its vocabulary writes as themselves
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: White space runs beyond this are left to the tokenizer's own library: the faster one's patterns need stack for them.
LONG_BLANK = re.compile(r"\s{500}")


# --- the two tokenizers -----------------------------------------------------------------


@dataclass
class Vocabularies:
    """The two tokenizer files, small enough to be sent to every task."""

    byte_bpe: bytes
    piece_bpe: bytes

    @classmethod
    def read(cls, byte_bpe: str, piece_bpe: str) -> Vocabularies:
        return cls(Path(byte_bpe).read_bytes(), Path(piece_bpe).read_bytes())


class Encoders:
    """Encode texts with both; ids, and the bytes of every id."""

    def __init__(self, files: Vocabularies) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(files.byte_bpe)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a byte-level BPE that leaves texts as they are")
        self.own = Tokenizer.from_str(files.byte_bpe.decode())
        self.own.encode_special_tokens = True
        added = {t["content"] for t in spec["added_tokens"]}
        others = (b for b in range(256) if b not in PLAIN_BYTES)
        spelled = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = {bytes(spelled[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        ranks = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        # The faster library merges by id; it is the same where merges are in the order of the ids they make.
        self.fast = None
        if all(x < y for x, y in zip(ranks, ranks[1:], strict=False)):
            self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=vocabulary, special_tokens={})
        self.a_bytes = [b""] * (max([*vocabulary.values(), self.own.get_vocab_size() - 1]) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.piece_bpe)
        self.b_bytes = []
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # Decimal ids followed by what stands after them within a group, and at the end of a group's side.
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.spelled = [f"{i}," for i in ids] + [f"{i}|" for i in ids] + [f"{i};" for i in ids]
        self.width = len(ids)

    def a_ids(self, text: str) -> list[int]:
        if self.fast is not None and not LONG_BLANK.search(text):
            return self.fast.encode_ordinary(text)
        return self.own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of A and B for each text; None if it is null, empty, or if the bytes of one side aren't those of the text after a space."""
        given = [t for t in texts if t]
        pieces = iter(self.pieces.encode(given, num_threads=1) if given else [])
        out: list[tuple[list[int], list[int]] | None] = []
        for t in texts:
            if not t:
                out.append(None)
                continue
            a, b, raw = self.a_ids(" " + t), next(pieces), (" " + t).encode()
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw
            out.append((a, b) if same else None)
        return out


_ENCODERS: dict[int, tuple[Vocabularies, Encoders]] = {}


def encoders(files) -> Encoders:
    """The worker's encoders for a broadcast, made once."""
    value = files.value
    if id(value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(value)] = (value, Encoders(value))  # the value is kept, so that its id isn't given to another
    return _ENCODERS[id(value)][1]


# --- groups and links -------------------------------------------------------------------


@dataclass
class Groups:
    """Tokens of a few documents side by side, and the groups they fall into. Documents and groups are numbered from 0."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    p: np.ndarray  # tokens of A in each group
    q: np.ndarray
    doc: np.ndarray  # document of each group

    @classmethod
    def of(cls, coded: list[tuple[list[int], list[int]]], enc: Encoders) -> Groups:
        """Both sides of a document have the same bytes, so one running offset serves all documents."""
        a = np.concatenate([np.array(x, np.int64) for x, _ in coded])
        b = np.concatenate([np.array(x, np.int64) for _, x in coded])
        a_end, b_end = np.cumsum(enc.a_len[a]), np.cumsum(enc.b_len[b])
        a_last = b_end[np.searchsorted(b_end, a_end)] == a_end
        b_last = a_end[np.searchsorted(a_end, b_end)] == b_end
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n = int(a_last.sum())
        ends = np.cumsum([len(x) for x, _ in coded])
        doc = np.searchsorted(ends, np.flatnonzero(a_last), side="right")
        return cls(a, b, a_group, b_group, np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n), doc)

    def per_doc(self, value: np.ndarray, n_docs: int) -> np.ndarray:
        out = np.zeros(n_docs, np.int64)
        np.add.at(out, self.doc, value)
        return out

    def spelled(self, enc: Encoders, n_docs: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        a_before, b_before = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        a_at, b_at = np.arange(len(self.a)), np.arange(len(self.b))
        last = lambda at, group, before, n: at == (before + n - 1)[group]
        codes[a_at + b_before[self.a_group]] = self.a + enc.width * last(a_at, self.a_group, a_before, self.p)
        codes[b_at + (a_before + self.p)[self.b_group]] = self.b + 2 * enc.width * last(b_at, self.b_group, b_before, self.q)
        ends = np.cumsum(self.per_doc(self.p + self.q, n_docs)).tolist()
        table, codes = enc.spelled, codes.tolist()
        return ["".join(map(table.__getitem__, codes[start:end]))[:-1] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def links(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and document of every link of the documents marked in ``docs``."""
        of_a = self.a_group[docs[self.doc[self.a_group]]]
        at = np.flatnonzero(docs[self.doc[self.a_group]])
        times = self.q[of_a]
        first = (np.cumsum(self.q) - self.q)[of_a]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(self.a[at], times), self.b[np.repeat(first, times) + within], np.repeat(self.doc[of_a], times)

    def distinct_links(self, doc: int, radix: int, radixes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (A id, B id) of one document with the A ids of one radix, and how many links each stands for."""
        own_a = np.flatnonzero((self.doc[self.a_group] == doc) & (radix_of(self.a, radixes) == radix))
        own_b = np.flatnonzero(self.doc[self.b_group] == doc)
        low = 1 << 32
        ga, ca = np.unique(self.a_group[own_a] * low + self.a[own_a], return_counts=True)
        gb, cb = np.unique(self.b_group[own_b] * low + self.b[own_b], return_counts=True)
        start, end = (np.searchsorted(gb // low, ga // low, side) for side in ("left", "right"))
        pairs, weights, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i in range(len(ga)):  # one A id of one group with the group's distinct B ids
            pairs.append((ga[i] % low) * low + gb[start[i] : end[i]] % low)
            weights.append(ca[i] * cb[start[i] : end[i]])
            waiting += end[i] - start[i]
            if waiting > HEAVY_LINKS or i + 1 == len(ga):
                keys, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, inverse, np.concatenate(weights))
                pairs, weights, waiting = [keys], [total], 0
        return pairs[0] // low, pairs[0] % low, weights[0]


def radix_of(a: np.ndarray, radixes: int) -> np.ndarray:
    """A partition of the ids that neighbours don't share."""
    return (a * 2_654_435_761 % (1 << 32)) * radixes >> 32


# --- runs -------------------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    """Non-negative whole numbers, as byte planes under zstd; eight bytes each only where a column needs them."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        wide = 8 if len(c) and int(c.max()) >= 1 << 32 else 4
        out += [bytes([wide]), np.ascontiguousarray(c.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(raw: bytes, n_columns: int) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for _ in range(n_columns):
        wide = data[at]
        planes = np.frombuffer(data, np.uint8, n * wide, at + 1).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{wide}").reshape(-1).astype(np.int64))
        at += 1 + n * wide
    return out


@dataclass
class Runs:
    """A task's records until they are sorted and written."""

    radixes: int
    a_bits: int
    b_bits: int
    keys: list[np.ndarray]
    n: int = 0
    first: int = 0

    @property
    def doc_bits(self) -> int:
        return max(LEAST_BITS, min(MOST_BITS, 63 - (self.radixes - 1).bit_length() - self.a_bits - self.b_bits))

    def add(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> None:
        """Records in one number each: radix, A id, B id, document."""
        key = (radix_of(a, self.radixes) << (self.a_bits + self.b_bits)) | (a << self.b_bits) | b
        self.keys.append((key << self.doc_bits) | (rows - self.first))
        self.n += len(a)

    def flush(self, part: int) -> Iterator[dict]:
        if self.n:
            keys = np.sort(np.concatenate(self.keys))
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(new, len(keys)))
            keys = keys[new]
            yield from self.written(keys >> self.doc_bits, keys & ((1 << self.doc_bits) - 1), times, part)
        self.keys, self.n = [], 0

    def written(self, pairs: np.ndarray, docs: np.ndarray, times: np.ndarray, part: int) -> Iterator[dict]:
        """A run per radix from records sorted by pair and document."""
        radix = pairs >> (self.a_bits + self.b_bits)
        edges = np.searchsorted(radix, np.arange(self.radixes + 1))
        for r in range(self.radixes):
            if edges[r] == edges[r + 1]:
                continue
            part_pairs, d, t = (c[edges[r] : edges[r + 1]] for c in (pairs, docs, times))
            new = np.flatnonzero(np.concatenate([[True], part_pairs[1:] != part_pairs[:-1]]))
            held = np.diff(np.append(new, len(part_pairs)))
            p = part_pairs[new]
            a, b = (p >> self.b_bits) & ((1 << self.a_bits) - 1), p & ((1 << self.b_bits) - 1)
            step = np.diff(d, prepend=0)
            step[new] = d[new]  # documents rise within a pair
            yield {
                "radix": r, "n": len(d), "base": (part << ROW_BITS) + self.first, "pairs": packed(np.diff(a, prepend=0), b, held), "records": packed(step, t),
            }


def pairs_of(raw: bytes) -> list[np.ndarray]:
    a, b, n = unpacked(raw, 3)
    return [np.cumsum(a), b, n]


def merged(runs: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge runs (A id, B id, count) through a heap: each A id once, in order, with its B ids and their counts over all runs."""
    starts = [np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a)) if len(a) else np.zeros(1, np.int64) for a, _, _ in runs]
    heap = [(int(a[0]), k, 0) for k, (a, _, _) in enumerate(runs) if len(a)]
    heapq.heapify(heap)
    while heap:
        current, b, n = heap[0][0], [], []
        while heap and heap[0][0] == current:
            _, k, at = heap[0]
            part = slice(starts[k][at], starts[k][at + 1])
            b.append(runs[k][1][part])
            n.append(runs[k][2][part])
            if at + 2 < len(starts[k]):
                heapq.heapreplace(heap, (int(runs[k][0][starts[k][at + 1]]), k, at + 1))
            else:
                heapq.heappop(heap)
        if len(b) == 1:
            yield current, b[0], n[0]
        else:
            ids, where = np.unique(np.concatenate(b), return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, where, np.concatenate(n))
            yield current, ids, total


# --- Spark side -------------------------------------------------------------------------


def _written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/alignment-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _coded(docs: DataFrame, files, radixes: int, run_links: int, heavy: int, digest: bool) -> DataFrame:
    """One row per document with its counts and groups, and rows of runs, which have no document."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, row = encoders(files), TaskContext.get().partitionId(), 0
        runs = Runs(radixes, len(enc.a_bytes).bit_length(), len(enc.b_bytes).bit_length(), [])

        def as_batch(rows: list[dict], doc: pa.DataType) -> pa.RecordBatch:
            kind = pa.schema([
                ("row", pa.int64()), ("doc", doc), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
                ("radix", pa.int32()), ("n", pa.int64()), ("base", pa.int64()), ("pairs", pa.binary()), ("records", pa.binary()),
            ])
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        for batch in batches:
            ids, texts, doc_type = batch.column(0).to_pylist(), batch.column(1), batch.schema.field(0).type
            sizes = np.cumsum(_lengths(texts))
            start = 0
            while start < len(ids):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TEXT_BYTES, side="right")))
                coded = enc.encode(texts.slice(start, end - start).to_pylist())
                held = [i for i, c in enumerate(coded) if c is not None]
                lines = [{"row": (part << ROW_BITS) + row + i, "doc": ids[start + i], "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""} for i in range(len(coded))]
                if row + len(coded) - runs.first >= 1 << runs.doc_bits:
                    yield as_batch(list(runs.flush(part)), doc_type)
                if not runs.n:
                    runs.first = row
                if held:
                    groups = Groups.of([coded[i] for i in held], enc)
                    n, n_links = len(held), groups.per_doc(groups.p * groups.q, len(held))
                    figures = zip(
                        held, groups.per_doc(groups.p, n).tolist(), groups.per_doc(groups.q, n).tolist(), np.bincount(groups.doc, minlength=n).tolist(),
                        n_links.tolist(), groups.spelled(enc, n), strict=True,
                    )
                    for i, n_a, n_b, n_groups, links, spelled in figures:
                        lines[i] |= {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": links}
                        lines[i]["groups"] = hashlib.sha256(spelled.encode()).hexdigest() if digest else spelled
                    rows = np.array(held, np.int64) + row
                    a, b, doc = groups.links(n_links <= heavy)
                    runs.add(a, b, rows[doc])
                    for k in np.flatnonzero(n_links > heavy):
                        own = Runs(radixes, runs.a_bits, runs.b_bits, [], first=int(rows[k]))
                        for r in range(radixes):
                            a, b, times = groups.distinct_links(int(k), r, radixes)
                            key = (radix_of(a, radixes) << (own.a_bits + own.b_bits)) | (a << own.b_bits) | b
                            for line in own.written(key, np.zeros(len(key), np.int64), times, part):
                                yield as_batch([line], doc_type)
                yield as_batch(lines, doc_type)
                if runs.n >= run_links:
                    yield as_batch(list(runs.flush(part)), doc_type)
                row, start = row + len(coded), end
        if runs.n:
            yield as_batch(list(runs.flush(part)), doc_type)

    doc = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(
        code, f"row long, doc {doc}, n_a long, n_b long, n_groups long, n_links long, groups string, radix int, n long, base long, pairs binary, records binary",
    )


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)


def align(
    docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False, radixes: int = RADIXES,
    run_links: int = RUN_LINKS, heavy_links: int = HEAVY_LINKS, group_records: int = GROUP_RECORDS, least_records: int = LEAST_RECORDS,
) -> DataFrame:
    """One row per document: its id, ``n_a, n_b`` (tokens), ``n_groups, n_links, n_best, count_sum`` and ``groups`` (``a1,a2|b1;a3|b2,b3``: ids in order).

    ``count_sum`` adds the corpus-wide document counts of all links' id pairs; ``n_best`` are the links whose count is the highest of their A id, ties included.
    With ``digest`` the column ``groups`` is the SHA-256 of that text. Texts that are null or empty, or whose tokens don't give the bytes of a space and the text, have zeros
    and empty groups. Every row is a document of its own, also if its id or all of it repeats, or is null. Other columns are not read; an empty table gives an empty result.

    The tokenizer files are broadcast: they are a few MB, and the vocabularies bound the table of pairs, of which a task holds the share of one radix. A hot A id is as many groups of runs as its
    records fill, whose partial counts are added up in a tree of ``FAN_IN``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(files)
    doc = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    coded = _written(_coded(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), shared, radixes, run_links, heavy_links, digest))
    runs = coded.where("radix is not null")
    sizes = {r["radix"]: r["n"] for r in runs.groupBy("radix").agg(F.sum("n").alias("n")).collect()}  # one row per radix
    most = max(least_records, min(group_records, sum(sizes.values()) // (4 * radixes)))
    salts = {r: -(-n // most) for r, n in sizes.items()}
    of_radix = F.broadcast(spark.createDataFrame(list(salts.items()), "radix int, salts int"))  # one row per radix
    salted = runs.join(of_radix, "radix").withColumn("salt", F.pmod(F.xxhash64("base"), F.col("salts")).cast("int"))
    counted = "radix int, salt int, pairs binary"

    def count(key: tuple, group: pa.Table) -> pa.Table:
        """The number of documents of each pair of a group of runs."""
        a, b, n = [], [], []
        for of, ids, counts in merged([pairs_of(raw.as_py()) for raw in group.column("pairs")]):
            a.append(np.full(len(ids), of))
            b.append(ids)
            n.append(counts)
        pairs = packed(np.diff(np.concatenate(a), prepend=0), np.concatenate(b), np.concatenate(n))
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "pairs": pa.array([pairs], pa.binary())})

    totals = salted.select("radix", "salt", "pairs").groupBy("radix", "salt").applyInArrow(count, counted)
    left = max(salts.values(), default=1)
    while left > 1:
        left = -(-left // FAN_IN)
        totals = totals.withColumn("salt", F.pmod("salt", F.lit(left))).groupBy("radix", "salt").applyInArrow(count, counted)
    beside = (
        _written(totals.select("radix", "pairs")).join(of_radix, "radix")
        .select("radix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pairs")
    )

    def give_back(group: pa.Table, totals: pa.Table) -> pa.Table:
        """What the records of a group of runs add to their documents."""
        rows, best, added = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(group):
            a, b, n = pairs_of(totals.column("pairs")[0].as_py())
            known, new = (a << 32) | b, np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            highest = np.repeat(np.maximum.reduceat(n, new), np.diff(np.append(new, len(a)))) == n
            for pairs, records, base in zip(group.column("pairs"), group.column("records"), group.column("base").to_pylist(), strict=True):
                a, b, held = pairs_of(pairs.as_py())
                step, times = unpacked(records.as_py(), 2)
                at = np.repeat(np.searchsorted(known, (a << 32) | b), held)
                before = np.cumsum(step)
                first = np.cumsum(held) - held
                doc = before - np.repeat((before - step)[first], held)
                total, top = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(total, doc, times * n[at])
                np.add.at(top, doc, times * highest[at])
                some = np.flatnonzero(total)
                rows.append(some + base)
                best.append(top[some])
                added.append(total[some])
        return pa.table({"row": np.concatenate(rows), "n_best": np.concatenate(best), "count_sum": np.concatenate(added)})

    given = (
        salted.select("radix", "salt", "base", "pairs", "records").groupBy("radix", "salt").cogroup(beside.groupBy("radix", "salt"))
        .applyInArrow(give_back, "row long, n_best long, count_sum long")
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    lines = coded.where("row is not null").select("row", F.col("doc").cast(doc).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return lines.join(given, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
