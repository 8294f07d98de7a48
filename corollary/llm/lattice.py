"""SentencePiece encoding by lattices of distinct units, and decoding.

A text is cut into units that no piece of the vocabulary crosses. Spark deals texts to blocks, takes the distinct units of each
block and brings equal units of all blocks together, so that the lattice of a unit is gone through once. Units and their ids then
return to the blocks, where texts are put together. All three shuffles carry compressed columns or short rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The mark that stands for a space, and what a score of an unknown character is below the lowest score.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Ways to cut a text into units, finest first: runs of letters, of digits, of other characters, each with the spaces before it; runs without a space.
CUTS = (
    rf"{SPACE}*[^\W\d_¹²³]+|{SPACE}*\d+|{SPACE}*(?:[^\w{SPACE}]|[_¹²³])+|{SPACE}+",
    rf"{SPACE}*[^{SPACE}]+|{SPACE}+",
)
#: Documents of a block, about; units that are packed for their blocks together.
BLOCK_ROWS = 8192
PACK_ROWS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores, ids of the 256 bytes, and whether a space is put before every text."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    leading_space: bool = True

    @cached_property
    def unknown_score(self) -> float:
        return min(score for _, _, score in self.pieces) - UNKNOWN_PENALTY

    @cached_property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.pieces)

    @cached_property
    def edges(self) -> dict[str, tuple[float, int] | None]:
        """Score and id of every piece, the best if it is listed twice; null for other beginnings of pieces."""
        out: dict[str, tuple[float, int] | None] = {piece[:k]: None for piece, _, _ in self.pieces for k in range(1, len(piece))}
        for piece, i, score in self.pieces:
            out[piece] = max(out.get(piece) or (score, i), (score, i))
        return out

    @cached_property
    def units(self) -> str:
        """The finest cut that leaves all pieces whole, so that encoding units apart is exact."""
        for cut in CUTS:
            if all(re.findall(cut, piece) == [piece] for piece, _, _ in self.pieces):
                return cut
        raise ValueError("a piece of the vocabulary has a space after other characters")

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        out = {i: piece.replace(SPACE, " ").encode() for piece, i, _ in self.pieces}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    def escaped(self, text: str) -> str:
        return (SPACE if self.leading_space and text else "") + text.replace(" ", SPACE)


def load_vocabulary(path: str, leading_space: bool = True) -> Vocabulary:
    """Read a model file with byte fallback and no normalization; control, unknown and unused pieces take no part."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    in_bytes = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    return Vocabulary(
        tuple((model.id_to_piece(i), i, model.get_score(i)) for i in plain), tuple(in_bytes[f"<0x{b:02X}>"] for b in range(256)), leading_space
    )


def _best_ids(unit: str, vocabulary: Vocabulary) -> list[int]:
    """Ids along the best way through the lattice of a unit; ties go to the longer last piece. Unknown characters become their bytes."""
    edges, longest, n, unknown = vocabulary.edges, vocabulary.longest, len(unit), (vocabulary.unknown_score, -1)
    ways: list[tuple[float, int, int] | None] = [None] * (n + 1)  # the best (score, start, id) into each place
    score = 0.0
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            edge = edges.get(unit[start:end])
            if edge is None:
                if end == start + 1:
                    edge = unknown
                elif unit[start:end] in edges:
                    continue
                else:
                    break  # begins no piece
            way, total = ways[end], score + edge[0]
            if way is None or total > way[0]:  # starts rise, so that of equal ways the longer last piece came first
                ways[end] = (total, start, edge[1])
        score = ways[start + 1][0]
    ids: list[int] = []
    while n:
        _, start, i = ways[n]
        ids += [i] if i >= 0 else [vocabulary.byte_ids[b] for b in reversed(unit[start:n].encode())]
        n = start
    return ids[::-1]


def _packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of each ``block``, without it, as one compressed part."""
    squeeze = zstandard.ZstdCompressor(level=9)
    rows = rows.take(pa.array(np.argsort(rows.column("block").to_numpy(), kind="stable"))).combine_chunks()
    numbers, first = np.unique(rows.column("block").to_numpy(), return_index=True)
    ends = np.append(first[1:], rows.num_rows)
    for number, a, b in zip(numbers.tolist(), first.tolist(), ends.tolist(), strict=True):
        sink = pa.BufferOutputStream()
        some = rows.slice(a, b - a).drop_columns(["block"])
        with pa.ipc.new_stream(sink, some.schema) as writer:
            writer.write_table(some)
        yield pa.record_batch({"block": pa.array([number], pa.int32()), "part": pa.array([squeeze.compress(sink.getvalue())], pa.binary())})


def _unpacked(part: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(part)).read_all()


def _encoder(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of ``block, unit`` in order of units to parts of ``unit, ids`` by block; equal units are encoded once."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, held, n = None, [], [], 0
        for batch in batches:
            lists = []
            for unit in batch.column("unit").to_pylist():
                if unit != last:
                    last, ids = unit, _best_ids(unit, vocabulary)
                lists.append(ids)
            held.append(pa.table({"block": batch.column("block"), "unit": batch.column("unit"), "ids": pa.array(lists, pa.list_(pa.int32()))}))
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from _packed(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield from _packed(pa.concat_tables(held))

    return coded


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: the id, ``ids`` and ``n_ids``: the best segmentation of the whole text.

    Best is the largest sum of scores, ties going to the longer last piece; that is what a unigram model of this vocabulary
    does. Spaces are marks, one is put before the text if the vocabulary says so, and characters that are no piece become their bytes.
    Null and empty texts have no ids. Equal texts get equal ids, repeated rows stay, null ids keep their row, an empty table gives an empty result, and
    other columns are not read.

    Documents are dealt by a hash to blocks of about ``block_rows``, as compressed parts, and shuffled once. Every distinct unit of all
    texts is encoded once; a block sends each of its distinct units once, gets it back with its ids, and is put together in one task.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    cut = vocabulary.units
    kind = dict(docs.dtypes)[id_col]
    escaped = vocabulary.escaped
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbered = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed(pa.Table.from_batches([batch]))

    def distinct_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(cut).findall

        def told(number: int, found: set[str]) -> Iterator[pa.RecordBatch]:
            listed = sorted(found)  # neighbours begin alike, which compresses
            for at in range(0, len(listed), 50_000):
                some = listed[at:at + 50_000]
                yield pa.record_batch({"block": pa.array([number] * len(some), pa.int32()), "unit": pa.array(some, pa.string())})

        current, found = None, set()
        for batch in batches:  # in order of blocks, so that one block's units are held at a time
            for number, part in zip(batch.column("block").to_pylist(), batch.column("part"), strict=True):
                if number != current:
                    yield from told(current, found)
                    current, found = number, set()
                for text in _unpacked(part.as_py()).column("text"):
                    found.update(split(escaped(text.as_py())))
        yield from told(current, found)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, bytes] = {}
        for part in right.column("part"):
            rows = _unpacked(part.as_py()).combine_chunks()
            ids = rows.column("ids").combine_chunks()
            raw, offsets = ids.flatten().to_numpy().tobytes(), (4 * ids.offsets.to_numpy()).tolist()
            units = rows.column("unit").to_pylist()
            found.update((u, raw[a:b]) for u, a, b in zip(units, offsets[:-1], offsets[1:], strict=True))
        split = re.compile(cut).findall
        names, lists = [], []
        for part in left.column("part"):
            rows = _unpacked(part.as_py())
            names.append(rows.column("id").combine_chunks())
            encoded = [b"".join(map(found.__getitem__, split(escaped(t.as_py())))) for t in rows.column("text")]
            offsets = np.cumsum([0] + [len(e) // 4 for e in encoded]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32))))
        return pa.table({"id": pa.chunked_array(names), "ids": pa.chunked_array(lists)})

    dealt = numbered.select("block", "id", "text").mapInArrow(parts, "block int, part binary").repartition(blocks, "block")
    pairs = dealt.sortWithinPartitions("block").mapInArrow(distinct_units, "block int, unit string")
    gathered = pairs.repartition("unit").sortWithinPartitions("unit")
    coded = gathered.mapInArrow(_encoder(vocabulary), "block int, part binary")
    whole = dealt.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, f"id {kind}, ids array<int>")
    return whole.select(F.col("id").alias(id_col), "ids", F.size("ids").alias("n_ids"))


def decoded(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids; ids of no piece, and nulls, add nothing. A null array is an empty one.

    Decoding what :func:`encode` made gives the text back, but that the mark for spaces, if a text held it, is a space.
    """
    known, leading = vocabulary.bytes_of, vocabulary.leading_space

    @arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        texts = []
        for row in column.to_pylist():
            raw = b"".join(known.get(i, b"") for i in row or ())
            texts.append((raw[1:] if leading and raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return of(F.col(ids) if isinstance(ids, str) else ids)
