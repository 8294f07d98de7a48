"""Quality rules: counts over a text's words and lines, and a hashed n-gram likelihood ratio against the raw corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corollary.llm.common import apart, labels_by_id, small_side, together

#: Buckets of hashed n-grams, a power of two; mean log-likelihood ratio per n-gram below which a document goes.
BUCKETS = 1 << 16
THRESHOLD = -0.07
#: Rules on the plain counts: fewest words, largest percentage of words in repeated windows.
MIN_WORDS = 50
MAX_REPEAT = 50

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Odd multipliers that mix the hashes of a word, and of a word and the next.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


class Words:
    """The words of one text as numbers: ``ids`` in order, equal for equal words, and ``hashes``, one per distinct word."""

    def __init__(self, text: str):
        number: dict[bytes, int] = {}
        found = text.encode().split()  # on bytes this splits at 20, 09-0D and nowhere else
        self.ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        self.hashes = np.fromiter(map(crc32, number), np.uint64, len(number))

    def buckets(self, buckets: int = BUCKETS) -> np.ndarray:
        """Buckets of all words and of all pairs of neighbours."""
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        h = self.hashes[self.ids]
        one = (h * MIX[0]) >> shift
        two = ((h[:-1] * MIX[0] + h[1:] * MIX[1] + np.uint64(1)) * MIX[2]) >> shift
        return np.concatenate([one, two]).astype(np.int64)

    def repeated(self, window: int = 3) -> int:
        """Words within a window of neighbours that occurs twice or more, its first occurrence included."""
        n = len(self.ids) - window + 1
        if n < 2:
            return 0
        key = self.ids[:n]
        for k in range(1, window):  # numbers of distinct windows so far, times the next word: exact, no hash
            _, key = np.unique(key * (len(self.hashes) + 1) + self.ids[k:n + k], return_inverse=True)
        twice = np.flatnonzero(np.bincount(key)[key] > 1)
        covered = np.zeros(len(self.ids), bool)
        for k in range(window):
            covered[twice + k] = True
        return int(covered.sum())


def plain_counts(text: str, words: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = Counter(line for line in text.split("\n") if line.strip(BLANKS))
    return (
        len(words.ids), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        sum(lines.values()) - len(lines), words.repeated(),
    )


def failed_rules(n_words: int | Column, n_repeat_words: int | Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def ngram_counts(texts: DataFrame, text: str = "text", trusted: str = "trusted", buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all texts, and over those whose column ``trusted`` is true.

    Every task adds up its texts and hands on one row per bucket; the driver gets two numbers per bucket.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            pending: list[list[np.ndarray]] = [[], []]
            for t, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                pending[bool(good)].append(Words(t.as_py() or "").buckets(buckets))
                if len(pending[bool(good)]) == 256:
                    total[int(bool(good))] += np.bincount(np.concatenate(pending[bool(good)]), minlength=buckets)
                    pending[bool(good)] = []
            for k in (0, 1):
                if pending[k]:
                    total[k] += np.bincount(np.concatenate(pending[k]), minlength=buckets)
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "raw": total.sum(axis=0)[at], "good": total[1][at]})

    sums = (
        texts.select(F.col(text), F.col(trusted)).mapInArrow(add_up, "bucket int, raw long, good long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    )
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    raw[sums["bucket"]], good[sums["bucket"]] = sums["raw"], sums["good"]
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of the trusted over the raw probability of each bucket, one added to every count; zeros without trusted text."""
    if not good.sum():
        return np.zeros(len(raw))
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def judge(text: Column | str, ratios: np.ndarray) -> Column:
    """A struct of the plain counts and ``score``, the mean log ratio over a text's n-grams (0 without a word)."""
    buckets = len(ratios)

    @arrow_udf(COUNTS)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            t = value.as_py() or ""
            found = Words(t)
            at = found.buckets(buckets)
            rows.append((*plain_counts(t, found), float(ratios[at].sum() / max(1, len(at)))))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return of(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text`` and ``trusted``: whether ``labels`` mark the document's id with quality 1."""
    good = small_side(labels_by_id(labels, "quality").where("__label = 1").select("__id"))
    own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    return own.join(good, F.col("__doc") == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("trusted"))


def with_verdict(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` with a struct column ``__quality``: the plain counts, ``score``, ``base_failed`` and ``kept``.

    The trusted-target multinomial counts the words and word pairs of all documents that ``labels`` mark with quality 1,
    the raw one those of all documents. A document's score is the log-likelihood ratio of its n-grams divided by their
    number. It is kept if the rules on its plain counts pass and its score is ``threshold`` or more.

    Null and empty texts have no words and fail the rules. Without trusted text every score is 0 and the rules alone
    decide. Equal texts get equal verdicts, repeated rows stay, an empty table gives an empty result, and other columns
    of any name are carried along. Two passes read the texts, no shuffle moves them unless the labels are
    more than a broadcast may hold.
    """
    ratios = log_ratios(*ngram_counts(_trusted(docs, labels, id_col, text_col), buckets=buckets))
    found = docs.withColumn("__found", judge(text_col, ratios))
    failed = failed_rules(F.col("__found.n_words"), F.col("__found.n_repeat_words"))
    struct = F.struct("__found.*", failed.alias("base_failed"), (~failed & (F.col("__found.score") >= threshold)).alias("kept"))
    return found.withColumn("__quality", struct).drop("__found")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`with_verdict` keeps, with their columns, whatever their names."""
    judged = with_verdict(apart(docs, id_col, text_col), labels, id_col, text_col, **options)
    return together(judged.where("__quality.kept"), docs, id_col, text_col)
