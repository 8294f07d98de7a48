"""What the operators of this subpackage share: words, plain readers and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and a word, as Java regular expressions.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a key table that a join sends to every executor; above it the join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text, in order; an empty array for null and for blank texts."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # One kind of blank, and a one-character separator, which is split at without a regular expression.
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def apart(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others within one column, so that an operator's own column names can't meet theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return docs.select(*(F.col(f"`{c}`") for c in named), (F.struct(*others) if others else F.lit(None)).alias("__others"))


def together(result: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    """The columns of ``docs`` again, from a frame that came of :func:`apart`."""
    return result.select(*(F.col(f"`{c}`") if c in named else F.col("__others")[c].alias(c) for c in docs.columns))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``rows`` rows, else as it is.

    Meant for tables of a few numbers per row, so that the bound on rows is one on bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labels_by_id(labels: DataFrame, value: str, id_col: str = "doc_id") -> DataFrame:
    """One row per id: ``__id``, ``__label``. Repeated labels of an id count by the larger; nulls don't count."""
    return (
        labels.select(F.col(id_col).alias("__id"), F.col(value).cast("int").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull())
        .groupBy("__id").agg(F.max("__label").alias("__label"))
    )
