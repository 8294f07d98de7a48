"""Joins, set operations, splits and samples over texts, vectors and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.functions import templates, text
from corollary.operators import ranking
from corollary.session import collect_dimension

#: Copies of a concept table that is too large to broadcast.
SALTS = 64
#: Concepts held as a literal array; larger sets are joined block by block.
INLINE_ITEMS = 1_000
INLINE_CHARS = 1_000_000
#: Characters of all concepts together that may be broadcast.
BROADCAST_CHARS = 64_000_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a table that has few rows per key.

    Rows of a hot key are split by adaptive execution, which sees the sizes of the shuffled
    partitions; counting all keys beforehand would cost a shuffle of its own.
    """
    return left.join(right, key, how)


def uncached_texts(texts: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct valid texts that the store does not hold yet: ``text_key, text``."""
    keyed = text.drop_invalid(texts).select(text.text_key(F.col("text")).alias("text_key"), "text")
    return (
        keyed.groupBy("text_key")
        .agg(F.first("text").alias("text"))
        .join(store.select("text_key"), "text_key", "left_anti")
    )


def split_cached_tasks(tasks: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(concept, text_key)`` tasks as ``(answered, still to do)``."""
    wanted = tasks.select("concept", "text_key").distinct()
    known = store.select("concept", "text_key", "value")
    return (
        wanted.join(known, ["concept", "text_key"], "inner"),
        wanted.join(known, ["concept", "text_key"], "left_anti"),
    )


def lookup_vectors(texts: DataFrame, store: DataFrame, *, check: bool = True) -> DataFrame:
    """Attach each text's vector; a text without one is an error."""
    keyed = texts.withColumn("text_key", text.text_key(F.col("text")))
    found = lookup_join(keyed, store.select("text_key", "embedding"), "text_key")
    if check:
        missing = F.concat(F.lit("no vector for text "), F.col("text_key"))
        found = found.withColumn(
            "embedding",
            F.coalesce(
                F.col("embedding"),
                F.raise_error(missing).cast(store.schema["embedding"].dataType),
            ),
        )
    return found


def with_every_concept(texts: DataFrame, concepts: DataFrame | Sequence[str]) -> DataFrame:
    """Every text with every distinct concept.

    A small concept list travels as a literal array and is exploded row by row, so
    nothing is shuffled. A larger one is cut into blocks that meet the texts in an
    equi-join on the block: broadcast while their text is bounded, else shuffled on
    ``(block, salt)``, where the salt spreads a block's texts over many tasks.
    """
    if isinstance(concepts, DataFrame):
        distinct = concepts.select("concept").distinct()
        count, chars = distinct.agg(F.count("*"), F.sum(F.char_length("concept"))).first()
        if count > INLINE_ITEMS or (chars or 0) > INLINE_CHARS:
            return _with_concept_blocks(texts, distinct, count, chars)
        concepts = sorted(r[0] for r in collect_dimension(distinct))
    items = list(dict.fromkeys(concepts))
    if not items:
        return texts.withColumn("concept", F.lit(None).cast("string")).filter(F.lit(False))
    return texts.withColumn("concept", F.explode(F.array(*[F.lit(c) for c in items])))


def _with_concept_blocks(texts: DataFrame, concepts: DataFrame, count: int, chars: int) -> DataFrame:
    blocks = -(-count // INLINE_ITEMS)
    grouped = (
        concepts.withColumn("_block", F.pmod(F.xxhash64("concept"), F.lit(blocks)).cast("int"))
        .groupBy("_block")
        .agg(F.collect_list("concept").alias("_concepts"))
    )
    texts = texts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if chars <= BROADCAST_CHARS:
        joined = texts.join(F.broadcast(grouped), "_block")
    else:
        salt = F.pmod(F.xxhash64(*texts.columns), F.lit(SALTS)).cast("int")
        copies = grouped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = texts.withColumn("_salt", salt).join(copies, ["_block", "_salt"]).drop("_salt")
    return joined.withColumn("concept", F.explode("_concepts")).drop("_block", "_concepts")


def example_tasks(examples: DataFrame, names: DataFrame) -> DataFrame:
    """Each neuron's sampled examples with each of that neuron's distinct names."""
    return examples.join(
        names.filter(F.col("interpretation").isNotNull()).select("neuron_idx", "interpretation").distinct(),
        "neuron_idx",
    )


def annotation_vectors(rows: DataFrame, answers: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """One ``row_id`` per input row with a 0/1 column ``c0, c1, ..`` per concept.

    ``rows(row_id, text_key)``, ``answers(text_key, concept, value)``. Answers are turned
    wide per *distinct* text before they meet the rows, so repeated texts cost one wide
    record each. A missing answer is NULL.
    """
    return lookup_join(rows, wide_values(answers, "text_key", concepts), "text_key")


def wide_values(long: DataFrame, key: str, concepts: Sequence[str]) -> DataFrame:
    """Pivot ``(key, concept, value)`` to one column ``c<i>`` per listed concept."""
    columns = [
        F.max(F.when(F.col("concept") == F.lit(c), F.col("value"))).alias(f"c{i}")
        for i, c in enumerate(concepts)
    ]
    return long.filter(F.col("concept").isin(list(concepts))).groupBy(key).agg(*columns)


def pair_activation_difference(pairs: DataFrame, activations: DataFrame) -> DataFrame:
    """Sparse ``Z_A - Z_B`` per pair.

    ``pairs(pair_id, row_a, row_b)``. One join of the activations with the exploded pair
    sides and one sum: a neuron active on one side only needs no outer join.
    """
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.col("row_a").alias("row_id"), F.lit(1.0).alias("sign")),
                F.struct(F.col("row_b").alias("row_id"), F.lit(-1.0).alias("sign")),
            )
        ).alias("s"),
    ).select("pair_id", "s.row_id", "s.sign")
    return (
        lookup_join(sides, activations.select("row_id", "neuron_idx", "activation"), "row_id", "inner")
        .groupBy("pair_id", "neuron_idx")
        .agg(F.sum(F.col("sign") * F.col("activation")).alias("activation"))
        .filter(F.col("activation") != 0)
    )


def pair_annotation_difference(pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """``H_A - H_B`` in {-1, 0, 1} per pair and concept; NULL if either side is."""
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.col("row_a").alias("row_id"), F.lit(1).alias("sign")),
                F.struct(F.col("row_b").alias("row_id"), F.lit(-1).alias("sign")),
            )
        ).alias("s"),
    ).select("pair_id", "s.row_id", "s.sign")
    signed = F.sum(F.col("sign") * F.col("value"))
    return (
        lookup_join(sides, annotations.select("row_id", "concept", "value"), "row_id", "inner")
        .groupBy("pair_id", "concept")
        .agg(F.when(F.count("value") == 2, signed).cast("int").alias("value"))
    )


def distinct_texts(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Sorted distinct texts over several text columns."""
    frames = [df.select(F.col(name).alias("text")) for df, name in columns]
    return ranking.union_all(frames).distinct().orderBy("text")


def all_texts(*frames: DataFrame) -> DataFrame:
    """Training and validation texts together, repeats kept."""
    return ranking.union_all([df.select("text") for df in frames])


def train_validation_split(df: DataFrame, fraction: float, seed, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Seeded exact split: the first ``ceil(fraction * n)`` rows in hash order validate."""
    marked = df.withColumn("_pos", ranking.hash_position("split", seed, F.col(row_id)))
    total = marked.count()
    size = -(-int(round(total * fraction * 1e9)) // 10**9)
    cut = ranking.nth_position(marked, "_pos", row_id, size) if size else None
    if cut is None:
        nobody = F.lit(size > 0)
        return df.filter(~nobody), df.filter(nobody)
    held = ranking.at_or_before(F.col("_pos"), F.col(row_id), cut)
    return marked.filter(~held).drop("_pos"), marked.filter(held).drop("_pos")


def head_tail_split(df: DataFrame, n: int, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The ``n`` rows of lowest id (few-shot examples) and all others."""
    head = df.select(row_id).orderBy(row_id).limit(n).agg(F.max(row_id))
    is_head = F.col(row_id) <= head.scalar()
    return df.filter(is_head), df.filter(~is_head)


def is_binary(df: DataFrame, target: str = "y") -> DataFrame:
    """One row, ``classification``: true when every label is 0 or 1."""
    return df.agg(F.bool_and(F.coalesce(F.col(target).isin(0, 1), F.lit(False))).alias("classification"))


def few_shot_prompts(
    examples: DataFrame,
    targets: DataFrame,
    columns: list[str],
    label: str,
    *,
    n_examples: int = 3,
    row_id: str = "row_id",
    header: str = templates.FEW_SHOT_HEADER,
) -> DataFrame:
    """``row_id, prompt``: header, the first labelled rows, then the target row.

    The example block is a scalar subquery over ``n_examples`` rows, so the targets
    are neither joined nor shuffled.
    """
    line = templates.fill(
        templates.FEW_SHOT_EXAMPLE, fields=text.row_to_text(examples, columns), label=F.col(label)
    )
    shown = examples.select(F.col(row_id).alias("id"), line.alias("line")).orderBy("id").limit(n_examples)
    block = shown.agg(
        F.concat(
            F.lit(header),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]),
                "\n\n",
            ),
        )
    )
    target = templates.fill(templates.FEW_SHOT_TARGET, fields=text.row_to_text(targets, columns))
    return targets.select(F.col(row_id).alias("row_id"), F.concat(block.scalar(), target).alias("prompt"))
