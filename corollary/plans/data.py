"""The given tables in the roles the operators need, in Spark and in SQL."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.functions.text import BLANK, TRUNCATION_MESSAGE
from corollary.operators import features
from corollary.operators.features import FeatureModel
from corollary.plans.rules import CONTAINS
from corollary.session import ensure_checkpoint_dir
from corollary.sources.tables import read_table

#: Words whose presence serves as a concept.
WORDS = ["the", "ing", "eau", "que", "der", "license"]
CONCEPTS = [CONTAINS + w for w in WORDS]
#: Number of active features of the two centroid models.
K_SMALL, K_LARGE = 3, 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def texts(spark, sf) -> DataFrame:
    """``row_id, text`` of all documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")


def vectors(spark, sf) -> DataFrame:
    """``row_id, embedding, y`` of all vectors; the target is the label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.col("label").cast("double").alias("y")
    )


def documents_with_vectors(spark, sf) -> DataFrame:
    """``row_id, text, embedding, y`` of all documents; where there are fewer vectors, documents take them in turn."""
    given = vectors(spark, sf).withColumnRenamed("row_id", "vec_id")
    turn = F.pmod("row_id", F.lit(given.count())).alias("vec_id")
    return texts(spark, sf).select("*", turn).join(given, "vec_id").drop("vec_id")


def quality(spark, sf) -> DataFrame:
    """``row_id, y``: the binary target of the labelled documents."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("y")
    )


def lengths(spark, sf) -> DataFrame:
    """``row_id, y``: a numeric target of all documents, in thousands of characters."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("n_chars") / 1000).alias("y")
    )


def neighbours(rows: DataFrame, key: str, target) -> DataFrame:
    """``pair_id, row_a, row_b, y``: rows paired in id order; y = 1 if A's target is larger."""
    pairs = rows.select(F.col(key).alias("id"), target.alias("v")).groupBy(F.shiftright("id", 1).alias("pair_id")).agg(
        F.min("id").alias("row_a"),
        F.max("id").alias("row_b"),
        (F.min_by("v", "id") > F.max_by("v", "id")).cast("double").alias("y"),
    )
    return pairs.filter("row_a < row_b")


def keyword_annotations(spark, sf, words=None) -> DataFrame:
    """``row_id, concept, value`` for every document and word."""
    lowered = F.lower("text")
    cells = F.array(
        *[
            F.struct(F.lit(CONTAINS + w).alias("concept"), F.contains(lowered, F.lit(w)).cast("int").alias("value"))
            for w in words or WORDS
        ]
    )
    return texts(spark, sf).select("row_id", F.inline(cells))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, where all executors can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=64)
def _centroid_model(app: str, sf: str, size: str) -> FeatureModel:
    spark = SparkSession.active()
    given = table(spark, sf, "embeddings")
    group = F.col("label") if size == "small" else F.col("label") * 2 + (F.col("embedding")[0] >= 0).cast("int")
    rows = (
        given.select(group.alias("g"), F.posexplode("embedding").alias("d", "x"))
        .groupBy("g", "d")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("w"))
        .groupBy("g")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda s: s["w"]).alias("w"))
        .orderBy("g")
        .collect()
    )
    if [r["g"] for r in rows] != list(range(len(rows))):
        raise ValueError("every label group must occur")
    enc = np.array([r["w"] for r in rows])
    medians = features.lower_medians(given).select("dim", F.round("median", 6).alias("m")).orderBy("dim").collect()
    bias = [float(b) for b in np.round(-0.05 * (enc**2).sum(axis=1), 6)]
    return FeatureModel(
        enc=enc,
        dec=enc / np.linalg.norm(enc, axis=1, keepdims=True),
        neuron_bias=np.array(bias),
        input_bias=np.array([r["m"] for r in medians]),
        k=K_SMALL if size == "small" else K_LARGE,
        prefixes=[4, len(rows)] if size == "small" else None,
    )


def centroid_model(spark: SparkSession, sf: str, size: str = "small") -> FeatureModel:
    """A model made from all vectors: one feature per label (small) or per label and sign
    of the first dimension (large). Its encoder rows are group means."""
    return _centroid_model(spark.sparkContext.applicationId, sf, size)


def small_neurons(spark, sf) -> DataFrame:
    return features.neuron_table(spark, [centroid_model(spark, sf)])


def small_activations(spark, sf, carry=()) -> DataFrame:
    return features.activations(vectors(spark, sf), centroid_model(spark, sf), carry=carry)


# --- the same in SQL --------------------------------------------------------------------


def _model_ctes(name: str, group: str, k: int) -> str:
    return f"""
enc_{name} AS (SELECT ({group})::INTEGER AS neuron_idx, d, round(avg(x), 6) AS w FROM dims GROUP BY 1, 2),
bias_{name} AS (SELECT neuron_idx, round(-0.05 * sum(w * w), 6) AS b FROM enc_{name} GROUP BY 1),
pre_{name} AS (
  SELECT row_id, e.neuron_idx, sum((x - c) * w) + any_value(b) AS pre
  FROM dims JOIN med USING (d) JOIN enc_{name} e USING (d) JOIN bias_{name} b ON b.neuron_idx = e.neuron_idx
  GROUP BY 1, 2),
act_{name} AS (
  SELECT row_id, neuron_idx, pre AS activation FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, neuron_idx) AS r FROM pre_{name})
  WHERE r <= {k} AND pre > 0)"""


MODEL_SQL = (
    """
dims AS (
  SELECT vec_id AS row_id, label, (embedding[1] >= 0)::INTEGER AS side, d, embedding[d]::DOUBLE AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)),
med AS (SELECT d, round(quantile_disc(x, 0.5), 6) AS c FROM dims GROUP BY d),"""
    + _model_ctes("small", "label", K_SMALL)
    + ","
    + _model_ctes("large", "label * 2 + side", K_LARGE)
    + """,
act AS (SELECT * FROM act_small),
targets AS (SELECT vec_id AS row_id, label::DOUBLE AS y FROM embeddings),
neurons AS (SELECT DISTINCT neuron_idx FROM enc_small)"""
)


#: The same as :func:`documents_with_vectors`, and the activations of all documents.
DOCS_SQL = """documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)"""
ACT_DOCS_SQL = "act_docs AS (SELECT v.row_id, neuron_idx, activation FROM doc_vectors v JOIN act ON act.row_id = vec_id)"
ACT_DOCS = f"doc_vectors AS (SELECT doc_id AS row_id, text, vec_id, label::DOUBLE AS y FROM {DOCS_SQL}), {ACT_DOCS_SQL}"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def sql_words(x: str) -> str:
    return f"string_split_regex({sql_strip(x)}, '{BLANK}+')"


def sql_truncate(x: str, words: int | None = None, chars: int | None = None) -> str:
    cut = x
    if words is not None:
        pieces = sql_words(x)
        cut = f"(CASE WHEN len({pieces}) > {words} THEN array_to_string(({pieces})[1:{words}], ' ') ELSE {x} END)"
    if chars is not None:
        cut = f"(CASE WHEN length({cut}) > {chars} THEN substring({cut}, 1, {chars}) ELSE {cut} END)"
    message = TRUNCATION_MESSAGE
    return (
        f"(CASE WHEN ends_with({x}, '{message}') THEN {x} "
        f"WHEN {cut} <> {x} THEN {cut} || '{message}' ELSE {x} END)"
    )


def sql_pairs(source: str, key: str, target: str) -> str:
    return (
        f"SELECT {key} // 2 AS pair_id, min({key}) AS row_a, max({key}) AS row_b, "
        f"(arg_min({target}, {key}) > arg_max({target}, {key}))::DOUBLE AS y FROM {source} GROUP BY 1 HAVING count(*) = 2"
    )


def sql_position(text: str) -> str:
    """Hash position of a text such as ``'7:' || row_id``."""
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def sql_draw_order(seed: int, neuron: str, row: str) -> str:
    r = 1 << 52
    u = sql_position(f"'draw:{seed}:' || {row}")
    s = sql_position(f"'draw:{seed}:neuron:' || {neuron}")
    return f"((({u}) - ({s})) % {r} + {r}) % {r}"


def sql_annotations(source: str = "SELECT doc_id AS row_id, text FROM documents", words=None) -> str:
    listed = ", ".join(f"'{w}'" for w in words or WORDS)
    return (
        f"SELECT row_id, '{CONTAINS}' || w AS concept, contains(lower(text), w)::INTEGER AS value "
        f"FROM ({source}) t, (SELECT unnest([{listed}]) AS w) u"
    )


def sql_two_sided(density: str, at: str, steps: int = 20_000) -> str:
    """1 minus twice the integral of a density of ``u`` from 0 to ``at``, by Simpson's rule."""
    point = density.replace("{u}", f"(i * ({at}) / {steps})")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(1 - 2 * ({at}) / {steps} / 3 * list_sum(list_transform(range(0, {steps} + 1), lambda i: {weight} * ({point}))))"


def sql_student(t: str, df: str) -> str:
    density = (
        f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) "
        f"* pow(1 + pow({{u}}, 2) / ({df}), -((({df}) + 1) / 2))"
    )
    return sql_two_sided(density, f"abs({t})")


def sql_normal(z: str) -> str:
    return sql_two_sided("exp(-pow({u}, 2) / 2) / sqrt(2 * pi())", f"abs({z})")
