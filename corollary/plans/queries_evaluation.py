"""Queries over name fidelity and hypothesis evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from corollary.operators import evaluation, features, fidelity, relational, sampling
from corollary.plans.data import (
    CONCEPTS,
    ACT_DOCS,
    MODEL_SQL,
    documents_with_vectors,
    centroid_model,
    keyword_annotations,
    lengths,
    quality,
    sql_annotations,
    sql_normal,
    sql_student,
    table,
)
from corollary.plans.queries_features import top_zero_sql
from corollary.plans.queries_text import DOCUMENT_PAIRS_SQL, document_pairs
from corollary.plans.registry import q6, query, r6
from corollary.plans.rules import CONTAINS, answer_contains

SEED = 5
LENGTHS_SQL = f"""
ann AS ({sql_annotations()}),
targets AS (SELECT doc_id AS row_id, n_chars / 1000.0::DOUBLE AS y FROM documents),
cells AS (SELECT concept, value, y FROM ann JOIN targets USING (row_id))"""
PAIR_CELLS_SQL = f"""
ann AS ({sql_annotations()}), {DOCUMENT_PAIRS_SQL},
cells AS (SELECT a.concept, a.value - b.value AS value, y
  FROM pairs JOIN ann a ON a.row_id = row_a JOIN ann b ON b.row_id = row_b AND a.concept = b.concept)"""
SEPARATION_SQL = """
CASE WHEN bool_or(value = -1)
  THEN 0.5 * (avg(y) FILTER (WHERE value = 1) + avg(1 - y) FILTER (WHERE value = -1))
  ELSE avg(y) FILTER (WHERE value = 1) END - avg(y) FILTER (WHERE value = 0)"""
T_SQL = """
side AS (SELECT concept, avg(s) FILTER (WHERE on_side) AS m1, avg(s) FILTER (WHERE NOT on_side) AS m0,
    var_samp(s) FILTER (WHERE on_side) AS v1, var_samp(s) FILTER (WHERE NOT on_side) AS v0,
    count_if(on_side)::DOUBLE AS n1, count_if(NOT on_side)::DOUBLE AS n0
  FROM (SELECT concept, value <> 0 AS on_side, CASE WHEN value = -1 THEN -y ELSE y END AS s FROM cells) GROUP BY 1),
tests AS (SELECT concept, n1 + n0 - 2 AS df,
    (m1 - m0) / sqrt((v1 * (n1 - 1) + v0 * (n0 - 1)) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t FROM side)"""


def length_design(spark, sf, words=None):
    return evaluation.design_table(
        keyword_annotations(spark, sf, words), lengths(spark, sf), [CONTAINS + w for w in words] if words else CONCEPTS
    )


def pair_design(spark, sf):
    pairs = document_pairs(spark, sf)
    signed = relational.pair_annotation_difference(pairs, keyword_annotations(spark, sf))
    return evaluation.design_table(
        signed.withColumnRenamed("pair_id", "row_id"), pairs.select(F.col("pair_id").alias("row_id"), "y"), CONCEPTS
    )


# --- name fidelity ----------------------------------------------------------------------

N_SCORED, MAX_WORDS = 40, 256
FIDELITY_SQL = f"""
names AS (SELECT neuron_idx, i - 1 AS candidate_idx, concepts[i] AS interpretation
  FROM neurons, (SELECT {CONCEPTS!r} AS concepts, unnest(range(1, {len(CONCEPTS)} + 1)) AS i)),
scored AS (SELECT neuron_idx, interpretation, class, activation,
    contains(lower(text), substr(interpretation, {len(CONTAINS) + 1}))::INTEGER::DOUBLE AS value
  FROM scoring JOIN names USING (neuron_idx)),
sums AS (SELECT neuron_idx, interpretation, avg(value) FILTER (WHERE class = 1) AS recall,
    1 - avg(value) FILTER (WHERE class = 0) AS precision, count(*)::DOUBLE AS n, sum(activation) AS sa,
    sum(activation * activation) AS saa, sum(value) AS sv, sum(activation * value) AS sav, sum(value * value) AS svv,
    min(value) < max(value) AS varies FROM scored GROUP BY 1, 2),
fidelity AS (SELECT neuron_idx, interpretation,
    CASE WHEN recall IS NULL OR precision IS NULL THEN 0 ELSE recall END AS recall,
    CASE WHEN recall IS NULL OR precision IS NULL THEN 0 ELSE precision END AS precision,
    CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1,
    CASE WHEN recall IS NOT NULL AND precision IS NOT NULL AND varies
      THEN (n * sav - sa * sv) / (sqrt(n * saa - sa * sa) * sqrt(n * svv - sv * sv)) ELSE 0 END AS correlation
  FROM sums)"""
_SCORING = f"WITH {MODEL_SQL}, {ACT_DOCS}, {top_zero_sql(N_SCORED // 2, MAX_WORDS, fidelity.scoring_seed(SEED), 'scoring')}, {FIDELITY_SQL}"


def _names(neurons):
    listed = F.transform(
        F.lit(CONCEPTS), lambda c, i: F.struct(i.alias("candidate_idx"), c.alias("interpretation"))
    )
    return neurons.select("neuron_idx", F.inline(listed))


def _sampled(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    acts = features.activations(docs, model)
    names = _names(features.neuron_table(spark, [model]))
    return docs.select("row_id", "text"), acts, names


def _scored(spark, sf):
    """Sampled examples annotated by the rule itself, without the model job."""
    docs, acts, names = _sampled(spark, sf)
    examples = sampling.sample_top_zero(
        docs, acts, range(centroid_model(spark, sf).m), N_SCORED, MAX_WORDS, fidelity.scoring_seed(SEED)
    )
    word = F.substr("interpretation", F.lit(len(CONTAINS) + 1))
    value = F.contains(F.lower("text"), word).cast("int")
    return relational.example_tasks(examples, names).withColumn("value", value)


@query("f1_recall_precision", f"{_SCORING} SELECT neuron_idx, interpretation, {q6('recall')} AS recall, {q6('precision')} AS precision, {q6('f1')} AS f1 FROM fidelity")
def f1_recall_precision(spark, sf):
    metrics = fidelity.fidelity_metrics(_scored(spark, sf))
    return metrics.select("neuron_idx", "interpretation", *[r6(m).alias(m) for m in ("recall", "precision", "f1")])


@query("f2_correlation", f"{_SCORING} SELECT neuron_idx, interpretation, {q6('correlation')} AS correlation FROM fidelity")
def f2_correlation(spark, sf):
    metrics = fidelity.fidelity_metrics(_scored(spark, sf))
    return metrics.select("neuron_idx", "interpretation", r6("correlation").alias("correlation"))


@query(
    "f3_score_names",
    f"{_SCORING} SELECT neuron_idx, interpretation, {', '.join(f'{q6(m)} AS {m}' for m in fidelity.METRICS)} FROM fidelity",
)
def f3_score_names(spark, sf):
    docs, acts, names = _sampled(spark, sf)
    config = fidelity.ScoringConfig(n_examples=N_SCORED, max_words_per_example=MAX_WORDS, random_seed=SEED)
    metrics = fidelity.score_interpretations(docs, acts, names, answer_contains, config=config)
    return metrics.select("neuron_idx", "interpretation", *[r6(m).alias(m) for m in fidelity.METRICS])


def _best_name_sql(direction: str) -> str:
    return (
        f"{_SCORING} SELECT neuron_idx, candidate_idx::INTEGER AS candidate_idx, interpretation, {q6('f1')} AS f1 FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY round(f1, 9) {direction}, candidate_idx) AS r "
        "FROM names JOIN fidelity USING (neuron_idx, interpretation)) WHERE r = 1"
    )


def _extreme_names(spark, sf, *, worst):
    names = _sampled(spark, sf)[2]
    best = fidelity.best_names(names, fidelity.fidelity_metrics(_scored(spark, sf)), "f1", worst=worst)
    return best.select("neuron_idx", "candidate_idx", "interpretation", r6("f1").alias("f1"))


query("f4_best_names", _best_name_sql("DESC"))(partial(_extreme_names, worst=False))
query("f4_worst_names", _best_name_sql("ASC"))(partial(_extreme_names, worst=True))


# --- hypothesis evaluation --------------------------------------------------------------


@query(
    "e1_separation",
    f"WITH {LENGTHS_SQL} SELECT concept AS hypothesis, {q6(SEPARATION_SQL)} AS separation_score FROM cells GROUP BY 1",
)
def e1_separation(spark, sf):
    stats = evaluation.separation(length_design(spark, sf), CONCEPTS)
    return stats.select("hypothesis", r6("separation_score").alias("separation_score"))


@query(
    "e2_separation_pairs",
    f"WITH {PAIR_CELLS_SQL} SELECT concept AS hypothesis, {q6(SEPARATION_SQL)} AS separation_score FROM cells GROUP BY 1",
)
def e2_separation_pairs(spark, sf):
    stats = evaluation.separation(pair_design(spark, sf), CONCEPTS)
    return stats.select("hypothesis", r6("separation_score").alias("separation_score"))


_T_ROWS = f"SELECT concept AS hypothesis, {q6('t')} AS t, df, {q6(sql_student('t', 'df'))} AS separation_pval FROM tests"


def _t_rows(stats):
    tested = evaluation.with_t_pvalue(stats)
    return tested.select("hypothesis", r6("t").alias("t"), "df", r6("separation_pval").alias("separation_pval"))


@query("e3_t_test", f"WITH {LENGTHS_SQL}, {T_SQL} {_T_ROWS}")
def e3_t_test(spark, sf):
    return _t_rows(evaluation.separation(length_design(spark, sf), CONCEPTS))


@query("e3_t_test_pairs", f"WITH {PAIR_CELLS_SQL}, {T_SQL} {_T_ROWS}")
def e3_t_test_pairs(spark, sf):
    return _t_rows(evaluation.separation(pair_design(spark, sf), CONCEPTS))


TWO = ["ing", "der"]
TWO_CONCEPTS = [CONTAINS + w for w in TWO]
OLS_SQL = f"""
wide AS (SELECT y, max(value) FILTER (WHERE concept = '{TWO_CONCEPTS[0]}')::DOUBLE AS a,
    max(value) FILTER (WHERE concept = '{TWO_CONCEPTS[1]}')::DOUBLE AS b
  FROM ann JOIN targets USING (row_id) GROUP BY row_id, y),
s AS (SELECT count(*)::DOUBLE AS n, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab,
    covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, var_pop(y) * count(*) AS yy FROM wide),
coefs AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b0,
    (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b1 FROM s),
rest AS (SELECT *, yy - b0 * ay - b1 * by_ AS rss, n - 3 AS df FROM coefs),
fit AS (
  SELECT '{TWO_CONCEPTS[0]}' AS hypothesis, b0 AS coef, b0 / sqrt(rss / df * bb / det) AS tr, df AS dfr, 1 - rss / yy AS r2 FROM rest
  UNION ALL
  SELECT '{TWO_CONCEPTS[1]}', b1, b1 / sqrt(rss / df * aa / det), df, 1 - rss / yy FROM rest),
fitted AS (SELECT hypothesis, coef, {sql_student('tr', 'dfr')} AS p, r2 FROM fit)"""


@query(
    "e4_regression",
    f"WITH {LENGTHS_SQL}, {OLS_SQL} SELECT hypothesis, {q6('coef')} AS regression_coef, {q6('p')} AS regression_pval FROM fitted",
)
def e4_regression(spark, sf):
    fitted, _, _ = evaluation.regression(length_design(spark, sf, TWO), TWO_CONCEPTS)
    return fitted.select(
        "hypothesis", r6("regression_coef").alias("regression_coef"), r6("regression_pval").alias("regression_pval")
    )


def quality_design(spark, sf, words):
    return evaluation.design_table(
        keyword_annotations(spark, sf, words), quality(spark, sf), [CONTAINS + w for w in words]
    )


@query(
    "e5_logistic",
    f"""WITH cells AS (SELECT contains(lower(text), 'eau')::INTEGER AS v, quality AS y FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT count_if(v = 1 AND y = 1)::DOUBLE AS a, count_if(v = 1 AND y = 0)::DOUBLE AS b,
      count_if(v = 0 AND y = 1)::DOUBLE AS c, count_if(v = 0 AND y = 0)::DOUBLE AS d FROM cells),
    f AS (SELECT ln(a * d / (b * c)) AS coef, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se,
      a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS ll,
      (a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d)) AS l0 FROM k)
    SELECT '{CONTAINS}eau' AS hypothesis, {q6('coef')} AS regression_coef, {q6(sql_normal('coef / se'))} AS regression_pval,
      {q6('1 - ll / l0')} AS r2 FROM f""",
)
def e5_logistic(spark, sf):
    concepts = [CONTAINS + "eau"]
    fitted, metrics, _ = evaluation.regression(quality_design(spark, sf, ["eau"]), concepts, classification=True)
    return fitted.select(
        "hypothesis",
        r6("regression_coef").alias("regression_coef"),
        r6("regression_pval").alias("regression_pval"),
        r6(F.lit(metrics.get("r2"))).alias("r2"),
    )


JOINT = ["the", "eau"]
_JOINT_SQL = f"""
cells AS (SELECT a, b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM (
  SELECT contains(lower(text), '{JOINT[0]}')::INTEGER AS a, contains(lower(text), '{JOINT[1]}')::INTEGER AS b, quality AS y
  FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2
  UNION ALL
  SELECT step + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det,
    b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, c11 / det, c22 / det
  FROM (
    SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
      h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22,
      h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det
    FROM (
      SELECT step, b0, b1, b2, sum(w) AS h00, sum(w * a) AS h01, sum(w * b) AS h02, sum(w * a) AS h11, sum(w * a * b) AS h12,
        sum(w * b) AS h22, sum(k - n * p) AS g0, sum((k - n * p) * a) AS g1, sum((k - n * p) * b) AS g2
      FROM (SELECT *, n * p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM newton, cells))
      WHERE step < 15 GROUP BY ALL))),
joint AS (
  SELECT '{CONTAINS}{JOINT[0]}' AS hypothesis, b1 AS coef, b1 / sqrt(v1) AS z FROM newton WHERE step = 15
  UNION ALL SELECT '{CONTAINS}{JOINT[1]}', b2, b2 / sqrt(v2) FROM newton WHERE step = 15)"""


@query(
    "e5_logistic_joint",
    f"WITH RECURSIVE {_JOINT_SQL} SELECT hypothesis, {q6('coef')} AS regression_coef, {q6(sql_normal('z'))} AS regression_pval FROM joint",
)
def e5_logistic_joint(spark, sf):
    fitted, _, _ = evaluation.regression(
        quality_design(spark, sf, JOINT), [CONTAINS + w for w in JOINT], classification=True
    )
    return fitted.select(
        "hypothesis", r6("regression_coef").alias("regression_coef"), r6("regression_pval").alias("regression_pval")
    )


def length_scores(spark, sf):
    """``y, score``: quality against the text length in steps of 500 characters."""
    steps = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.floor(F.col("n_chars") / 500).cast("double").alias("score")
    )
    return steps.join(quality(spark, sf), "row_id").select("y", "score")


PREDICTIONS_SQL = "p AS (SELECT quality AS y, floor(n_chars / 500) AS score FROM documents JOIN labels USING (doc_id))"


@query(
    "e6_auroc",
    f"WITH {PREDICTIONS_SQL} SELECT {q6('avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)')} "
    "AS auroc FROM p a JOIN p b ON a.y = 1 AND b.y = 0",
)
def e6_auroc(spark, sf):
    return evaluation.ranking_metrics(length_scores(spark, sf)).select(r6("auroc").alias("auroc"))


@query(
    "e6_auroc_small_scores",
    f"WITH {PREDICTIONS_SQL.replace('floor(n_chars / 500)', 'floor(n_chars / 500) * 1e-15')} "
    f"SELECT {q6('avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)')} "
    "AS auroc FROM p a JOIN p b ON a.y = 1 AND b.y = 0",
)
def e6_auroc_small_scores(spark, sf):
    """Scores that differ by 1e-15 are still told apart."""
    small = length_scores(spark, sf).withColumn("score", F.col("score") * 1e-15)
    return evaluation.ranking_metrics(small).select(r6("auroc").alias("auroc"))


@query(
    "e7_average_precision",
    f"""WITH {PREDICTIONS_SQL}, g AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM p GROUP BY 1),
    c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM g)
    SELECT {q6('sum(pos * tp / k) / sum(pos)')} AS auprc FROM c""",
)
def e7_average_precision(spark, sf):
    return evaluation.ranking_metrics(length_scores(spark, sf)).select(r6("auprc").alias("auprc"))


@query("e8_r_squared", f"WITH {LENGTHS_SQL}, {OLS_SQL} SELECT {q6('max(r2)')} AS r2 FROM fit")
def e8_r_squared(spark, sf):
    _, _, predictions = evaluation.regression(length_design(spark, sf, TWO), TWO_CONCEPTS)
    return evaluation.squared_correlation(predictions).select(r6("r2").alias("r2"))


@query(
    "e9_significant",
    f"""WITH {LENGTHS_SQL}, {T_SQL}, pv AS (SELECT {sql_student('t', 'df')} AS p FROM tests)
    SELECT count_if(p < 0.1 / (SELECT count(*) FROM pv)) AS n, count(*) AS total, {q6('0.1 / count(*)')} AS threshold FROM pv""",
)
def e9_significant(spark, sf):
    stats = evaluation.with_t_pvalue(evaluation.separation(length_design(spark, sf), CONCEPTS))
    counted = evaluation.significant(stats, 0.1, "separation_pval")
    return counted.select("n", "total", r6("threshold").alias("threshold"))


@query(
    "e10_prevalence",
    f"WITH {PAIR_CELLS_SQL} SELECT concept AS hypothesis, {q6('avg((value <> 0)::INTEGER)')} AS feature_prevalence FROM cells GROUP BY 1",
)
def e10_prevalence(spark, sf):
    stats = evaluation.separation(pair_design(spark, sf), CONCEPTS)
    return stats.select("hypothesis", r6("feature_prevalence").alias("feature_prevalence"))


HYPOTHESES_SQL = f"""
table_ AS (SELECT concept AS hypothesis, {SEPARATION_SQL} AS separation_score, avg((value <> 0)::INTEGER) AS feature_prevalence
  FROM cells GROUP BY 1),
tested AS (SELECT concept AS hypothesis, {sql_student('t', 'df')} AS separation_pval FROM tests)"""
SHOW_HYPOTHESES_SQL = f"""
SELECT hypothesis, {q6('separation_score')} AS separation_score, {q6('separation_pval')} AS separation_pval,
  {q6('coef')} AS regression_coef, {q6('p')} AS regression_pval, {q6('feature_prevalence')} AS feature_prevalence
FROM table_ JOIN tested USING (hypothesis) JOIN fitted USING (hypothesis)"""


def shown_hypotheses(found):
    names = ("separation_score", "separation_pval", "regression_coef", "regression_pval", "feature_prevalence")
    return found.select("hypothesis", *[r6(c).alias(c) for c in names])


@query("e11_hypothesis_table", f"WITH {LENGTHS_SQL}, {T_SQL}, {OLS_SQL}, {HYPOTHESES_SQL} {SHOW_HYPOTHESES_SQL}")
def e11_hypothesis_table(spark, sf):
    return shown_hypotheses(evaluation.score_hypotheses(length_design(spark, sf, TWO), TWO_CONCEPTS)[1])


REFERENCE, PREDICTED = ["the", "eau", "der"], ["ing", "que", "sch"]


def concept_sets(spark, sf):
    """Two sets of word concepts per document: ``r0.., p0..`` and the language as run."""
    lowered = F.lower("text")
    return table(spark, sf, "documents").select(
        F.col("lang").alias("run_id"),
        *[F.contains(lowered, F.lit(w)).cast("int").alias(f"r{i}") for i, w in enumerate(REFERENCE)],
        *[F.contains(lowered, F.lit(w)).cast("int").alias(f"p{i}") for i, w in enumerate(PREDICTED)],
    )


def _concept_correlation_sql(keys: str) -> str:
    return f"""
docs AS (SELECT doc_id, lang AS run_id, lower(text) AS t FROM documents),
pairs AS (SELECT {keys} reference, predicted, count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab FROM (
  SELECT run_id, r AS reference, p AS predicted, contains(t, r)::INTEGER AS a, contains(t, p)::INTEGER AS b
  FROM docs, (SELECT unnest({REFERENCE!r}) AS r), (SELECT unnest({PREDICTED!r}) AS p)) GROUP BY ALL),
corr AS (SELECT {keys} reference, predicted,
  (n * sab - sa * sb) / nullif(sqrt(n * sa - sa * sa) * sqrt(n * sb - sb * sb), 0) AS correlation FROM pairs)"""


@query(
    "e12_concept_correlations",
    f"WITH {_concept_correlation_sql('')} SELECT reference, predicted, {q6('correlation')} AS correlation FROM corr",
)
def e12_concept_correlations(spark, sf):
    matrix = evaluation.concept_correlations(concept_sets(spark, sf), REFERENCE, PREDICTED)
    return matrix.select("reference", "predicted", r6("correlation").alias("correlation"))


@query(
    "e13_concept_matching",
    f"""WITH {_concept_correlation_sql('run_id,')}, s AS (SELECT run_id, reference, predicted, coalesce(correlation, 0) AS v FROM corr),
    totals AS (SELECT a.run_id, a.v + b.v + c.v AS total FROM s a JOIN s b ON a.run_id = b.run_id JOIN s c ON a.run_id = c.run_id
      WHERE a.reference = 'the' AND b.reference = 'eau' AND c.reference = 'der'
        AND a.predicted <> b.predicted AND a.predicted <> c.predicted AND b.predicted <> c.predicted)
    SELECT run_id, {q6('max(total)')} AS total, 3::BIGINT AS n_matched FROM totals GROUP BY 1""",
)
def e13_concept_matching(spark, sf):
    """Total similarity of the best matching of two concept sets, per language."""
    scores = evaluation.concept_correlations(concept_sets(spark, sf), REFERENCE, PREDICTED, run="run_id")
    matched = evaluation.match_concepts(
        scores.select("run_id", "reference", "predicted", F.coalesce("correlation", F.lit(0.0)).alias("similarity"))
    )
    return matched.groupBy("run_id").agg(r6(F.sum("similarity")).alias("total"), F.count("*").alias("n_matched"))
