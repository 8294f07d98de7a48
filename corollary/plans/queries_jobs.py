"""Queries over model jobs and the end-to-end flows, with rule-based models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corollary.functions import text
from corollary.operators import features, jobs, relational, training
from corollary.operators.fidelity import scoring_seed
from corollary.operators.sampling import SamplingConfig
from corollary.plans import flows, rules
from corollary.plans.data import (
    CONCEPTS,
    K_LARGE,
    K_SMALL,
    ACT_DOCS,
    ACT_DOCS_SQL,
    DOCS_SQL,
    MODEL_SQL,
    documents_with_vectors,
    WORDS,
    centroid_model,
    lengths,
    neighbours,
    quality,
    sql_annotations,
    sql_pairs,
    sql_position,
    sql_words,
    table,
    texts,
)
from corollary.plans.queries_evaluation import (
    HYPOTHESES_SQL,
    LENGTHS_SQL,
    OLS_SQL,
    PAIR_CELLS_SQL,
    SEPARATION_SQL,
    SHOW_HYPOTHESES_SQL,
    T_SQL,
    TWO_CONCEPTS,
    shown_hypotheses,
)
from corollary.plans.queries_features import (
    CORRELATION_SQL,
    DENSE_SQL,
    top_zero_sql,
    weakest_positives,
)
from corollary.plans.queries_text import document_pairs
from corollary.plans.registry import q6, query, r6
from corollary.session import cut_lineage

SEED = 3


@query(
    "p1_embed_texts",
    f"""WITH words AS (SELECT text, unnest({sql_words('text')}) AS w FROM (SELECT DISTINCT text FROM documents)),
    placed AS (SELECT text, (('0x' || substr(md5(w), 1, 1))::INTEGER) % {rules.EMBED_DIMS} AS place FROM words WHERE w <> ''),
    counts AS (SELECT text, place, count(*)::DOUBLE AS c FROM placed GROUP BY 1, 2),
    unit AS (SELECT text, place, (c / sqrt(sum(c * c) OVER (PARTITION BY text)))::FLOAT::DOUBLE AS v FROM counts)
    SELECT sha256(text) AS text_key, {', '.join(q6(f'coalesce(max(v) FILTER (WHERE place = {i}), 0)') + f' AS e{i}' for i in range(rules.EMBED_DIMS))}
    FROM unit GROUP BY text""",
)
def p1_embed_texts(spark, sf):
    found = jobs.embed_texts(texts(spark, sf), rules.embed_words)
    places = [r6(F.col("embedding")[i]).alias(f"e{i}") for i in range(rules.EMBED_DIMS)]
    return found.select("text_key", *places)


NAMED_SQL = """
counted AS (SELECT neuron_idx, w, sum(CASE WHEN class = 1 THEN 1 ELSE -1 END) AS lead FROM (
  SELECT neuron_idx, class, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM examples) GROUP BY 1, 2),
named AS (SELECT neuron_idx, 'contains: ' || w AS interpretation FROM (
  SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY lead DESC, w) AS r FROM counted) WHERE r = 1)"""
N_SHOWN = 12
_EXAMPLES = f"WITH {MODEL_SQL}, {ACT_DOCS}, {top_zero_sql(N_SHOWN // 2, 256, SEED)}, {NAMED_SQL}"


@query("p2_interpret_neurons", f"{_EXAMPLES} SELECT neuron_idx, unnest([0, 1]) AS candidate_idx, interpretation FROM named")
def p2_interpret_neurons(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    config = jobs.InterpretConfig(sampling=SamplingConfig(n_examples=N_SHOWN, random_seed=SEED), n_candidates=2)
    acts = features.activations(docs, model)
    return jobs.interpret_neurons(docs.select("row_id", "text"), acts, range(model.m), rules.name_by_word, config)


@query(
    "p3_annotate",
    f"SELECT DISTINCT concept, sha256(text) AS text_key, value FROM ({sql_annotations(words=WORDS[:3])}) a "
    "JOIN documents ON doc_id = row_id",
)
def p3_annotate(spark, sf):
    tasks = texts(spark, sf).select("text", F.explode(F.lit(CONCEPTS[:3])).alias("concept"))
    return jobs.annotate(tasks, rules.answer_contains)


@query("p4_annotate_all", sql_annotations())
def p4_annotate_all(spark, sf):
    return jobs.annotate_texts_with_concepts(texts(spark, sf), CONCEPTS, rules.answer_contains)


@query(
    "p5_similarity",
    f"""WITH pairs AS (SELECT DISTINCT a.p_name AS text_a, b.p_name AS text_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    w AS (SELECT *, list_distinct(string_split(text_a, ' ')) AS x, list_distinct(string_split(text_b, ' ')) AS y FROM pairs),
    s AS (SELECT text_a, text_b, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS share FROM w)
    SELECT text_a, text_b, {q6('CASE WHEN share >= 0.5 THEN 1.0 WHEN share > 0 THEN 0.5 ELSE 0.0 END')} AS similarity FROM s""",
)
def p5_similarity(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text_a"))
    following = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("text_b"))
    pairs = names.join(following, "p_partkey").select("text_a", "text_b")
    return jobs.surface_similarity(pairs, rules.grade_overlap).select(
        "text_a", "text_b", r6("similarity").alias("similarity")
    )


# --- end to end -------------------------------------------------------------------------


@query(
    "g1_explore",
    f"""{_EXAMPLES}, tops AS (SELECT neuron_idx, max(text) FILTER (WHERE r = 1) AS top_example_1,
      max(text) FILTER (WHERE r = 2) AS top_example_2 FROM (
        SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act_docs)
      JOIN doc_vectors USING (row_id) WHERE r <= 2 GROUP BY 1)
    SELECT neuron_idx, 10 AS source_m, 3 AS source_k, interpretation, top_example_1, top_example_2
    FROM named JOIN tops USING (neuron_idx)""",
)
def g1_explore(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    found = flows.interpret_sae(
        docs.select("row_id", "text"), docs.select("row_id", "embedding"), model, rules.name_by_word,
        neuron_indices=range(model.m), n_examples_for_interpretation=N_SHOWN, print_examples_n=2, seed=SEED,
    )
    return found.select(
        "neuron_idx", F.col("source_sae.m").alias("source_m"), F.col("source_sae.k").alias("source_k"),
        "interpretation", "top_example_1", "top_example_2",
    )


TWO_MODELS_SQL = MODEL_SQL.replace(
    "act AS (SELECT * FROM act_small)",
    "act AS (SELECT * FROM act_small UNION ALL SELECT row_id, neuron_idx + 10, activation FROM act_large)",
).replace(
    "neurons AS (SELECT DISTINCT neuron_idx FROM enc_small)",
    "neurons AS (SELECT DISTINCT neuron_idx FROM enc_small UNION ALL SELECT DISTINCT neuron_idx + 10 FROM enc_large)",
)
N_RANDOM = 8


@query(
    "g1_two_models",
    f"""WITH {TWO_MODELS_SQL}, {ACT_DOCS}, {top_zero_sql(N_SHOWN // 2, None, SEED)}, {NAMED_SQL},
    chosen AS (SELECT neuron_idx FROM neurons ORDER BY {sql_position(f"'neurons:{SEED}:' || neuron_idx")}, neuron_idx LIMIT {N_RANDOM})
    SELECT neuron_idx, CASE WHEN neuron_idx < 10 THEN 10 ELSE 20 END AS source_m,
      CASE WHEN neuron_idx < 10 THEN {K_SMALL} ELSE {K_LARGE} END AS source_k, interpretation
    FROM chosen LEFT JOIN named USING (neuron_idx)""",
)
def g1_two_models(spark, sf):
    """Random features of two models side by side, named from whole texts."""
    docs = documents_with_vectors(spark, sf)
    models = [centroid_model(spark, sf), centroid_model(spark, sf, "large")]
    found = flows.interpret_sae(
        docs.select("row_id", "text"), docs.select("row_id", "embedding"), models, rules.name_by_word,
        n_random_neurons=N_RANDOM, n_examples_for_interpretation=N_SHOWN, max_words_per_example=None, print_examples_n=0, seed=SEED,
    )
    return found.select(
        "neuron_idx", F.col("source_sae.m").alias("source_m"), F.col("source_sae.k").alias("source_k"), "interpretation"
    )


N_CHOSEN, N_SCORED = 5, 20
LABELLED_SQL = f"""
{MODEL_SQL.replace("targets AS (SELECT vec_id AS row_id, label::DOUBLE AS y FROM embeddings)",
                   "targets AS (SELECT doc_id AS row_id, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id))")},
doc_vectors AS (SELECT doc_id AS row_id, text, vec_id FROM {DOCS_SQL} JOIN targets ON row_id = doc_id),
{ACT_DOCS_SQL}"""


@query(
    "g2_generate",
    f"""WITH {LABELLED_SQL}, {DENSE_SQL.replace('LEFT JOIN act ON act.', 'LEFT JOIN act_docs act ON act.')},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY a DESC, row_id) AS r FROM dense),
    scores AS (SELECT neuron_idx, avg(y) FILTER (WHERE r <= 100) - avg(y) FILTER (WHERE a = 0) AS score FROM ordered GROUP BY 1),
    chosen AS (SELECT * FROM scores ORDER BY round(abs(score) / (SELECT nullif(max(abs(score)), 0) FROM scores), 9) DESC, neuron_idx LIMIT {N_CHOSEN}),
    {top_zero_sql(N_SHOWN // 2, 256, SEED)}, {NAMED_SQL}, {top_zero_sql(N_SCORED // 2, 256, scoring_seed(SEED), 'scoring')},
    sides AS (SELECT neuron_idx, interpretation,
        avg(contains(lower(text), substr(interpretation, 11))::INTEGER) FILTER (WHERE class = 1) AS recall,
        1 - avg(contains(lower(text), substr(interpretation, 11))::INTEGER) FILTER (WHERE class = 0) AS precision
      FROM scoring JOIN named USING (neuron_idx) GROUP BY 1, 2)
    SELECT neuron_idx, 10 AS source_m, {q6('score')} AS target_separation_score, interpretation,
      {q6('CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END')} AS f1_fidelity_score
    FROM chosen JOIN sides USING (neuron_idx)""",
)
def g2_generate(spark, sf):
    """Features that separate good from bad documents, named and scored."""
    docs = documents_with_vectors(spark, sf).drop("y").join(quality(spark, sf), "row_id")
    found = flows.generate_hypotheses(
        docs.select("row_id", "text"), docs.select("row_id", "y"), docs.select("row_id", "embedding"),
        centroid_model(spark, sf), rules.name_by_word, rules.answer_contains, n_selected_neurons=N_CHOSEN,
        n_examples_for_interpretation=N_SHOWN, n_scoring_examples=N_SCORED, seed=SEED,
    )
    return found.select(
        "neuron_idx", F.col("source_sae.m").alias("source_m"),
        r6("target_separation_score").alias("target_separation_score"), "interpretation",
        r6("f1_fidelity_score").alias("f1_fidelity_score"),
    )


@query(
    "g3_evaluate",
    f"WITH {LENGTHS_SQL}, {T_SQL}, {OLS_SQL}, {HYPOTHESES_SQL} "
    f"SELECT t.*, {q6('r2')} AS r2 FROM ({SHOW_HYPOTHESES_SQL}) t, (SELECT max(r2) AS r2 FROM fit) r",
)
def g3_evaluate(spark, sf):
    metrics, found = flows.evaluate_hypotheses(
        TWO_CONCEPTS, texts(spark, sf), lengths(spark, sf), rules.answer_contains, max_words_per_example=None
    )
    return shown_hypotheses(found).withColumn("r2", r6(F.lit(metrics["r2"])))


@query(
    "g4_pairs_evaluate",
    f"WITH {PAIR_CELLS_SQL} SELECT concept AS hypothesis, {q6(SEPARATION_SQL)} AS separation_score, "
    f"{q6('avg((value <> 0)::INTEGER)')} AS feature_prevalence FROM cells GROUP BY 1",
)
def g4_pairs_evaluate(spark, sf):
    _, found = flows.evaluate_pairs(
        CONCEPTS, texts(spark, sf), document_pairs(spark, sf), rules.answer_contains, max_words_per_example=None
    )
    return shown_hypotheses(found).select("hypothesis", "separation_score", "feature_prevalence")


@query(
    "g4_pairs_generate",
    f"""WITH {MODEL_SQL}, {ACT_DOCS},
    paired AS (SELECT row_id, y FROM doc_vectors),
    pairs AS ({sql_pairs('paired', 'row_id', 'y')}),
    za AS (SELECT pair_id, neuron_idx, activation AS v FROM pairs JOIN act_docs ON row_id = row_a
      UNION ALL SELECT pair_id, neuron_idx, -activation FROM pairs JOIN act_docs ON row_id = row_b),
    diff AS (SELECT pair_id, neuron_idx, sum(v) AS activation FROM za GROUP BY 1, 2),
    cells AS (SELECT neuron_idx, pair_id, y FROM neurons, pairs),
    dense AS (SELECT c.neuron_idx, c.pair_id AS row_id, y, coalesce(activation, 0.0::DOUBLE) AS a
      FROM cells c LEFT JOIN diff ON diff.pair_id = c.pair_id AND diff.neuron_idx = c.neuron_idx),
    {CORRELATION_SQL}, chosen AS (SELECT * FROM scores ORDER BY round(abs(score) / (SELECT nullif(max(abs(score)), 0) FROM scores), 9) DESC, neuron_idx LIMIT {N_CHOSEN}),
    examples AS (SELECT neuron_idx, class, text FROM (
        SELECT *, 1 AS class, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act_docs
        UNION ALL SELECT *, 0, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation, row_id) FROM act_docs)
      JOIN doc_vectors USING (row_id) WHERE r <= {N_SHOWN // 2}), {NAMED_SQL}
    SELECT neuron_idx, {q6('score')} AS target_correlation, interpretation FROM chosen JOIN named USING (neuron_idx)""",
)
def g4_pairs_generate(spark, sf):
    """Features whose difference between two texts predicts which has the larger label."""
    docs = documents_with_vectors(spark, sf)
    found = flows.generate_pair_hypotheses(
        docs.select("row_id", "text"), neighbours(docs, "row_id", F.col("y")), docs.select("row_id", "embedding"),
        centroid_model(spark, sf), rules.name_by_word,
        selection_method="correlation", n_selected_neurons=N_CHOSEN, n_scoring_examples=0,
        sampling=SamplingConfig(function=weakest_positives, n_examples=N_SHOWN, random_seed=SEED),
    )
    return found.select("neuron_idx", r6("target_correlation").alias("target_correlation"), "interpretation")


SEGMENTS = {"BUILDING": 1, "AUTOMOBILE": 0, "FURNITURE": 0, "HOUSEHOLD": 0, "MACHINERY": 0}
FIELDS = ["c_name", "c_nationkey", "c_acctbal"]


@query("g5_tabular")
def g5_tabular(spark, sf):
    """Table rows as few-shot texts: map labels, split, embed, train with early stopping,
    generate hypotheses on the training rows and test them on the held-out rows."""
    customer = table(spark, sf, "customer").withColumn("label", text.map_labels(F.col("c_mktsegment"), SEGMENTS))
    examples, rest = relational.head_tail_split(customer, 5, "c_custkey")
    prompts = relational.few_shot_prompts(examples, rest, FIELDS, "label", n_examples=5, row_id="c_custkey")
    prompts = prompts.select("row_id", F.col("prompt").alias("text"), text.text_key(F.col("prompt")).alias("text_key"))
    targets = customer.select(F.col("c_custkey").alias("row_id"), F.col("label").cast("double").alias("y"))
    store = jobs.embed_texts(prompts, rules.embed_words).select("text_key", "embedding")
    rows = cut_lineage(prompts.join(store, "text_key").join(targets, "row_id").drop("text_key"))
    train, held = relational.train_validation_split(rows, 0.1, SEED)
    model = training.train_sae(
        train, 8, 2, val_vectors=held, n_epochs=3, batch_size=4096, learning_rate=1e-2, seed=SEED
    )
    hypotheses = flows.generate_hypotheses(
        train.select("row_id", "text"), train.select("row_id", "y"), train.select("row_id", "embedding", "y"), model,
        rules.name_by_word, rules.answer_contains, selection_method="correlation", n_selected_neurons=3,
        n_scoring_examples=20, seed=SEED,
    )
    _, found = flows.evaluate_hypotheses(
        hypotheses, held.select("row_id", "text"), held.select("row_id", "y"), rules.answer_contains
    )
    return shown_hypotheses(found)
