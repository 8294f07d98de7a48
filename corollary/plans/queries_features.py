"""Queries over feature inference, training, selection and example sampling."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from corollary.operators import features, ranking, relational, sampling, selection, training
from corollary.plans.data import (
    ACT_DOCS,
    MODEL_SQL,
    centroid_model,
    documents_with_vectors,
    small_activations,
    small_neurons,
    sql_draw_order,
    sql_position,
    sql_truncate,
    texts,
    vectors,
)
from corollary.plans.queries_text import PAIRS_SQL, vector_pairs
from corollary.plans.registry import q6, query, r6
from corollary.sources.models import params_table

SEED = 7


# --- inference, reconstruction, errors --------------------------------------------------


@query(
    "m1_activations",
    f"WITH {MODEL_SQL} SELECT row_id, neuron_idx, {q6('activation')} AS activation FROM act_large",
)
def m1_activations(spark, sf):
    acts = features.activations(vectors(spark, sf), centroid_model(spark, sf, "large"))
    return acts.select("row_id", "neuron_idx", r6("activation").alias("activation"))


@query(
    "m2_top_k_counts",
    f"WITH {MODEL_SQL} SELECT row_id, count(*) AS n_active, max(neuron_idx) AS last_neuron FROM act GROUP BY row_id",
)
def m2_top_k_counts(spark, sf):
    """How many of the K largest survive the ReLU; rows with none are absent."""
    acts = small_activations(spark, sf)
    return acts.groupBy("row_id").agg(F.count("*").alias("n_active"), F.max("neuron_idx").alias("last_neuron"))


@query(
    "m3_many_models",
    f"""WITH {MODEL_SQL}, a AS (SELECT * FROM act_small UNION ALL SELECT row_id, neuron_idx + 10, activation FROM act_large),
    n AS (SELECT neuron_idx, 10 AS source_m, 3 AS source_k FROM neurons
          UNION ALL SELECT DISTINCT neuron_idx + 10, 20, 4 FROM enc_large)
    SELECT neuron_idx, any_value(source_m) AS source_m, any_value(source_k) AS source_k, count(row_id) AS n_active,
      {q6('sum(activation)')} AS total FROM n LEFT JOIN a USING (neuron_idx) GROUP BY neuron_idx""",
)
def m3_many_models(spark, sf):
    both = [centroid_model(spark, sf, "small"), centroid_model(spark, sf, "large")]
    acts = features.many_activations(vectors(spark, sf), both)
    per = acts.groupBy("neuron_idx").agg(F.count("*").alias("n_active"), r6(F.sum("activation")).alias("total"))
    return features.neuron_table(spark, both).join(F.broadcast(per), "neuron_idx", "left").na.fill(0, ["n_active"])


DECODER_SQL = """
dec AS (SELECT neuron_idx, d, w / sqrt(sum(w * w) OVER (PARTITION BY neuron_idx)) AS v FROM enc_small),
sums AS (SELECT d, sum(x) AS sx, sum(x * x) AS sxx, count(*) AS n FROM dims GROUP BY d),
baseline AS (SELECT sum(sxx - sx * sx / n) AS b FROM sums),
ends AS (SELECT unnest([4, 10]) AS prefix),
coded AS (SELECT prefix, row_id, d, sum(activation * v) AS r FROM ends JOIN act ON neuron_idx < prefix
  JOIN dec USING (neuron_idx) GROUP BY 1, 2, 3),
errors AS (
  SELECT ends.prefix, sum(pow(coalesce(r, 0) + c - x, 2)) / any_value(b) AS normalized_mse
  FROM ends, dims JOIN med USING (d) LEFT JOIN coded ON coded.prefix = ends.prefix AND coded.row_id = dims.row_id
    AND coded.d = dims.d, baseline GROUP BY ends.prefix)"""


@query(
    "m4_reconstruction",
    f"""WITH {MODEL_SQL}, {DECODER_SQL} SELECT dims.row_id, {q6('sum(coalesce(r, 0) + c)')} AS total,
    {q6('sum(pow(coalesce(r, 0) + c, 2))')} AS square FROM dims JOIN med USING (d)
    LEFT JOIN coded ON coded.prefix = 10 AND coded.row_id = dims.row_id AND coded.d = dims.d GROUP BY 1""",
)
def m4_reconstruction(spark, sf):
    recon = features.reconstruct(vectors(spark, sf), centroid_model(spark, sf))
    return recon.select(
        "row_id",
        r6(F.aggregate("recon", F.lit(0.0), lambda s, x: s + x)).alias("total"),
        r6(F.aggregate("recon", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    )


@query("m5_normalized_error", f"WITH {MODEL_SQL}, {DECODER_SQL} SELECT prefix, {q6('normalized_mse')} AS normalized_mse FROM errors")
def m5_normalized_error(spark, sf):
    errors = features.reconstruction_errors(vectors(spark, sf), centroid_model(spark, sf))
    return errors.select("prefix", r6("normalized_mse").alias("normalized_mse"))


@query("m6_matryoshka_error", f"WITH {MODEL_SQL}, {DECODER_SQL} SELECT {q6('avg(normalized_mse)')} AS matryoshka_mse FROM errors")
def m6_matryoshka_error(spark, sf):
    error = features.matryoshka_error(vectors(spark, sf), centroid_model(spark, sf))
    return error.select(r6("matryoshka_mse").alias("matryoshka_mse"))


@query("m7_training_history")
def m7_training_history(spark, sf):
    """Loss per epoch of a model trained on all vectors."""
    model = training.train_sae(
        vectors(spark, sf), 32, 4, prefixes=[8, 32], n_epochs=4, learning_rate=5e-3, seed=SEED
    )
    return training.history_table(spark, model).select(
        "epoch", r6("train_loss").alias("train_loss"), r6("dead_ratio").alias("dead_ratio")
    )


GRADIENT_SQL = """
    slope AS (SELECT ends.prefix, dims.row_id, dims.d, x - c AS centered, 2.0 / 2 * (coalesce(r, 0) + c - x) AS s
      FROM ends, dims JOIN med USING (d) LEFT JOIN coded ON coded.prefix = ends.prefix AND coded.row_id = dims.row_id
        AND coded.d = dims.d),
    cells AS (SELECT a.neuron_idx, a.row_id, s.d, any_value(centered) AS centered, sum(activation * s) AS to_dec,
        sum(s * v) AS to_act FROM act a JOIN slope s ON s.row_id = a.row_id AND a.neuron_idx < s.prefix
        JOIN dec ON dec.neuron_idx = a.neuron_idx AND dec.d = s.d GROUP BY 1, 2, 3),
    back AS (SELECT *, sum(to_act) OVER (PARTITION BY neuron_idx, row_id) AS back FROM cells)"""


@query(
    "m7_gradient",
    f"""WITH {MODEL_SQL}, {DECODER_SQL}, {GRADIENT_SQL}
    SELECT neuron_idx, {q6('sum(to_act) / any_value(b)', 8)} AS bias, {q6('sum(back * centered) / any_value(b)', 8)} AS enc_total,
      {q6('sum(to_dec) / any_value(b)', 8)} AS dec_total FROM back, baseline GROUP BY 1""",
)
def m7_gradient(spark, sf):
    """Gradient of the Matryoshka loss that a training step would follow."""
    grads = training.gradient_table(vectors(spark, sf), centroid_model(spark, sf), aux_coef=0.0)
    return grads.select(
        "neuron_idx",
        r6("bias", 8).alias("bias"),
        r6(F.aggregate("enc", F.lit(0.0), lambda s, x: s + x), 8).alias("enc_total"),
        r6(F.aggregate("dec", F.lit(0.0), lambda s, x: s + x), 8).alias("dec_total"),
    )


@query(
    "m8_initial_bias",
    f"WITH {MODEL_SQL} SELECT (d - 1)::INTEGER AS dim, {q6('quantile_disc(x, 0.5)')} AS median FROM dims GROUP BY d",
)
def m8_initial_bias(spark, sf):
    return features.lower_medians(vectors(spark, sf)).select("dim", r6("median").alias("median"))


@query(
    "m9_never_active",
    f"""WITH {MODEL_SQL} SELECT neuron_idx FROM (SELECT DISTINCT neuron_idx FROM enc_large)
    WHERE neuron_idx NOT IN (SELECT neuron_idx FROM act_large WHERE activation > 0.09)""",
)
def m9_never_active(spark, sf):
    """Features that never exceed an activation of 0.09."""
    model = centroid_model(spark, sf, "large")
    strong = features.activations(vectors(spark, sf), model).filter("activation > 0.09")
    return features.never_active(features.neuron_table(spark, [model]), strong).select("neuron_idx")


CODED_SQL = """
decl AS (SELECT neuron_idx, d, w / sqrt(sum(w * w) OVER (PARTITION BY neuron_idx)) AS v FROM enc_large),
sums AS (SELECT d, sum(x) AS sx, sum(x * x) AS sxx, count(*) AS n FROM dims GROUP BY d),
baseline AS (SELECT sum(sxx - sx * sx / n) AS b FROM sums),
main_code AS (SELECT row_id, d, sum(activation * v) AS r FROM act_large JOIN decl USING (neuron_idx) GROUP BY 1, 2),
residual AS (SELECT dims.row_id, dims.d, x - c - coalesce(r, 0) AS e FROM dims JOIN med USING (d)
  LEFT JOIN main_code m ON m.row_id = dims.row_id AND m.d = dims.d),
main_loss AS (SELECT sum(e * e) / any_value(b) AS v FROM residual, baseline)"""
MULTI_K, MULTI_COEF, AUX_K, AUX_COEF = 9, 0.25, 3, 0.125


@query(
    "m10_aux_loss",
    f"""WITH {MODEL_SQL}, {CODED_SQL},
    active AS (SELECT neuron_idx, count(*) AS n FROM act_large GROUP BY 1),
    dead AS (SELECT neuron_idx FROM active WHERE n < (SELECT avg(n) FROM active)),
    aux AS (SELECT row_id, neuron_idx, pre FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, neuron_idx) AS r
      FROM pre_large JOIN dead USING (neuron_idx)) WHERE r <= {AUX_K} AND pre > 0),
    aux_code AS (SELECT row_id, d, sum(pre * v) AS r FROM aux JOIN decl USING (neuron_idx) GROUP BY 1, 2),
    spread AS (SELECT sum(q) AS b FROM (SELECT sum(e * e) - sum(e) * sum(e) / count(*) AS q FROM residual GROUP BY d)),
    aux_loss AS (SELECT sum(pow(coalesce(r, 0) - e, 2)) / any_value(b) AS v FROM spread, residual
      LEFT JOIN aux_code a ON a.row_id = residual.row_id AND a.d = residual.d)
    SELECT {q6('m.v')} AS main_loss, {q6(f'm.v + {AUX_COEF} * a.v')} AS total_loss FROM main_loss m, aux_loss a""",
)
def m10_aux_loss(spark, sf):
    """Loss with the auxiliary term, features active less often than average taken as dead."""
    model = replace(centroid_model(spark, sf, "large"), aux_k=AUX_K)
    given = vectors(spark, sf)
    counts = features.activations(given, model).groupBy("neuron_idx").count()
    rare = counts.filter(F.col("count") < counts.agg(F.avg("count")).scalar()).collect()
    idle = np.zeros(model.m, dtype=int)
    idle[[r["neuron_idx"] for r in rare]] = model.dead_threshold + 1
    model.steps_since_active = idle
    main = training.model_loss(given, model, aux_coef=0.0)
    total = training.model_loss(given, model, aux_coef=AUX_COEF)
    return spark.createDataFrame([(main, total)], "main double, total double").select(
        r6("main").alias("main_loss"), r6("total").alias("total_loss")
    )


@query(
    "m11_multi_k_loss",
    f"""WITH {MODEL_SQL}, {CODED_SQL},
    multi AS (SELECT row_id, neuron_idx, pre FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, neuron_idx) AS r FROM pre_large)
      WHERE r <= {MULTI_K} AND pre > 0),
    multi_code AS (SELECT row_id, d, sum(pre * v) AS r FROM multi JOIN decl USING (neuron_idx) GROUP BY 1, 2),
    multi_loss AS (SELECT sum(pow(x - c - coalesce(r, 0), 2)) / any_value(b) AS v FROM baseline, dims JOIN med USING (d)
      LEFT JOIN multi_code m ON m.row_id = dims.row_id AND m.d = dims.d)
    SELECT {q6('m.v')} AS main_loss, {q6(f'm.v + {MULTI_COEF} * k.v')} AS total_loss FROM main_loss m, multi_loss k""",
)
def m11_multi_k_loss(spark, sf):
    """Loss with the less sparse second reconstruction."""
    model = replace(centroid_model(spark, sf, "large"), multi_k=MULTI_K)
    given = vectors(spark, sf)
    main = training.model_loss(given, model, aux_coef=0.0)
    total = training.model_loss(given, model, aux_coef=0.0, multi_coef=MULTI_COEF)
    return spark.createDataFrame([(main, total)], "main double, total double").select(
        r6("main").alias("main_loss"), r6("total").alias("total_loss")
    )


@query("m10_aux_training")
def m10_aux_training(spark, sf):
    """Training in which features die at once, so that the auxiliary and multi-K terms act."""
    model = training.train_sae(
        vectors(spark, sf), 64, 2, aux_k=8, multi_k=8, multi_coef=0.25, dead_neuron_threshold_steps=1,
        n_epochs=3, learning_rate=5e-3, seed=SEED,
    )
    return training.history_table(spark, model).select(
        "epoch", r6("train_loss").alias("train_loss"), r6("dead_ratio").alias("dead_ratio")
    )


@query("m11_multi_k_training")
def m11_multi_k_training(spark, sf):
    """The same data with and without the less sparse second reconstruction."""
    frames = []
    for weight in (0.0, 0.5):
        model = training.train_sae(
            vectors(spark, sf), 16, 2, multi_k=6, multi_coef=weight, n_epochs=2, learning_rate=5e-3, seed=SEED
        )
        history = training.history_table(spark, model)
        frames.append(history.select(F.lit(weight).alias("multi_coef"), "epoch", r6("train_loss").alias("train_loss")))
    return ranking.union_all(frames)


STEP, EPOCHS, REST_K, REST_AUX_K = 20, 2, 1, 3
#: Rows of each epoch's steps, and sums of each step's spread. The weights rest (a step size of zero), so that every
#: step of every epoch can be told from the start model.
PLACED_SQL = f"""
 n_steps AS (SELECT ceil(count(*) / {STEP}.0)::INTEGER AS s FROM embeddings),
 seq AS (SELECT epoch, row_id, epoch * s + least(trunc(p / ({1 << 52}::DOUBLE / s))::INTEGER, s - 1) AS t FROM n_steps, (
   SELECT epoch, vec_id AS row_id, {sql_position(f"'train:{SEED}:' || epoch || ':' || vec_id")} AS p
   FROM embeddings, (SELECT unnest(range({EPOCHS})) AS epoch))),
 spread AS (SELECT epoch, t, sum(q) AS b FROM (
   SELECT epoch, t, d, sum(x * x) - sum(x) * sum(x) / count(*) AS q FROM seq JOIN dims USING (row_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
#: Features that made no row's top ``REST_K`` in a step and the one before are dead in it.
IDLE_SQL = f"""
 best AS (SELECT row_id, neuron_idx, pre FROM (
   SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, neuron_idx) AS r FROM pre_large) WHERE r <= {REST_K}),
 fired AS (SELECT DISTINCT t, neuron_idx FROM seq JOIN best USING (row_id)),
 dead AS (SELECT t, neuron_idx FROM (SELECT DISTINCT t FROM seq WHERE t > 0), (SELECT DISTINCT neuron_idx FROM enc_large)
   EXCEPT SELECT t, neuron_idx FROM fired EXCEPT SELECT t + 1, neuron_idx FROM fired),
 best_code AS (SELECT row_id, d, sum(pre * v) AS r FROM best JOIN decl USING (neuron_idx) WHERE pre > 0 GROUP BY 1, 2),
 miss AS (SELECT dims.row_id, dims.d, x - c - coalesce(r, 0) AS e FROM dims JOIN med USING (d)
   LEFT JOIN best_code m ON m.row_id = dims.row_id AND m.d = dims.d),
 step_miss AS (SELECT t, sum(s2) AS sse, sum(q) AS be FROM (
   SELECT t, d, sum(e * e) AS s2, sum(e * e) - sum(e) * sum(e) / count(*) AS q FROM seq JOIN miss USING (row_id) GROUP BY 1, 2) GROUP BY 1),
 idle AS (SELECT epoch, (SELECT count(*) FROM dead WHERE dead.t = ends.t) / (SELECT count(DISTINCT neuron_idx) FROM enc_large)::DOUBLE AS dead_ratio
   FROM (SELECT epoch, max(t) AS t FROM seq GROUP BY 1) ends)"""


def resting_history(spark, sf, model, **options):
    """History of training that leaves the weights of ``model`` as they are."""
    model = training.train_sae(
        vectors(spark, sf), model.m, model.k, prefixes=model.prefixes, n_epochs=EPOCHS, learning_rate=0.0, batch_size=STEP, seed=SEED, start=model, **options,
    )
    return training.history_table(spark, model).select("epoch", r6("train_loss").alias("train_loss"), r6("dead_ratio").alias("dead_ratio"))


@query(
    "m7_epochs",
    f"""WITH {MODEL_SQL}, {DECODER_SQL}, {PLACED_SQL},
    row_miss AS (SELECT ends.prefix, dims.row_id, sum(pow(coalesce(r, 0) + c - x, 2)) AS e FROM ends, dims JOIN med USING (d)
      LEFT JOIN coded ON coded.prefix = ends.prefix AND coded.row_id = dims.row_id AND coded.d = dims.d GROUP BY 1, 2),
    losses AS (SELECT epoch, t, sum(e) / any_value(b) / 2 AS v FROM seq JOIN row_miss USING (row_id) JOIN spread USING (epoch, t) GROUP BY 1, 2)
    SELECT epoch::INTEGER AS epoch, {q6('avg(v)')} AS train_loss, 0.0::DOUBLE AS dead_ratio FROM losses GROUP BY 1""",
)
def m7_epochs(spark, sf):
    """Mean Matryoshka loss over the steps of each epoch."""
    return resting_history(spark, sf, centroid_model(spark, sf), aux_coef=0.0)


@query(
    "m10_aux_epochs",
    f"""WITH {MODEL_SQL}, {CODED_SQL}, {PLACED_SQL}, {IDLE_SQL},
    aux AS (SELECT * FROM (SELECT t, row_id, neuron_idx, pre, row_number() OVER (PARTITION BY t, row_id ORDER BY pre DESC, neuron_idx) AS r
      FROM seq JOIN pre_large USING (row_id) JOIN dead USING (t, neuron_idx)) WHERE r <= {REST_AUX_K} AND pre > 0),
    aux_code AS (SELECT t, row_id, d, sum(pre * v) AS r FROM aux JOIN decl USING (neuron_idx) GROUP BY 1, 2, 3),
    aux_miss AS (SELECT seq.t, sum(pow(coalesce(r, 0) - e, 2)) AS s FROM seq JOIN miss USING (row_id)
      LEFT JOIN aux_code a ON a.t = seq.t AND a.row_id = seq.row_id AND a.d = miss.d GROUP BY 1)
    SELECT epoch::INTEGER AS epoch, {q6(f'avg(sse / b + {AUX_COEF} * s / be)')} AS train_loss, {q6('any_value(dead_ratio)')} AS dead_ratio
    FROM spread JOIN step_miss USING (t) JOIN aux_miss USING (t) JOIN idle USING (epoch) GROUP BY 1""",
)
def m10_aux_epochs(spark, sf):
    """Loss with the auxiliary term over steps in which features die and come back."""
    model = replace(centroid_model(spark, sf, "large"), k=REST_K, aux_k=REST_AUX_K, dead_threshold=1)
    return resting_history(spark, sf, model, aux_coef=AUX_COEF)


@query(
    "m11_multi_k_epochs",
    f"""WITH {MODEL_SQL}, {CODED_SQL}, {PLACED_SQL}, {IDLE_SQL},
    multi AS (SELECT row_id, neuron_idx, pre FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, neuron_idx) AS r FROM pre_large) WHERE r <= {MULTI_K} AND pre > 0),
    multi_code AS (SELECT row_id, d, sum(pre * v) AS r FROM multi JOIN decl USING (neuron_idx) GROUP BY 1, 2),
    multi_miss AS (SELECT t, sum(pow(x - c - coalesce(r, 0), 2)) AS s FROM seq JOIN dims USING (row_id) JOIN med USING (d)
      LEFT JOIN multi_code m ON m.row_id = dims.row_id AND m.d = dims.d GROUP BY 1)
    SELECT epoch::INTEGER AS epoch, {q6(f'avg((sse + {MULTI_COEF} * s) / b)')} AS train_loss, {q6('any_value(dead_ratio)')} AS dead_ratio
    FROM spread JOIN step_miss USING (t) JOIN multi_miss USING (t) JOIN idle USING (epoch) GROUP BY 1""",
)
def m11_multi_k_epochs(spark, sf):
    """Loss with the less sparse second reconstruction over the steps of each epoch."""
    model = replace(centroid_model(spark, sf, "large"), k=REST_K, multi_k=MULTI_K, dead_threshold=1)
    return resting_history(spark, sf, model, aux_coef=0.0, multi_coef=MULTI_COEF)


STEP_SIZE = 0.01


@query(
    "m12_unit_decoder",
    f"""WITH {MODEL_SQL}, {DECODER_SQL}, {GRADIENT_SQL},
    g_cells AS (SELECT neuron_idx, d, sum(back * centered) / any_value(b) AS ge, sum(to_dec) / any_value(b) AS gd FROM back, baseline GROUP BY 1, 2),
    g_bias AS (SELECT neuron_idx, sum(to_act) / any_value(b) AS gn FROM back, baseline GROUP BY 1),
    g_input AS (SELECT t.d, any_value(t.s) / any_value(b) - sum(gn * w) AS gi
      FROM (SELECT d, sum(s) AS s FROM slope GROUP BY 1) t JOIN enc_small USING (d) JOIN g_bias USING (neuron_idx), baseline GROUP BY 1),
    params AS (SELECT neuron_idx, d, w, v, coalesce(ge, 0) AS ge, coalesce(gd, 0) AS gd
      FROM enc_small JOIN dec USING (neuron_idx, d) LEFT JOIN g_cells USING (neuron_idx, d)),
    projected AS (SELECT *, gd - v * sum(gd * v) OVER (PARTITION BY neuron_idx) AS gp FROM params),
    clip AS (SELECT least(1, 1 / (sqrt((SELECT sum(ge * ge + gp * gp) FROM projected) + (SELECT sum(gn * gn) FROM g_bias)
      + (SELECT sum(gi * gi) FROM g_input)) + 1e-6)) AS k),
    moved AS (SELECT neuron_idx, w - {STEP_SIZE} * ge * k / (abs(ge * k) + 1e-8) AS w, v - {STEP_SIZE} * gp * k / (abs(gp * k) + 1e-8) AS v
      FROM projected, clip),
    unit AS (SELECT neuron_idx, w, v / sqrt(sum(v * v) OVER (PARTITION BY neuron_idx)) AS v FROM moved)
    SELECT neuron_idx, {q6('sum(w)')} AS enc_total, {q6('sum(v)')} AS dec_total, {q6('sqrt(sum(v * v))')} AS norm FROM unit GROUP BY 1""",
)
def m12_unit_decoder(spark, sf):
    """One whole step from a given model: gradient, projection, clipping, update, and decoder rows back to unit length."""
    start = centroid_model(spark, sf)
    model = training.train_sae(
        vectors(spark, sf), start.m, start.k, prefixes=start.prefixes, n_epochs=1, learning_rate=STEP_SIZE, aux_coef=0.0,
        batch_size=1 << 40, seed=SEED, start=start,
    )
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("dec", F.lit(0.0), lambda s, x: s + x * x)
    return params_table(spark, model, "trained").select(
        "neuron_idx", r6(total("enc")).alias("enc_total"), r6(total("dec")).alias("dec_total"), r6(F.sqrt(square)).alias("norm")
    )


PATIENCE = 2
_SPLIT_LOSS = """
 sums_{0} AS (SELECT d, sum(x) AS sx, sum(x * x) AS sxx, count(*) AS n FROM dims JOIN {0} USING (row_id) GROUP BY d),
 base_{0} AS (SELECT sum(sxx - sx * sx / n) AS b FROM sums_{0}),
 loss_{0} AS (SELECT avg(e) AS v FROM (
   SELECT ends.prefix, sum(pow(coalesce(r, 0) + c - x, 2)) / any_value(b) AS e
   FROM ends, dims JOIN {0} USING (row_id) JOIN med USING (d) LEFT JOIN coded ON coded.prefix = ends.prefix
     AND coded.row_id = dims.row_id AND coded.d = dims.d, base_{0} GROUP BY 1))"""


@query(
    "m13_early_stopping",
    f"""WITH {MODEL_SQL}, {DECODER_SQL},
    placed AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY {sql_position(f"'split:{SEED}:' || vec_id")}, vec_id) AS p,
      count(*) OVER () AS n FROM embeddings),
    held AS (SELECT row_id FROM placed WHERE p <= ceil(0.1 * n)), train AS (SELECT row_id FROM placed WHERE p > ceil(0.1 * n)),
    {_SPLIT_LOSS.format("train")}, {_SPLIT_LOSS.format("held")}
    SELECT epoch::INTEGER AS epoch, {q6('t.v')} AS train_loss, {q6('h.v')} AS val_loss
    FROM (SELECT unnest(range({PATIENCE + 1})) AS epoch), loss_train t, loss_held h""",
)
def m13_early_stopping(spark, sf):
    """Losses on a seeded tenth of the vectors and on the rest. The step size is zero, so the second epoch
    doesn't improve on the first and training must stop after ``PATIENCE`` more."""
    train, held = relational.train_validation_split(vectors(spark, sf), 0.1, SEED)
    start = centroid_model(spark, sf)
    model = training.train_sae(
        train, start.m, start.k, prefixes=start.prefixes, val_vectors=held, n_epochs=8, learning_rate=0.0, patience=PATIENCE,
        aux_coef=0.0, batch_size=1 << 40, seed=SEED, start=start,
    )
    return training.history_table(spark, model).select(
        "epoch", r6("train_loss").alias("train_loss"), r6("val_loss").alias("val_loss")
    )


@query(
    "m13_batch_validation",
    f"""WITH {MODEL_SQL}, {DECODER_SQL},
    placed AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY {sql_position(f"'split:{SEED}:' || vec_id")}, vec_id) AS p,
      count(*) OVER () AS n FROM embeddings),
    held AS (SELECT row_id, {sql_position(f"'train:{SEED}:-1:' || row_id")} AS p, ceil(count(*) OVER () / {STEP}.0) AS s
      FROM placed WHERE p <= ceil(0.5 * n)),
    batches AS (SELECT row_id, least(trunc(p / ({1 << 52}::DOUBLE / s)), s - 1) AS t FROM held),
    spread AS (SELECT t, sum(q) AS b FROM (
      SELECT t, d, sum(x * x) - sum(x) * sum(x) / count(*) AS q FROM batches JOIN dims USING (row_id) GROUP BY 1, 2) GROUP BY 1),
    losses AS (SELECT t, sum(pow(coalesce(r, 0) + c - x, 2)) / any_value(b) / 2 AS v FROM ends, dims JOIN batches USING (row_id)
      JOIN spread USING (t) JOIN med USING (d)
      LEFT JOIN coded ON coded.prefix = ends.prefix AND coded.row_id = dims.row_id AND coded.d = dims.d GROUP BY 1)
    SELECT 0 AS epoch, count(*) AS n_batches, {q6('avg(v)')} AS val_loss FROM losses""",
)
def m13_batch_validation(spark, sf):
    """Validation loss as the mean over batches of rows, as a loader that deals batches would report it."""
    train, held = relational.train_validation_split(vectors(spark, sf), 0.5, SEED)
    start = centroid_model(spark, sf)
    model = training.train_sae(
        train, start.m, start.k, prefixes=start.prefixes, val_vectors=held, n_epochs=1, learning_rate=0.0, aux_coef=0.0, batch_size=STEP,
        seed=SEED, start=start, batch_validation=True,
    )
    batches = -(-held.count() // STEP)
    return training.history_table(spark, model).select("epoch", F.lit(batches).cast("long").alias("n_batches"), r6("val_loss").alias("val_loss"))


# --- selection --------------------------------------------------------------------------

DENSE_SQL = """
cells AS (SELECT neuron_idx, row_id, y FROM neurons, targets),
dense AS (SELECT c.neuron_idx, c.row_id, y, coalesce(activation, 0.0::DOUBLE) AS a
  FROM cells c LEFT JOIN act ON act.row_id = c.row_id AND act.neuron_idx = c.neuron_idx)"""

CORRELATION_SQL = """
scores AS (SELECT neuron_idx, (n * say - sa * sy) / nullif(sqrt(greatest(n * saa - sa * sa, 0)) * sqrt(n * syy - sy * sy), 0) AS score
  FROM (SELECT neuron_idx, count(*)::DOUBLE AS n, sum(a) AS sa, sum(a * a) AS saa, sum(a * y) AS say, sum(y) AS sy,
    sum(y * y) AS syy FROM dense GROUP BY 1))"""


def _separation_sql(n_top: int) -> str:
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY a DESC, row_id) AS r FROM dense),
scores AS (SELECT neuron_idx, avg(y) FILTER (WHERE r <= {n_top}) - avg(y) FILTER (WHERE a = 0) AS score
  FROM ordered GROUP BY 1)"""


def _best_sql(n: int, by: str = "abs(score)", digits: int = 6) -> str:
    return (
        f"SELECT neuron_idx, {q6('score', digits)} AS score, rank FROM (SELECT *, (row_number() OVER "
        f"(ORDER BY round({by} / (SELECT nullif(max(abs(score)), 0) FROM scores), 9) DESC NULLS LAST, neuron_idx))::INTEGER AS rank FROM scores) WHERE rank <= {n}"
    )


def _shown(selected):
    return selected.select("neuron_idx", r6("score").alias("score"), "rank")


@query("n1_correlation", f"WITH {MODEL_SQL}, {DENSE_SQL}, {CORRELATION_SQL} {_best_sql(8)}")
def n1_correlation(spark, sf):
    acts = small_activations(spark, sf, carry=("y",))
    return _shown(
        selection.select_correlation(acts, vectors(spark, sf), 8, neurons=small_neurons(spark, sf))
    )


@query("n2_separation", f"WITH {MODEL_SQL}, {DENSE_SQL}, {_separation_sql(100)} {_best_sql(8)}")
def n2_separation(spark, sf):
    acts = small_activations(spark, sf, carry=("y",))
    return _shown(selection.select_separation(acts, vectors(spark, sf), 8, neurons=small_neurons(spark, sf)))


@query(
    "n2_separation_padded",
    f"WITH {MODEL_SQL}, {DENSE_SQL}, {_separation_sql(400)} {_best_sql(10)}",
)
def n2_separation_padded(spark, sf):
    """More top rows than a feature has positives: zero rows of lowest id fill up."""
    acts = small_activations(spark, sf, carry=("y",))
    return _shown(
        selection.select_separation(
            acts, vectors(spark, sf), 10, neurons=small_neurons(spark, sf), n_top_activating=400
        )
    )


PAIR_DENSE_SQL = """
cells AS (SELECT neuron_idx, pair_id AS row_id, y FROM neurons, pairs),
dense AS (SELECT c.neuron_idx, c.row_id, y, coalesce(activation, 0.0::DOUBLE) AS a
  FROM cells c LEFT JOIN diff ON diff.pair_id = c.row_id AND diff.neuron_idx = c.neuron_idx)"""


@query(
    "n2_separation_pairs",
    f"WITH {MODEL_SQL}, {PAIRS_SQL}, {PAIR_DENSE_SQL}, {_separation_sql(200)} {_best_sql(10)}",
)
def n2_separation_pairs(spark, sf):
    """Pair differences have negative activations, which follow the zero rows."""
    pairs = vector_pairs(spark, sf)
    diff = relational.pair_activation_difference(pairs, small_activations(spark, sf))
    acts = diff.withColumnRenamed("pair_id", "row_id")
    targets = pairs.select(F.col("pair_id").alias("row_id"), "y")
    return _shown(
        selection.select_separation(acts, targets, 10, neurons=small_neurons(spark, sf), n_top_activating=200)
    )


N_ZERO = 50


@query(
    "n2_separation_small_unit",
    f"WITH {MODEL_SQL.replace('label::DOUBLE AS y', '(label * 1e-11)::DOUBLE AS y')}, {DENSE_SQL}, "
    f"{_separation_sql(100)} {_best_sql(8, digits=16)}",
)
def n2_separation_small_unit(spark, sf):
    """The same target in a unit 1e11 times larger: the same features in the same order."""
    small = F.col("y") * 1e-11
    acts = small_activations(spark, sf, carry=("y",)).withColumn("y", small)
    chosen = selection.select_separation(
        acts, vectors(spark, sf).withColumn("y", small), 8, neurons=small_neurons(spark, sf)
    )
    return chosen.select("neuron_idx", r6("score", 16).alias("score"), "rank")


@query(
    "n2_separation_sampled",
    f"""WITH {MODEL_SQL}, {DENSE_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY a DESC, row_id) AS r,
      row_number() OVER (PARTITION BY neuron_idx, a = 0 ORDER BY {sql_draw_order(SEED, 'neuron_idx', 'row_id')}, row_id) AS z
      FROM dense),
    scores AS (SELECT neuron_idx, avg(y) FILTER (WHERE r <= 100) - avg(y) FILTER (WHERE a = 0 AND z <= {N_ZERO}) AS score
      FROM placed GROUP BY 1)
    {_best_sql(10)}""",
)
def n2_separation_sampled(spark, sf):
    """The zero mean taken over a random sample of zero rows."""
    acts = small_activations(spark, sf, carry=("y",))
    return _shown(
        selection.select_separation(
            acts, vectors(spark, sf), 10, neurons=small_neurons(spark, sf), n_zero_activating=N_ZERO, seed=SEED
        )
    )


ALPHA = 0.05


LASSO_MOMENTS_SQL = """
stat AS (SELECT neuron_idx, avg(a) AS mean, CASE WHEN var_pop(a) > 0 THEN sqrt(var_pop(a)) ELSE 1.0 END AS sd
  FROM dense GROUP BY 1),
z AS (SELECT neuron_idx, row_id, y, (a - mean) / sd AS v FROM dense JOIN stat USING (neuron_idx)),
xy AS (SELECT list(c ORDER BY neuron_idx) AS c FROM (SELECT neuron_idx, covar_pop(v, y) AS c FROM z GROUP BY 1)),
xx AS (SELECT list(g ORDER BY neuron_idx) AS g FROM (
  SELECT neuron_idx, list(s ORDER BY other) AS g FROM (
    SELECT p.neuron_idx, q.neuron_idx AS other, avg(p.v * q.v) AS s FROM z p JOIN z q USING (row_id) GROUP BY 1, 2)
  GROUP BY 1))"""


def _proximal_step(alpha: str) -> str:
    """One proximal gradient step on the moments of the standardized features."""
    pull = "b[j] + (c[j] - list_dot_product(g[j], b)) / len(b)"
    return (
        f"list_transform(range(1, len(b) + 1), lambda j: sign({pull}) * greatest(abs({pull}) - {alpha} / len(b), 0))"
    )


def _lasso_sql(alpha: float, steps: int) -> str:
    return f"""{LASSO_MOMENTS_SQL},
    fit AS (
      SELECT 0 AS step, list_transform(c, lambda x: 0.0::DOUBLE) AS b FROM xy
      UNION ALL SELECT step + 1, {_proximal_step(str(alpha))} FROM fit, xy, xx WHERE step < {steps}),
    scores AS (SELECT (unnest(range(len(b))))::INTEGER AS neuron_idx, unnest(b) AS score FROM fit WHERE step = {steps})"""


def _search_sql(n_select: int, steps: int = 600) -> str:
    """The bisection of the penalty: ``steps`` proximal steps per fit, 20 fits at most."""
    return f"""{LASSO_MOMENTS_SQL},
    fit AS (
      SELECT 0 AS step, 1e-6::DOUBLE AS low, 1e4::DOUBLE AS high, sqrt(1e-6::DOUBLE * 1e4::DOUBLE) AS alpha,
        list_transform(c, lambda x: 0.0::DOUBLE) AS b, false AS done FROM xy
      UNION ALL
      SELECT step + 1, low2, high2, CASE WHEN ends AND nz <> {n_select} THEN sqrt(low2 * high2) ELSE alpha END, b2,
        ends AND nz = {n_select}
      FROM (
        SELECT *, CASE WHEN ends AND nz > {n_select} THEN alpha ELSE low END AS low2,
          CASE WHEN ends AND nz < {n_select} THEN alpha ELSE high END AS high2
        FROM (
          SELECT *, (step + 1) % {steps} = 0 AS ends, len(list_filter(b2, lambda x: abs(x) > 1e-8)) AS nz
          FROM (SELECT fit.*, {_proximal_step('alpha')} AS b2 FROM fit, xy, xx WHERE NOT done AND step < {20 * steps})))),
    scores AS (SELECT (unnest(range(len(b))))::INTEGER AS neuron_idx, unnest(b) AS score
      FROM fit WHERE step = (SELECT max(step) FROM fit))"""


@query(
    "n3_lasso",
    f"WITH RECURSIVE {MODEL_SQL}, {DENSE_SQL}, {_lasso_sql(ALPHA, 1000)} {_best_sql(10, digits=5)}",
)
def n3_lasso(spark, sf):
    """Linear L1 fit at a given penalty; coefficients compared to 5 digits."""
    acts = small_activations(spark, sf)
    picked = selection.select_neurons(
        acts, vectors(spark, sf), 10, neurons=small_neurons(spark, sf), method="lasso", alpha=ALPHA
    )
    return picked.select("neuron_idx", r6("score", 5).alias("score"), "rank")


LOGISTIC_ALPHA = 5.0


def _logistic_lasso_sql(alpha: float, steps: int = 1500) -> str:
    """Accelerated proximal gradient steps on the rows; the last place is the intercept."""
    ahead = "(b[j] + (step - 1) / (step + 2) * (b[j] - p[j]))"
    pull = "ahead[j] + list_dot_product(x[j], miss) / bound"
    return f"""
    stat AS (SELECT neuron_idx, CASE WHEN var_pop(a) > 0 THEN sqrt(var_pop(a)) ELSE 1.0 END AS sd FROM dense GROUP BY 1),
    z AS (SELECT neuron_idx, row_id, (y >= 5)::INTEGER::DOUBLE AS t, a / sd AS v FROM dense JOIN stat USING (neuron_idx)),
    by_row AS (SELECT row_id, any_value(t) AS t, list_append(list(v ORDER BY neuron_idx), 1.0) AS r FROM z GROUP BY 1),
    given AS (SELECT list(r ORDER BY row_id) AS rs, list(t ORDER BY row_id) AS ts FROM by_row),
    by_column AS (SELECT list(c ORDER BY neuron_idx) AS cs FROM (SELECT neuron_idx, list(v ORDER BY row_id) AS c FROM z GROUP BY 1)),
    data AS (SELECT rs, ts, list_append(cs, list_transform(ts, lambda u: 1.0::DOUBLE)) AS x,
      0.25 * list_sum(list_transform(rs, lambda r: list_dot_product(r, r))) AS bound FROM given, by_column),
    fit AS (
      SELECT 1 AS step, list_transform(x, lambda c: 0.0::DOUBLE) AS b, list_transform(x, lambda c: 0.0::DOUBLE) AS p FROM data
      UNION ALL
      SELECT step + 1, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN j = len(b) THEN {pull}
          ELSE sign({pull}) * greatest(abs({pull}) - {alpha} / bound, 0) END), b
      FROM (
        SELECT *, list_transform(range(1, len(rs) + 1), lambda i: ts[i] - 1 / (1 + exp(-list_dot_product(rs[i], ahead)))) AS miss
        FROM (SELECT *, list_transform(range(1, len(b) + 1), lambda j: {ahead}) AS ahead FROM fit, data WHERE step < {steps}))),
    scores AS (SELECT neuron_idx, score FROM (
        SELECT (unnest(range(len(b))))::INTEGER AS neuron_idx, unnest(b) AS score, len(b) - 1 AS m FROM fit WHERE step = {steps})
      WHERE neuron_idx < m)"""


@query(
    "n3_logistic_lasso",
    f"WITH RECURSIVE {MODEL_SQL}, {DENSE_SQL}, {_logistic_lasso_sql(LOGISTIC_ALPHA)} {_best_sql(10, digits=4)}",
)
def n3_logistic_lasso(spark, sf):
    """Logistic L1 fit at a given penalty; coefficients compared to 4 digits."""
    acts = small_activations(spark, sf)
    targets = vectors(spark, sf).withColumn("y", (F.col("y") >= 5).cast("double"))
    picked = selection.select_neurons(
        acts, targets, 10, neurons=small_neurons(spark, sf), method="lasso", alpha=LOGISTIC_ALPHA, classification=True
    )
    return picked.select("neuron_idx", r6("score", 4).alias("score"), "rank")


N_KEPT = 4


@query(
    "n4_alpha_search",
    f"WITH RECURSIVE {MODEL_SQL}, {DENSE_SQL}, {_search_sql(N_KEPT)} {_best_sql(N_KEPT, digits=5)}",
)
def n4_alpha_search(spark, sf):
    """The penalty is searched until exactly four features have a coefficient."""
    acts = small_activations(spark, sf)
    picked = selection.select_neurons(
        acts, vectors(spark, sf), N_KEPT, neurons=small_neurons(spark, sf), method="lasso"
    )
    return picked.select("neuron_idx", r6("score", 5).alias("score"), "rank")


@query(
    "n5_standardize",
    f"""WITH {MODEL_SQL}, {DENSE_SQL} SELECT neuron_idx, {q6('avg(a)')} AS mean,
    {q6('CASE WHEN var_pop(a) > 0 THEN sqrt(var_pop(a)) ELSE 1.0 END')} AS scale FROM dense GROUP BY 1""",
)
def n5_standardize(spark, sf):
    scales = selection.feature_scales(small_activations(spark, sf), vectors(spark, sf))
    return scales.select("neuron_idx", r6("mean").alias("mean"), r6("scale").alias("scale"))


@query(
    "n6_custom_metric",
    f"""WITH {MODEL_SQL}, {DENSE_SQL},
    scores AS (SELECT neuron_idx, avg(a * y) / nullif(avg(y), 0) AS score FROM dense GROUP BY 1) {_best_sql(5, 'score')}""",
)
def n6_custom_metric(spark, sf):
    """A user's metric over the feature moments: target-weighted mean activation."""
    acts = small_activations(spark, sf, carry=("y",))
    picked = selection.select_neurons(
        acts, vectors(spark, sf), 5, neurons=small_neurons(spark, sf), method="custom",
        metric_fn=lambda col: F.try_divide(col("sum_ay"), col("sum_y")),
    )
    return _shown(picked)


#: Every cell with its mean rank by activation within its feature, and by target over all rows.
RANKED_SQL = """
ranked AS (SELECT neuron_idx, t, rank() OVER (PARTITION BY neuron_idx ORDER BY a) + (count(*) OVER (PARTITION BY neuron_idx, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY neuron_idx ORDER BY t) + (count(*) OVER (PARTITION BY neuron_idx, t) - 1) / 2.0 AS rt FROM cells_of)"""


@query(
    "n6_auroc",
    f"""WITH {MODEL_SQL}, {DENSE_SQL}, cells_of AS (SELECT neuron_idx, a, (y >= 5)::INTEGER AS t FROM dense), {RANKED_SQL},
    scores AS (SELECT neuron_idx, (sum(ra * t) - sum(t) * (sum(t) + 1) / 2.0) / nullif(sum(t) * (count(*) - sum(t)), 0)::DOUBLE AS score
      FROM ranked GROUP BY 1) {_best_sql(5, 'score')}""",
)
def n6_auroc(spark, sf):
    """A rank metric as the user's own: how well each activation alone tells the upper labels from the lower."""
    targets = vectors(spark, sf).withColumn("y", (F.col("y") >= 5).cast("double"))
    acts = small_activations(spark, sf)
    picked = selection.select_neurons(
        acts, targets, 5, neurons=small_neurons(spark, sf), method="custom", metric_fn=selection.auroc, ranks=True
    )
    return picked.select("neuron_idx", r6("score").alias("score"), "rank")


@query(
    "n6_spearman",
    f"""WITH {MODEL_SQL}, {DENSE_SQL}, cells_of AS (SELECT neuron_idx, a, y AS t FROM dense), {RANKED_SQL},
    scores AS (SELECT neuron_idx, corr(ra, rt) AS score FROM ranked GROUP BY 1) {_best_sql(5, 'score')}""",
)
def n6_spearman(spark, sf):
    """Rank correlation of each feature with the label, zeros included."""
    acts = small_activations(spark, sf, carry=("y",))
    picked = selection.select_neurons(
        acts, vectors(spark, sf), 5, neurons=small_neurons(spark, sf), method="custom", metric_fn=selection.spearman, ranks=True
    )
    return picked.select("neuron_idx", r6("score").alias("score"), "rank")


@query("n7_class_count", "SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def n7_class_count(spark, sf):
    return selection.count_classes(vectors(spark, sf))


# --- sampling ---------------------------------------------------------------------------

N_EXAMPLES, MAX_WORDS = 16, 256


def _zero_sql(half: int, seed: int = SEED, rows: str = "doc_vectors") -> str:
    order = sql_draw_order(seed, "n.neuron_idx", "t.row_id")
    return f"""
zeros AS (SELECT neuron_idx, row_id FROM (
  SELECT n.neuron_idx, t.row_id, row_number() OVER (PARTITION BY n.neuron_idx ORDER BY {order}, t.row_id) AS r
  FROM neurons n, {rows} t
  WHERE NOT EXISTS (SELECT 1 FROM act_docs a WHERE a.neuron_idx = n.neuron_idx AND a.row_id = t.row_id))
  WHERE r <= {half})"""


def top_zero_sql(half: int, max_words: int | None, seed: int = SEED, name: str = "examples") -> str:
    text = sql_truncate("text", words=max_words) if max_words else "text"
    return f"""{_zero_sql(half, seed).replace('zeros AS', f'zeros_{name} AS')},
top_{name} AS (SELECT neuron_idx, row_id, activation FROM (
  SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act_docs) WHERE r <= {half}),
{name} AS (
  SELECT neuron_idx, class, row_id, activation, {text} AS text FROM (
    SELECT neuron_idx, 1 AS class, row_id, activation FROM top_{name}
    UNION ALL SELECT neuron_idx, 0, row_id, 0.0 FROM zeros_{name}) JOIN doc_vectors USING (row_id))"""


_SHOW_EXAMPLES = f"SELECT neuron_idx, class, row_id, {q6('activation')} AS activation, md5(text) AS text_md5 FROM examples"


def _show_examples(examples):
    return examples.select(
        "neuron_idx", "class", "row_id", r6("activation").alias("activation"), F.md5("text").alias("text_md5")
    )


@query("x1_top_zero", f"WITH {MODEL_SQL}, {ACT_DOCS}, {top_zero_sql(N_EXAMPLES // 2, MAX_WORDS)} {_SHOW_EXAMPLES}")
def x1_top_zero(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    acts = features.activations(docs, model)
    return _show_examples(
        sampling.sample_top_zero(docs.select("row_id", "text"), acts, range(model.m), N_EXAMPLES, MAX_WORDS, SEED)
    )


def _band_sql(name: str, low: float, high: float, label: int, half: int) -> str:
    order = sql_draw_order(SEED, "neuron_idx", "row_id")
    return f"""
{name} AS (SELECT neuron_idx, {label} AS class, row_id, activation FROM (
  SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY {order}, row_id) AS r
  FROM act_docs JOIN (SELECT neuron_idx, quantile_cont(activation, {low}) AS lo, quantile_cont(activation, {high}) AS hi
    FROM act_docs GROUP BY 1) USING (neuron_idx) WHERE activation BETWEEN lo AND hi) WHERE r <= {half})"""


_HALF = N_EXAMPLES // 2


@query(
    "x2_percentile_zero",
    f"""WITH {MODEL_SQL}, {ACT_DOCS}, {_band_sql('high', 0.8, 1.0, 1, _HALF)}, {_zero_sql(_HALF)},
    examples AS (SELECT c.*, {sql_truncate('text', words=MAX_WORDS)} AS text FROM (
      SELECT * FROM high UNION ALL SELECT neuron_idx, 0, row_id, 0.0 FROM zeros) c JOIN doc_vectors USING (row_id))
    {_SHOW_EXAMPLES}""",
)
def x2_percentile_zero(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    return _show_examples(
        sampling.sample_percentile_bins(
            docs.select("row_id", "text"), features.activations(docs, model), range(model.m), N_EXAMPLES, MAX_WORDS,
            SEED, high_percentile=(80, 100),
        )
    )


@query(
    "x2_percentile_bands",
    f"""WITH {MODEL_SQL}, {ACT_DOCS}, {_band_sql('high', 0.9, 1.0, 1, _HALF)}, {_band_sql('low', 0.05, 0.35, 0, _HALF)},
    examples AS (SELECT c.*, {sql_truncate('text', words=MAX_WORDS)} AS text FROM (
      SELECT * FROM high UNION ALL SELECT * FROM low) c JOIN doc_vectors USING (row_id))
    {_SHOW_EXAMPLES}""",
)
def x2_percentile_bands(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    return _show_examples(
        sampling.sample_percentile_bins(
            docs.select("row_id", "text"), features.activations(docs, model), range(model.m), N_EXAMPLES, MAX_WORDS,
            SEED, high_percentile=(90, 100), low_percentile=(5, 35),
        )
    )


def weakest_positives(texts, acts, neurons, n_examples, max_words=None, seed=0):
    """A user's sampler: the least activating positive rows against the most activating."""
    mine = acts.filter(F.col("neuron_idx").isin(list(neurons)) & (F.col("activation") > 0))
    frames = []
    for label, order in ((1, F.desc("activation")), (0, F.asc("activation"))):
        frames.append(
            ranking.top_n_per_group(mine, ["neuron_idx"], [order, F.asc("row_id")], n_examples // 2, salt_on="row_id")
            .select("neuron_idx", F.lit(label).alias("class"), "row_id", "activation")
        )
    return texts.join(F.broadcast(ranking.union_all(frames)), "row_id")


@query(
    "x3_custom_sampler",
    f"""WITH {MODEL_SQL}, {ACT_DOCS}, examples AS (
      SELECT neuron_idx, class, row_id, activation, text FROM (
        SELECT *, 1 AS class, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act_docs
        UNION ALL
        SELECT *, 0, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation, row_id) FROM act_docs)
      JOIN doc_vectors USING (row_id) WHERE r <= {_HALF}) {_SHOW_EXAMPLES}""",
)
def x3_custom_sampler(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    config = sampling.SamplingConfig(function=weakest_positives, n_examples=N_EXAMPLES, random_seed=SEED)
    return _show_examples(config.draw(docs.select("row_id", "text"), features.activations(docs, model), range(model.m)))


@query(
    "x4_random_neurons",
    f"""WITH {MODEL_SQL} SELECT neuron_idx FROM (SELECT DISTINCT neuron_idx FROM enc_large) ORDER BY
    ('0x' || substr(md5('neurons:{SEED}:' || neuron_idx), 1, 13))::BIGINT, neuron_idx LIMIT 6""",
)
def x4_random_neurons(spark, sf):
    neurons = features.neuron_table(spark, [centroid_model(spark, sf, "large")])
    return sampling.sample_neurons(neurons, 6, SEED).select("neuron_idx")


@query(
    "x5_top_texts",
    f"""WITH {MODEL_SQL}, {ACT_DOCS} SELECT neuron_idx, max(text) FILTER (WHERE r = 1) AS top_example_1,
    max(text) FILTER (WHERE r = 2) AS top_example_2, max(text) FILTER (WHERE r = 3) AS top_example_3 FROM (
      SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act_docs)
    JOIN doc_vectors USING (row_id) WHERE r <= 3 GROUP BY neuron_idx""",
)
def x5_top_texts(spark, sf):
    docs = documents_with_vectors(spark, sf)
    model = centroid_model(spark, sf)
    return sampling.top_texts(docs.select("row_id", "text"), features.activations(docs, model), range(model.m), 3)
