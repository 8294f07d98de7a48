"""End-to-end plans: explore features, generate hypotheses, evaluate them."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.operators import evaluation, features, fidelity, jobs, relational, sampling, selection
from corollary.operators.features import FeatureModel
from corollary.operators.sampling import SamplingConfig
from corollary.session import collect_dimension, cut_lineage
from corollary.sources.stores import Store


def _as_list(models: FeatureModel | Sequence[FeatureModel]) -> list[FeatureModel]:
    return [models] if isinstance(models, FeatureModel) else list(models)


def _source(neurons: DataFrame) -> DataFrame:
    return neurons.select(
        "neuron_idx", F.struct(F.col("source_m").alias("m"), F.col("source_k").alias("k")).alias("source_sae")
    )


def interpret_sae(
    texts: DataFrame,
    vectors: DataFrame,
    models: FeatureModel | Sequence[FeatureModel],
    complete_fn: jobs.AnswerFn,
    *,
    neuron_indices: Sequence[int] | None = None,
    n_random_neurons: int | None = None,
    n_examples_for_interpretation: int = 20,
    max_words_per_example: int | None = 256,
    n_candidates: int = 1,
    print_examples_n: int = 3,
    task_specific_instructions: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """``neuron_idx, source_sae, interpretation, top_example_1 ..`` for chosen features.

    ``texts(row_id, text)``, ``vectors(row_id, embedding)``. With several candidates the
    interpretation is an array.
    """
    if (neuron_indices is None) == (n_random_neurons is None):
        raise ValueError("give exactly one of neuron_indices and n_random_neurons")
    models = _as_list(models)
    neurons = features.neuron_table(texts.sparkSession, models)
    acts = features.many_activations(vectors, models).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if neuron_indices is None:
            chosen = sampling.sample_neurons(neurons, n_random_neurons, seed).select("neuron_idx")
            neuron_indices = [r[0] for r in chosen.collect()]
        config = jobs.InterpretConfig(
            sampling=SamplingConfig(
                n_examples=n_examples_for_interpretation, max_words_per_example=max_words_per_example, random_seed=seed
            ),
            n_candidates=n_candidates,
            task_specific_instructions=task_specific_instructions,
        )
        names = jobs.interpret_neurons(texts, acts, neuron_indices, complete_fn, config)
        if n_candidates == 1:
            names = names.select("neuron_idx", "interpretation")
        else:
            ordered = F.array_sort(F.collect_list(F.struct("candidate_idx", "interpretation")))
            names = names.groupBy("neuron_idx").agg(F.transform(ordered, lambda s: s["interpretation"]).alias("interpretation"))
        out = names.join(_source(neurons), "neuron_idx").select("neuron_idx", "source_sae", "interpretation")
        if print_examples_n > 0:
            out = out.join(sampling.top_texts(texts, acts, neuron_indices, print_examples_n), "neuron_idx", "left")
        return _written(out)
    finally:
        acts.unpersist()


def check_same_rows(**tables: DataFrame) -> None:
    """Raise unless all tables hold the same row ids, each as often; by counts and two sums of hashes, without a join."""
    marks = {}
    for name, frame in tables.items():
        key = F.xxhash64("row_id")
        marks[name] = tuple(frame.agg(F.count("row_id"), F.bit_xor(key), F.sum(F.pmod(key, F.lit(1 << 31)))).first())
    if len(set(marks.values())) > 1:
        raise ValueError(f"rows differ between {', '.join(f'{k} ({m[0]})' for k, m in marks.items())}")


def _written(result: DataFrame) -> DataFrame:
    """A result made independent of the cached activations it came from; it holds whole texts, so it stays off the driver."""
    return cut_lineage(result)


def generate_hypotheses(
    texts: DataFrame,
    targets: DataFrame,
    vectors: DataFrame,
    models: FeatureModel | Sequence[FeatureModel],
    complete_fn: jobs.AnswerFn,
    answer_fn: jobs.AnswerFn | None = None,
    *,
    store: Store | None = None,
    classification: bool | None = None,
    selection_method: str = "separation_score",
    n_selected_neurons: int = 20,
    n_examples_for_interpretation: int = 20,
    max_words_per_example: int | None = 256,
    n_candidate_interpretations: int = 1,
    n_scoring_examples: int = 100,
    scoring_metric: str = "f1",
    task_specific_instructions: str | None = None,
    seed: int = 0,
    selection_kwargs: dict | None = None,
    sampling: SamplingConfig | None = None,
    scoring: fidelity.ScoringConfig | None = None,
) -> DataFrame:
    """Hypotheses about what predicts the target, in order of selection.

    ``neuron_idx, source_sae, target_<method>, interpretation, <metric>_fidelity_score``.
    A target column ``y`` in ``vectors`` rides along through feature inference. Without
    one the target is joined to the sparse activations, never to the vectors, which are
    far wider. Texts, targets and vectors must cover the same rows.
    """
    models = _as_list(models)
    check_same_rows(texts=texts, targets=targets, vectors=vectors)
    neurons = features.neuron_table(texts.sparkSession, models)
    total = sum(m.m for m in models)
    if n_selected_neurons > total:
        raise ValueError(f"n_selected_neurons ({n_selected_neurons}) can be at most {total}")
    if classification is None:
        classification = relational.is_binary(targets).first()[0]
    carry = ("y",) if "y" in vectors.columns else ()
    acts = selection.with_target(features.many_activations(vectors, models, carry=carry), targets)
    acts = acts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _written(
            hypotheses_from_activations(
                texts, acts, targets, neurons, complete_fn, answer_fn, store=store, classification=classification,
                selection_method=selection_method, n_selected_neurons=n_selected_neurons,
                sampling=sampling
                or SamplingConfig(
                    n_examples=n_examples_for_interpretation,
                    max_words_per_example=max_words_per_example,
                    random_seed=seed,
                ),
                n_candidates=n_candidate_interpretations, n_scoring_examples=n_scoring_examples,
                scoring_metric=scoring_metric, task_specific_instructions=task_specific_instructions, seed=seed,
                selection_kwargs=selection_kwargs, scoring=scoring,
            )
        )
    finally:
        acts.unpersist()


def hypotheses_from_activations(
    texts, acts, targets, neurons, complete_fn, answer_fn, *, store, classification, selection_method,
    n_selected_neurons, sampling, n_candidates, n_scoring_examples, scoring_metric, task_specific_instructions,
    seed, selection_kwargs, scoring=None,
) -> DataFrame:
    """The steps after feature inference: select, name, score, keep the best name."""
    selected = _written(
        selection.select_neurons(
            acts, targets, n_selected_neurons, neurons=neurons, method=selection_method,
            classification=classification, **(selection_kwargs or {}),
        )
    )
    chosen = [r["neuron_idx"] for r in selected.orderBy("rank").collect()]
    config = jobs.InterpretConfig(
        sampling=sampling, n_candidates=n_candidates, task_specific_instructions=task_specific_instructions
    )
    names = jobs.interpret_neurons(texts, acts, chosen, complete_fn, config)
    target = f"target_{selection_method}"
    base = selected.withColumnRenamed("score", target).join(_source(neurons), "neuron_idx")
    if n_scoring_examples == 0:
        first = names.filter("candidate_idx = 0").select("neuron_idx", "interpretation")
        out = base.join(first, "neuron_idx", "left")
        return out.orderBy("rank").select("neuron_idx", "source_sae", target, "interpretation")
    if answer_fn is None:
        raise ValueError("scoring names needs answer_fn; pass n_scoring_examples=0 to skip it")
    metrics = fidelity.score_interpretations(
        texts, acts, names, answer_fn, store=store,
        config=scoring or fidelity.ScoringConfig(n_examples=n_scoring_examples, random_seed=seed),
    )
    best = fidelity.best_names(names, metrics, scoring_metric).select(
        "neuron_idx", "interpretation", F.col(scoring_metric).alias(f"{scoring_metric}_fidelity_score")
    )
    out = base.join(best, "neuron_idx", "left").orderBy("rank")
    return out.select("neuron_idx", "source_sae", target, "interpretation", f"{scoring_metric}_fidelity_score")


def evaluate_hypotheses(
    hypotheses: DataFrame | Sequence[str],
    texts: DataFrame,
    targets: DataFrame,
    answer_fn: jobs.AnswerFn,
    *,
    store: Store | None = None,
    max_words_per_example: int | None = 256,
    classification: bool | None = None,
    corrected_pval_threshold: float = 0.1,
    drop_unanswered: bool = False,
) -> tuple[dict, DataFrame]:
    """Annotate held-out texts with every hypothesis and test them against the target.

    Rows the model gave no clear answer for, or that have a target and no text, are an error unless ``drop_unanswered``.
    """
    if isinstance(hypotheses, DataFrame):
        named = hypotheses.filter("interpretation IS NOT NULL").select("interpretation")
        hypotheses = [r[0] for r in collect_dimension(named)]
    concepts = list(dict.fromkeys(hypotheses))
    if not concepts:
        raise ValueError("no hypothesis to evaluate")
    if classification is None:
        classification = relational.is_binary(targets).first()[0]
    columns = jobs.annotation_columns(texts, concepts, answer_fn, store=store, max_words=max_words_per_example)
    design = targets.select("row_id", F.col("y").cast("double").alias("y")).join(columns, "row_id", "left")
    return _score(design, concepts, classification, corrected_pval_threshold, drop_unanswered)


def _score(design, concepts, classification, threshold, drop_unanswered) -> tuple[dict, DataFrame]:
    if drop_unanswered:
        design = design.dropna(subset=evaluation.concept_columns(concepts))
    design = design.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metrics, table = evaluation.score_hypotheses(
            design, concepts, classification=classification, corrected_pval_threshold=threshold
        )
        return metrics, _written(table)
    finally:
        design.unpersist()


def evaluate_pairs(
    hypotheses: Sequence[str],
    texts: DataFrame,
    pairs: DataFrame,
    answer_fn: jobs.AnswerFn,
    *,
    store: Store | None = None,
    max_words_per_example: int | None = 256,
    classification: bool = True,
    corrected_pval_threshold: float = 0.1,
    drop_unanswered: bool = False,
) -> tuple[dict, DataFrame]:
    """The same for pairs: annotations of A minus those of B, against ``pairs.y``."""
    concepts = list(dict.fromkeys(hypotheses))
    annotations = jobs.annotate_texts_with_concepts(
        texts, concepts, answer_fn, store=store, max_words=max_words_per_example
    )
    signed = relational.pair_annotation_difference(pairs, annotations).withColumnRenamed("pair_id", "row_id")
    targets = pairs.select(F.col("pair_id").alias("row_id"), "y")
    design = evaluation.design_table(signed, targets, concepts)
    return _score(design, concepts, classification, corrected_pval_threshold, drop_unanswered)


def generate_pair_hypotheses(
    texts: DataFrame,
    pairs: DataFrame,
    vectors: DataFrame,
    models: FeatureModel | Sequence[FeatureModel],
    complete_fn: jobs.AnswerFn,
    answer_fn: jobs.AnswerFn | None = None,
    *,
    selection_method: str = "lasso",
    classification: bool = True,
    n_selected_neurons: int = 20,
    sampling: SamplingConfig | None = None,
    n_candidate_interpretations: int = 1,
    n_scoring_examples: int = 100,
    scoring_metric: str = "f1",
    store: Store | None = None,
    task_specific_instructions: str | None = None,
    seed: int = 0,
    selection_kwargs: dict | None = None,
    scoring: fidelity.ScoringConfig | None = None,
) -> DataFrame:
    """Hypotheses from ``Z_A - Z_B``: features are selected on pair differences and named
    on single texts."""
    models = _as_list(models)
    neurons = features.neuron_table(texts.sparkSession, models)
    acts = features.many_activations(vectors, models).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        differences = relational.pair_activation_difference(pairs, acts).withColumnRenamed("pair_id", "row_id")
        targets = pairs.select(F.col("pair_id").alias("row_id"), "y")
        selected = _written(
            selection.select_neurons(
                differences, targets, n_selected_neurons, neurons=neurons, method=selection_method,
                classification=classification, **(selection_kwargs or {}),
            )
        )
        chosen = [r["neuron_idx"] for r in selected.orderBy("rank").collect()]
        config = jobs.InterpretConfig(
            sampling=sampling or SamplingConfig(random_seed=seed), n_candidates=n_candidate_interpretations,
            task_specific_instructions=task_specific_instructions,
        )
        names = jobs.interpret_neurons(texts, acts, chosen, complete_fn, config)
        if n_scoring_examples and answer_fn is not None:
            metrics = fidelity.score_interpretations(
                texts, acts, names, answer_fn, store=store,
                config=scoring or fidelity.ScoringConfig(n_examples=n_scoring_examples, random_seed=seed),
            )
            names = fidelity.best_names(names, metrics, scoring_metric).withColumnRenamed(
                scoring_metric, f"{scoring_metric}_fidelity_score"
            )
        else:
            names = names.filter("candidate_idx = 0")
            if n_scoring_examples:
                warnings.warn("no answer_fn: names are not scored", stacklevel=2)
        out = (
            selected.withColumnRenamed("score", f"target_{selection_method}")
            .join(_source(neurons), "neuron_idx")
            .join(names.drop("candidate_idx"), "neuron_idx", "left")
            .orderBy("rank")
        )
        return _written(out.drop("rank"))
    finally:
        acts.unpersist()
