"""Finding and testing explanations of a target variable in text tables, on Spark."""

from corollary.functions.text import for_printing, truncate
from corollary.operators.evaluation import score_hypotheses
from corollary.operators.features import FeatureModel, many_activations
from corollary.operators.fidelity import ScoringConfig
from corollary.operators.jobs import InterpretConfig, annotate_texts_with_concepts, embed_texts
from corollary.operators.sampling import SamplingConfig
from corollary.operators.selection import select_neurons
from corollary.operators.training import TrainConfig, train_sae
from corollary.plans.flows import (
    evaluate_hypotheses,
    evaluate_pairs,
    generate_hypotheses,
    generate_pair_hypotheses,
    interpret_sae,
)
from corollary.sources.models import load_model, save_model
from corollary.sources.stores import annotation_store, embedding_store

__all__ = [
    "FeatureModel",
    "InterpretConfig",
    "SamplingConfig",
    "ScoringConfig",
    "TrainConfig",
    "annotate_texts_with_concepts",
    "annotation_store",
    "embed_texts",
    "embedding_store",
    "evaluate_hypotheses",
    "evaluate_pairs",
    "for_printing",
    "generate_hypotheses",
    "generate_pair_hypotheses",
    "interpret_sae",
    "load_model",
    "many_activations",
    "save_model",
    "score_hypotheses",
    "select_neurons",
    "train_sae",
    "truncate",
]
