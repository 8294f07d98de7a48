"""How well a name fits its feature, on sampled examples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corollary.functions.text import text_key
from corollary.operators import jobs, relational
from corollary.operators.sampling import sample_top_zero
from corollary.operators.selection import RANK_DIGITS
from corollary.session import collect_dimension, cut_lineage
from corollary.sources.stores import Store

METRICS = ("recall", "precision", "f1", "correlation")


@dataclass
class ScoringConfig:
    n_examples: int = 100
    max_words_per_example: int | None = 256
    sampling_function: Callable[..., DataFrame] = sample_top_zero
    sampling_kwargs: dict[str, Any] = field(default_factory=dict)
    random_seed: int = 0


def scoring_seed(seed) -> int:
    """Seed of the rows that test names, apart from that of the rows shown for naming."""
    return int(hashlib.md5(f"scoring:{seed}".encode()).hexdigest()[:8], 16)


def fidelity_metrics(scored: DataFrame) -> DataFrame:
    """Metrics per ``(neuron_idx, interpretation)`` of ``class, activation, value`` rows.

    "precision" is one minus the mean annotation of the negatives. All are 0 when a
    class is missing; the correlation is 0 when the annotations are constant.
    """
    v, a = F.col("value").cast("double"), F.col("activation")
    s = scored.filter("value IS NOT NULL").groupBy("neuron_idx", "interpretation").agg(
        F.avg(F.when(F.col("class") == 1, v)).alias("on_rate"),
        F.avg(F.when(F.col("class") == 0, v)).alias("off_rate"),
        F.count("*").alias("n"),
        F.sum(a).alias("sa"),
        F.sum(a * a).alias("saa"),
        F.sum(v).alias("sv"),
        F.sum(a * v).alias("sav"),
        F.sum(v * v).alias("svv"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
    )
    both = F.col("on_rate").isNotNull() & F.col("off_rate").isNotNull()
    n, sa, sv = F.col("n"), F.col("sa"), F.col("sv")
    spread = F.sqrt(F.greatest(n * F.col("saa") - sa * sa, F.lit(0.0))) * F.sqrt(
        F.greatest(n * F.col("svv") - sv * sv, F.lit(0.0))
    )
    recall, precision = F.col("on_rate"), 1 - F.col("off_rate")
    zero = F.lit(0.0)
    return s.select(
        "neuron_idx",
        "interpretation",
        F.when(both, recall).otherwise(zero).alias("recall"),
        F.when(both, precision).otherwise(zero).alias("precision"),
        F.when(both & (recall + precision > 0), 2 * recall * precision / (recall + precision))
        .otherwise(zero)
        .alias("f1"),
        F.when(both & (F.col("lowest") < F.col("highest")), F.try_divide(n * F.col("sav") - sa * sv, spread))
        .otherwise(zero)
        .alias("correlation"),
    )


def score_interpretations(
    texts: DataFrame,
    acts: DataFrame,
    names: DataFrame,
    answer_fn: jobs.AnswerFn,
    *,
    store: Store | None = None,
    config: ScoringConfig | None = None,
) -> DataFrame:
    """Score every candidate name on its feature's sampled rows, all features in one job."""
    config = config or ScoringConfig()
    neurons = [r[0] for r in collect_dimension(names.filter("interpretation IS NOT NULL").select("neuron_idx").distinct())]
    examples = config.sampling_function(
        texts, acts, neurons, config.n_examples, config.max_words_per_example, scoring_seed(config.random_seed),
        **config.sampling_kwargs,
    )
    # n_examples per neuron; written down because both the tasks and their metrics use them
    examples = cut_lineage(examples)
    tasks = relational.example_tasks(examples, names).select(
        "neuron_idx", "interpretation", "class", "activation", "text", text_key(F.col("text")).alias("text_key")
    )
    answers = jobs.annotate(
        tasks.select(F.col("interpretation").alias("concept"), "text"), answer_fn, store=store
    )
    scored = tasks.drop("text").join(
        answers.withColumnRenamed("concept", "interpretation"), ["interpretation", "text_key"], "left"
    )
    return fidelity_metrics(scored)


def best_names(names: DataFrame, metrics: DataFrame, metric: str = "f1", *, worst: bool = False) -> DataFrame:
    """Best (or worst) name per feature; the first candidate wins ties."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    key = F.round(F.col(metric), RANK_DIGITS)
    order = [key.asc_nulls_last() if worst else key.desc_nulls_last(), F.asc("candidate_idx")]
    ranked = names.join(metrics, ["neuron_idx", "interpretation"], "left").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("neuron_idx").orderBy(*order))
    )
    return ranked.filter("_rank = 1").select("neuron_idx", "candidate_idx", "interpretation", metric)
