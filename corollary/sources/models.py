"""Trained models as tables: one row per neuron, and one config row written last.

The config row names the parameter folder it belongs to, so a save that was interrupted
leaves the earlier model whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from corollary.operators.features import FeatureModel

PARAMS_SCHEMA = (
    "model_id string, neuron_idx int, enc array<double>, dec array<double>, bias double, idle_steps long"
)
CONFIG_SCHEMA = (
    "model_id string, input_dim int, m int, k int, aux_k int, multi_k int, dead_threshold int, "
    "prefixes array<int>, input_bias array<double>, fingerprint string, params string"
)


def folder_name(dim: int, m: int, k: int, prefixes: Sequence[int] | None = None, fingerprint: str | None = None) -> str:
    """Folder of a model: its vectors' width and mark, so that two corpora don't share one, and its shape."""
    nested = f".nested-{'.'.join(map(str, prefixes))}" if prefixes else ""
    corpus = f".on-{hashlib.md5(fingerprint.encode()).hexdigest()[:12]}" if fingerprint else ""
    return f"topk{k}-of-{m}-from-{dim}{nested}{corpus}"


def params_table(spark: SparkSession, model: FeatureModel, model_id: str) -> DataFrame:
    rows = [
        (model_id, i, model.enc[i].tolist(), model.dec[i].tolist(), float(model.neuron_bias[i]),
         int(model.steps_since_active[i]))
        for i in range(model.m)
    ]
    return spark.createDataFrame(rows, PARAMS_SCHEMA)


def save_model(spark: SparkSession, model: FeatureModel, path: str) -> str:
    """Write parameters to a new folder, then the config row that points to it."""
    name = folder_name(model.dim, model.m, model.k, model.prefixes, model.fingerprint)
    params = f"params-{uuid.uuid4().hex}"
    params_table(spark, model, name).write.parquet(f"{path}/{params}")
    config = (
        name, model.dim, model.m, model.k, model.aux_k, model.multi_k, model.dead_threshold,
        model.prefixes, model.input_bias.tolist(), model.fingerprint, params,
    )
    spark.createDataFrame([config], CONFIG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.schema(CONFIG_SCHEMA).parquet(f"{path}/config").take(1))
    except AnalysisException:
        return False


def load_model(spark: SparkSession, path: str, *, fingerprint: str | None = None) -> FeatureModel:
    """Read a model; with ``fingerprint``, refuse one trained on other vectors."""
    config = spark.read.schema(CONFIG_SCHEMA).parquet(f"{path}/config").first()
    if fingerprint is not None and config["fingerprint"] != fingerprint:
        raise ValueError(f"model at {path} was trained on other vectors; pass overwrite_checkpoint=True")
    params = spark.read.schema(PARAMS_SCHEMA).parquet(f"{path}/{config['params']}")
    rows = sorted(params.collect(), key=lambda r: r["neuron_idx"])
    return FeatureModel(
        enc=np.array([r["enc"] for r in rows]),
        dec=np.array([r["dec"] for r in rows]),
        neuron_bias=np.array([r["bias"] for r in rows]),
        input_bias=np.array(config["input_bias"]),
        k=config["k"],
        aux_k=config["aux_k"],
        multi_k=config["multi_k"],
        dead_threshold=config["dead_threshold"],
        prefixes=config["prefixes"],
        steps_since_active=np.array([r["idle_steps"] for r in rows]),
        fingerprint=config["fingerprint"],
    )
