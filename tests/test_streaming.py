"""The row-level operators are stateless, so they run on a streaming table as they are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corollary.functions import text
from corollary.operators import features
from corollary.operators.features import FeatureModel
from corollary.session import ship_package


def test_text_functions_and_inference_on_a_stream(spark, tmp_path):
    ship_package(spark)
    rows = [(i, f"one two {i}", [float(i), 1.0]) for i in range(6)] + [(6, " ", [0.0, 0.0])]
    given = spark.createDataFrame(rows, "row_id long, text string, embedding array<double>")
    given.repartition(3).write.parquet(str(tmp_path / "in"))
    model = FeatureModel(np.eye(2), np.eye(2), np.zeros(2), np.zeros(2), 1)
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    valid = text.drop_invalid(stream).withColumn("short", text.truncate(F.col("text"), max_words=1))
    acts = features.activations(valid, model, carry=("short",))
    query = acts.writeStream.format("memory").queryName("acts").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.row_id, r.neuron_idx, r.short) for r in spark.table("acts").collect())
    mark = "one" + text.TRUNCATION_MESSAGE
    assert got == [(0, 1, mark), *[(i, 0, mark) for i in range(1, 6)]]
