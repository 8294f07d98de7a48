"""Text and target tables in, prompts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON-lines table. Give a schema to avoid the inference pass over the data."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, *, multiline: bool = False
) -> DataFrame:
    """CSV table with a header row. ``multiline`` allows line breaks inside quotes, at the
    price that a file can no longer be split among tasks."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Write ``row_id, prompt`` as whole-text records.

    The index travels in the record, not in a folder name: a folder per prompt would
    mean as many files as rows. Read back with :func:`read_prompts`.
    """
    prompts.select(F.col("row_id").alias("prompt_idx"), "prompt").write.mode("overwrite").json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prompt_idx long, prompt string").json(path)


def write_prompt_files(prompts: DataFrame, path: str) -> None:
    """One text file per prompt under ``prompt_idx=<row_id>/``. A folder per row burdens the file
    system of a large set; :func:`write_prompts` has no such cost."""
    prompts.select(F.col("row_id").alias("prompt_idx"), F.col("prompt").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("prompt_idx").option("lineSep", "\x00").text(path)
