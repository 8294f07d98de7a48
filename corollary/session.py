"""Session helpers: lineage cutting and size checks shared by the operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest driver-side or broadcast payload (bytes) an operator may build on its own.
BROADCAST_BYTES = 512 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is configured.

    On a cluster the folder must come from ``spark.checkpoint.dir``; a machine-local
    folder is used only by a local session such as the tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="corollary-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder.

    Needed after a user model has run: a lost executor must not make the model answer
    a second time, possibly differently.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder in the shared checkpoint folder, removed when the block is left.

    For tables that nothing reads later.
    """
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


def collect_dimension(df: DataFrame) -> list:
    """Collect numbers or names of a dimension whose size the driver holds anyway: one row per
    neuron of a model, or per concept of a list, that was given from there."""
    return df.collect()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only needed where the package is not installed on the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="corollary-ship-"))
    archive = shutil.make_archive(str(folder / "corollary"), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
