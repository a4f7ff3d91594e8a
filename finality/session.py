"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def ship(spark: SparkSession) -> None:
    """Put this package on the import path of the Python workers."""
    context = spark.sparkContext
    if getattr(context, "_finality_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="finality-"), "finality.zip")
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._finality_shipped = True


def settled(table: DataFrame) -> DataFrame:
    """The table computed once and kept in the checkpoint folder.

    For a short table that several branches of a plan read. The folder is the
    one the cluster names in ``spark.checkpoint.dir``; without one, as in tests,
    a temporary folder is used.
    """
    spark = table.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return table.checkpoint()


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; nothing is created."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def only_row(table: DataFrame, name: str) -> DataFrame:
    """The row of a table that has one; no row stays none, and more than one is an error."""
    folded = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in table.columns])
    several = F.raise_error(F.lit(f"{name}: one row expected")).cast("boolean")
    return folded.filter(F.when(F.col("_rows") > 1, several).otherwise(F.col("_rows") == 1)).drop("_rows")
