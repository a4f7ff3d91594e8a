"""What the operators of this subpackage share: the shared folder, row identity, offsets between parts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from finality.session import ship


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Give Python workers batches of at most ``rows`` rows, as rows hold whole texts; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a temporary folder is taken; on a cluster that is an error.
    """
    ship(spark)
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = getattr(spark.sparkContext, "_finality_scratch", "") or "file://" + tempfile.mkdtemp(prefix="finality-")
        spark.sparkContext._finality_scratch = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage is cut, lost executors take nothing away."""
    folder = shared_folder(table.sparkSession, name)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def row_key(*columns: str) -> list[Column]:
    """Identity of a row by some of its columns: two 64-bit hashes, ``row_a`` and ``row_b``. Equal rows have equal keys."""
    values = [F.col(c) for c in columns]
    return [F.xxhash64(*values).alias("row_a"), F.xxhash64(F.lit("second"), *values).alias("row_b")]


def parts_before(parts: DataFrame, order: str, amounts: list[str]) -> DataFrame:
    """Sums of ``amounts`` over all parts before each part; one short row per task or file.

    The table has as many rows as there were tasks, so it goes through the driver.
    """
    rows = sorted((tuple(r) for r in parts.select(order, *amounts).collect()))
    sums, out = [0] * len(amounts), []
    for row in rows:
        out.append((row[0], *sums))
        sums = [a + b for a, b in zip(sums, row[1:], strict=True)]
    schema = parts.select(order).schema
    for name in amounts:
        schema = schema.add(f"{name}_before", LongType())
    return parts.sparkSession.createDataFrame(out, schema)
