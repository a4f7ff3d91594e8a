"""Readings, metric samples and metadata derived from general event tables.

The engine's own inputs are meter readings and metric files. These functions
map an ``events`` table (``event_id, ts, user_id, event_type, value, props``)
and a ``customer`` table onto them, in integer arithmetic only, so that any SQL
engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from finality.config import SERIES_L1, SERIES_L2, SERIES_L3, SINGLE, THREE, WindowSpec

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)
DAY_MS = 86_400_000

# Sparse stand-in data: four-day windows, four readings per series, zero means value <= 50.
SPARSE = WindowSpec(size_ms=4 * DAY_MS, expected=4, threshold=0.75, zero_tolerance=50.0)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as readings; arrival order is ``event_id``, arrival time ``ts``."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("bigint")
    arrival_s = F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint")
    delay_min = F.expr("(k * k * k * 2880) div 1000000")
    return (
        events(spark, folder)
        .select(
            F.col("event_id").alias("arrival_seq"),
            arrival_s.alias("arrival_s"),
            F.col("user_id").cast("string").alias("meter_id"),
            F.when(F.col("user_id") % 3 == 0, THREE).otherwise(SINGLE).alias("meter_phase"),
            F.when(F.col("event_type").isin("error", "click"), SERIES_L1)
            .when(F.col("event_type").isin("view", "purchase"), SERIES_L2)
            .otherwise(SERIES_L3)
            .alias("series_id"),
            k.alias("k"),
            "value",
        )
        .select(
            "arrival_seq",
            F.expr("arrival_s div 86400").alias("arrival_epoch"),
            "meter_id",
            "series_id",
            ((F.col("arrival_s") - delay_min * 60) * 1000).alias("event_ms"),
            "value",
            (F.col("arrival_s") * 1000).alias("insert_ms"),
            F.when(
                (F.col("meter_phase") == THREE) | (F.col("series_id") == SERIES_L1),
                F.col("meter_phase"),
            ).alias("phase_group"),
        )
    )
