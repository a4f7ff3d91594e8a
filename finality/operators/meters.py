"""Meter metadata, phase lookup and routing of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finality.config import SERIES_L1, SINGLE, THREE, VOLTAGE_SERIES

_BLANKS = "".join(chr(code) for code in range(33))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def classify_meters(lines: DataFrame) -> DataFrame:
    """Metadata lines to ``meter_id, type_description, phases, class``.

    A line needs four comma-separated fields, the description in the fourth and
    a whole number in the last; other lines are left out.
    """
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    description = F.col("type_description")
    return (
        lines.select(fields.alias("f"))
        .filter(F.size("f") >= 4)
        .select(
            _strip(F.col("f")[1]).alias("meter_id"),
            _strip(F.col("f")[3]).alias("type_description"),
            _strip(F.element_at("f", -1)).alias("last"),
        )
        .filter(F.col("last").rlike(r"^[+-]?\d+$"))
        .withColumn("phases", F.col("last").try_cast("int"))
        .filter("phases IS NOT NULL")
        .select(
            "meter_id",
            "type_description",
            "phases",
            F.when(description.contains("3-Phase"), THREE)
            .when(description.contains("1-Phase"), SINGLE)
            .otherwise("OTHER")
            .alias("class"),
        )
    )


def class_totals(classified: DataFrame) -> DataFrame:
    """Number of classified rows per class."""
    return classified.groupBy("class").agg(F.count("*").alias("meters"))


def lookup_of(single_ids: DataFrame, three_ids: DataFrame) -> DataFrame:
    """Phase lookup ``meter_id, phase_group`` out of two id tables."""
    return (
        single_ids.select("meter_id", F.lit(SINGLE).alias("phase_group"))
        .unionByName(three_ids.select("meter_id", F.lit(THREE).alias("phase_group")))
        .distinct()
    )


def is_voltage() -> Column:
    return F.col("series_id").isin(*VOLTAGE_SERIES)


def route(readings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Keep L1 of single-phase meters and L1 to L3 of three-phase meters.

    Adds ``phase_group``; a meter listed in both groups yields its L1 reading
    in each. Spark broadcasts the lookup when its size allows it.
    """
    return (
        readings.filter(is_voltage())
        .join(lookup, "meter_id")
        .filter((F.col("phase_group") == THREE) | (F.col("series_id") == SERIES_L1))
    )
