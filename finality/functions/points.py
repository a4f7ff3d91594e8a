"""Window content computed from an array of points.

A point is ``struct(event_ms, seq, value, phase)``; the array is in event
order, and points with equal event time keep their arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finality.config import THREE, VOLTAGE_SERIES, WindowSpec
from finality.functions.windowing import slot_key


def event_order(points: Column) -> Column:
    """Points of any field order, sorted by event time and arrival."""
    return F.sort_array(
        F.transform(
            points, lambda p: F.struct(p["event_ms"], p["seq"], p["value"], p["phase"])
        )
    )


def is_zero(value: Column, spec: WindowSpec) -> Column:
    return F.abs(value) <= spec.zero_tolerance


def _series(points: Column, phase: int) -> Column:
    return F.filter(points, lambda p: p["phase"] == phase)


def zero_run(points: Column, phase: int, spec: WindowSpec) -> Column:
    """True when one series has ``spec.zero_run`` zero readings in a row."""
    marks = F.transform(
        _series(points, phase), lambda p: F.when(is_zero(p["value"], spec), "0").otherwise("1")
    )
    return F.contains(F.array_join(marks, ""), F.lit("0" * spec.zero_run))


def fault(phase_group: Column, points: Column, spec: WindowSpec) -> Column:
    """Zero run on L1, or for three-phase meters on every phase."""
    first = zero_run(points, 0, spec)
    every = first & zero_run(points, 1, spec) & zero_run(points, 2, spec)
    return F.when(phase_group == THREE, every).otherwise(first)


def distinct_slots(phase_group: Column, points: Column, spec: WindowSpec) -> Column:
    keys = F.transform(
        points, lambda p: slot_key(phase_group, p["event_ms"], p["phase"], spec)
    )
    return F.size(F.array_distinct(F.array_compact(keys)))


def series_text(points: Column, phase: int) -> Column:
    values = F.transform(_series(points, phase), lambda p: F.format_string("%.3f", p["value"]))
    return F.concat(F.lit(f"{VOLTAGE_SERIES[phase]}=["), F.array_join(values, ";"), F.lit("]"))


def voltage_text(phase_group: Column, points: Column) -> Column:
    """``name=[v;v]`` per series in event order, series joined by ``|``."""
    texts = [series_text(points, phase) for phase in range(3)]
    return F.when(phase_group == THREE, F.concat_ws("|", *texts)).otherwise(texts[0])


def value_sum(points: Column) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda total, p: total + p["value"])


def default_content(spec: WindowSpec) -> dict:
    """Named window content: each entry maps (phase group, points) to a column.

    Entries may refer to earlier ones by name. The voltage text is written for
    faulty windows only, so it stays null in the others.
    """
    return {
        "fault_indicator": lambda group, points: fault(group, points, spec),
        "distinct_slot_count": lambda group, points: distinct_slots(group, points, spec),
        "voltage_data": lambda group, points: F.when(
            F.col("fault_indicator"), voltage_text(group, points)
        ),
    }


def with_content(rows: DataFrame, content: dict) -> DataFrame:
    """Add the content of ``phase_group`` and ``points`` as columns."""
    if not content:
        return rows
    rows = rows.withColumn("points", event_order(F.col("points")))
    for name, make in content.items():
        rows = rows.withColumn(name, make(F.col("phase_group"), F.col("points")))
    return rows
