"""Plain window aggregates: count and sum, with and without completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from finality.config import Policy, WindowSpec
from finality.functions.timecols import local_text
from finality.functions.windowing import completeness_text, phase_index, slot_key
from finality.operators.replay import GROUP


def sum_windows(taken: DataFrame, spec: WindowSpec) -> DataFrame:
    """Count and sum of the readings of each window, with its bounds as text."""
    return (
        taken.groupBy(*GROUP, "window_end_ms")
        .agg(F.count("*").alias("count"), F.sum("value").alias("sum_value"))
        .withColumns(
            {
                "window_start": local_text(F.col("window_start_ms"), spec.zone),
                "window_end": local_text(F.col("window_end_ms"), spec.zone),
            }
        )
    )


def sum_windows_with_completeness(
    taken: DataFrame, passes: DataFrame, policy: Policy, spec: WindowSpec
) -> DataFrame:
    """Sum windows as full or final, and else as preliminary.

    A window is final when its count reaches ``expected`` or the watermark has
    passed its deadline.
    """
    windows = sum_windows(taken, spec).join(passes, "window_end_ms", "left")
    final = (F.col("count") >= spec.expected) | F.col("pass_seq").isNotNull()
    return windows.withColumns(
        {
            "completeness": completeness_text(F.col("count"), F.lit(spec.expected)),
            "result_type": F.when(final, "FINAL").otherwise("PRELIMINARY"),
        }
    ).drop("pass_seq", "pass_event_ms")


def distinct_slot_windows(taken: DataFrame, spec: WindowSpec) -> DataFrame:
    """Distinct slots of each window as a bitmap, which merges before the shuffle."""
    key = slot_key(
        F.col("phase_group"), F.col("event_ms"), phase_index(F.col("series_id")), spec
    )
    bit = F.expr("shiftleft(1L, slot)")
    return (
        taken.withColumn("slot", key)
        .groupBy(*GROUP)
        .agg(
            F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("int").alias("distinct_slot_count"),
            F.count("*").alias("count"),
        )
    )
