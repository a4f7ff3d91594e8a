"""Window, slot and completeness arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from finality.config import (
    SERIES_L1,
    SERIES_L2,
    SERIES_L3,
    THREE,
    THREE_PHASE_LABEL,
    WindowSpec,
)


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above an integer value, also below zero."""
    return value - F.pmod(value, F.lit(step))


def window_start(event_ms: Column, spec: WindowSpec) -> Column:
    return floor_to(event_ms, spec.size_ms)


def slot_index(event_ms: Column, spec: WindowSpec) -> Column:
    return F.floor(F.pmod(event_ms, F.lit(spec.size_ms)) / spec.slot_ms).cast("int")


def phase_index(series_id: Column) -> Column:
    return (
        F.when(series_id == SERIES_L1, 0)
        .when(series_id == SERIES_L2, 1)
        .when(series_id == SERIES_L3, 2)
        .otherwise(-1)
    )


def slot_key(phase_group: Column, event_ms: Column, phase: Column, spec: WindowSpec) -> Column:
    """Distinct-slot key: the slot, or slot and phase; null when neither fits."""
    slot = slot_index(event_ms, spec)
    return F.when(phase_group != THREE, slot).when(phase >= 0, slot * 3 + phase)


def series_label(phase_group: Column) -> Column:
    return F.when(phase_group == THREE, F.lit(THREE_PHASE_LABEL)).otherwise(F.lit(SERIES_L1))


def by_phase(phase_group: Column, three, single) -> Column:
    return F.when(phase_group == THREE, F.lit(three)).otherwise(F.lit(single))


def expected_of_label(series_id: Column, spec: WindowSpec) -> Column:
    return F.when(series_id == THREE_PHASE_LABEL, spec.expected * 3).otherwise(spec.expected)


def completeness_ratio(count: Column, expected: Column) -> Column:
    return count.cast("double") / expected


def completeness_text(count: Column, expected: Column) -> Column:
    return F.format_string("%.1f%%", completeness_ratio(count, expected) * 100)


def preliminary_met(count: Column, expected: Column, spec: WindowSpec) -> Column:
    """Offline rule: the count, null as zero, reaches the rounded-up threshold."""
    return F.coalesce(count, F.lit(0)) >= F.ceil(expected * F.lit(spec.threshold))


def final_met(count: Column, expected: Column) -> Column:
    return F.coalesce(count, F.lit(0)) >= expected


def early_purge_inferred(reason: Column | None, count: Column, expected: Column) -> Column:
    """Completed early by the stated reason, or by the count when none is stated."""
    full = final_met(count, expected)
    if reason is None:
        return full
    upper = F.upper(F.coalesce(reason, F.lit("")))
    known = upper.isin("COMPLETENESS", "DEADLINE")
    return (upper == "COMPLETENESS") | (~known & full)


def early_purges() -> dict[str, Column]:
    """Of a final emission: latency below the allowed lateness (``early_purged_raw``), and that after completion by count."""
    early = (
        (F.col("result_type") == "FINAL")
        & (F.col("mode") == "PROPOSED")
        & (F.col("allowed_lateness_ms") > 0)
        & (F.col("finalization_latency_ms") < F.col("allowed_lateness_ms"))
    )
    return {
        "early_purged_raw": early,
        "early_purged": early & (F.col("finalization_reason") == "COMPLETENESS"),
    }


def finalization_latency(watermark_ms: Column, window_end_ms: Column, lateness_ms: int) -> Column:
    """Watermark past window end, kept in 0..lateness; no watermark counts as 0."""
    passed = F.coalesce(watermark_ms, window_end_ms) - window_end_ms
    return F.greatest(F.lit(0), F.least(F.lit(lateness_ms), passed)).cast("bigint")


def latency_reduction(latency_ms: Column, lateness_ms: int) -> Column:
    return F.greatest(F.lit(0), F.lit(lateness_ms) - latency_ms).cast("bigint")


def duration_ms(text: Column) -> Column:
    """Duration text ``0, Nm, Nh, Nd`` to ms; null when it is none of these."""
    amount = F.regexp_extract(text, r"^([+-]?\d+)[mhd]$", 1).try_cast("bigint")
    unit = F.substring(text, -1, 1)
    factor = F.when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.when(text == "0", F.lit(0).cast("bigint")).otherwise(amount * factor)


def duration_label(seconds: Column) -> Column:
    """``45s``, ``12m``, ``4h 01m`` or ``5d 02h``."""
    whole = F.floor(seconds).cast("bigint")
    return (
        F.when(seconds < 60, F.format_string("%ds", F.bround(seconds, 0).cast("bigint")))
        .when(seconds < 3600, F.format_string("%dm", F.bround(seconds / 60, 0).cast("bigint")))
        .when(
            seconds < 86_400,
            F.format_string(
                "%dh %02dm", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
            ),
        )
        .otherwise(
            F.format_string(
                "%dd %02dh", F.floor(whole / 86_400), F.floor(F.pmod(whole, F.lit(86_400)) / 3600)
            )
        )
    )


def split_legacy_key(key: Column) -> tuple[Column, Column]:
    """Meter and series out of ``meter_series`` at the last voltage marker."""
    pattern = r"(?s)^(.*)_(Spänning.*)$"
    found = key.rlike(pattern)
    meter = F.when(found, F.regexp_extract(key, pattern, 1)).otherwise(key)
    series = F.when(found, F.regexp_extract(key, pattern, 2)).otherwise(F.lit("unknown"))
    return meter, series
