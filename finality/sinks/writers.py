"""Result files: headed CSV, one folder per metric and run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Headers of the result files, in order.
OUTPUT_COUNTS = {
    "mode": "mode",
    "meterId": "meter_id",
    "seriesId": "series_id",
    "windowStartMs": "window_start_ms",
    "windowEndMs": "window_end_ms",
    "outputCount": "output_count",
    "earlyPurged": "early_purged_raw",
    "finalCount": "final_count",
    "distinctSlotCount": "distinct_slot_count",
}
FINALIZATION = {
    "mode": "mode",
    "resultType": "result_type",
    "finalizationReason": "finalization_reason",
    "meterId": "meter_id",
    "seriesId": "series_id",
    "count": "count",
    "faultIndicator": "fault_indicator",
    "windowStartMs": "window_start_ms",
    "windowEndMs": "window_end_ms",
    "watermarkAtPurgeMs": "watermark_at_purge_ms",
    "allowedLatenessMs": "allowed_lateness_ms",
    "finalizationLatencyMs": "finalization_latency_ms",
    "latencyReductionMs": "latency_reduction_ms",
}
FAULTY = {
    "meterId": "meter_id",
    "seriesId": "series_id",
    "windowStart": "window_start",
    "windowEnd": "window_end",
    "mode": "mode",
    "singlePhaseUniqueFaultyMeterCount": "single_unique",
    "threePhaseUniqueFaultyMeterCount": "three_unique",
    "totalUniqueFaultyMeterCount": "total_unique",
    "voltageData": "voltage_data",
}
THROUGHPUT = {
    "timestamp": "timestamp",
    "probe": "probe",
    "countInInterval": "count_in_interval",
    "eventsPerSecond": "events_per_second",
    "intervalMs": "interval_ms",
}
PROGRESS = {
    "timestamp": "timestamp",
    "event": "event",
    "linesRead": "lines_read",
    "fileIndex": "file_index",
    "totalFiles": "total_files",
    "currentFile": "current_file",
    "elapsedSec": "elapsed_sec",
    "linesPerSec": "lines_per_sec",
}


def safe_name(text: str) -> str:
    """Text with everything but letters, digits, ``-`` and ``_`` replaced."""
    return re.sub(r"[^0-9A-Za-z_-]", "_", text)


def output_path(folder: str, metric: str, run_id: str, mode: str, time_setting: str) -> str:
    return f"{folder}/{metric}_{safe_name(run_id)}_{mode}_{safe_name(time_setting)}"


def named_output(name: str, run_id: str) -> str:
    """File name with the run id before its extension."""
    if not run_id:
        return name
    stem, dot, extension = name.rpartition(".")
    return f"{stem}_{safe_name(run_id)}.{extension}" if dot else f"{name}_{safe_name(run_id)}"


def csv_view(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table under the headers of its result file; unknown slots become -1."""
    out = []
    for header, name in columns.items():
        column = F.col(name)
        if name == "distinct_slot_count":
            column = F.coalesce(column, F.lit(-1))
        out.append(column.alias(header))
    return table.select(*out)


def write_csv(
    table: DataFrame, path: str, append: bool = False, by: list[str] | None = None
) -> None:
    """Headed CSV; quotes a value holding a comma, quote or line break, null is empty.

    ``by`` names columns that become folders, for short tables: a folder gets one file,
    ordered by its first column.
    """
    rows = table
    if by:
        first = next(c for c in table.columns if c not in by)
        rows = table.repartition(*by).sortWithinPartitions(*by, first)
    (
        rows.write.mode("append" if append else "overwrite")
        .partitionBy(*(by or []))
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_batches(path: str):
    """A ``foreachBatch`` writer; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_csv(batch, f"{path}/batch={batch_id}")

    return write
