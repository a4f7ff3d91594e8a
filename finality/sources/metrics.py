"""Metric CSV files and garbage-collection logs."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from finality.config import MODES

# Column types of the metric files.
OUTPUT_COUNTS = (
    "mode string, meterId string, seriesId string, windowStartMs bigint, windowEndMs bigint, "
    "outputCount int, earlyPurged boolean, finalCount int, distinctSlotCount int"
)
FINALIZATION = (
    "mode string, resultType string, finalizationReason string, meterId string, seriesId string, "
    "count int, faultIndicator boolean, windowStartMs bigint, windowEndMs bigint, "
    "watermarkAtPurgeMs bigint, allowedLatenessMs bigint, finalizationLatencyMs bigint, "
    "latencyReductionMs bigint"
)
FAULTY = (
    "meterId string, seriesId string, windowStart string, windowEnd string, mode string, "
    "singlePhaseUniqueFaultyMeterCount int, threePhaseUniqueFaultyMeterCount int, "
    "totalUniqueFaultyMeterCount int, voltageData string"
)
THROUGHPUT = (
    "timestamp timestamp, probe string, countInInterval bigint, eventsPerSecond double, "
    "intervalMs bigint"
)
RUN_SUMMARY = (
    "mode string, runId string, timeSetting string, totalInputRecords bigint, "
    "droppedRecords bigint, droppedRecordRatio double"
)
SYSTEM = (
    "timestamp timestamp, mode string, run_id string, target string, pid bigint, command string, "
    "cpu_percent double, rss_mib double, virtual_memory_mib double, memory_percent double, "
    "threads int"
)


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def read_metrics(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    required: list[str],
    snake: bool = False,
) -> DataFrame:
    """A headed CSV file with the columns of ``schema`` that it holds.

    Values that do not fit their type become null, rows with a null in a
    required column are left out, and a missing required column is an error.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"{path} is missing required columns: {', '.join(missing)}")
    columns = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    table = raw.select(
        *[F.col(name).try_cast(kind).alias(name) for name, kind in columns if name in raw.columns]
    ).dropna(subset=required)
    return table.select(*[F.col(c).alias(snake_case(c)) for c in table.columns]) if snake else table


def read_all(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame | None:
    """Union of the files found below a folder, whatever columns each holds.

    Files are grouped by header, so each group is read in one pass; columns
    absent from a file are null. Files with a header only add no rows. Returns
    null when no file holds any of the columns.
    """
    return _union(_found(spark, folder).filter(F.col("file_name").rlike(_as_regex(pattern))), schema, False)


def read_results(spark: SparkSession, folder: str, metric: str, schema: str) -> DataFrame | None:
    """All results of a metric below a folder, with the run that each row is of.

    A result is a file ``<metric>_<run>_<mode>_<time>.csv`` or a folder of that name with parts in it,
    as ``window_job`` writes them; folders such as ``batch=3`` in between are passed over.
    ``run_id, method_key, time_setting`` come from that name and are ``unknown`` where it has
    another form; ``experiment`` joins method and time. ``row_no`` orders rows as they stand in
    their files. Columns are named in snake case; null when there is no such result.
    """
    own = F.col("result").rlike(f"^{re.escape(metric)}(_|$)")
    rows = _union(_found(spark, folder).filter(own), schema, True)
    if rows is None:
        return None
    # the run may hold underscores: it ends where a mode follows
    parts = f"^{re.escape(metric)}_(.+?)_({'|'.join(MODES)})_(.+)$"
    named = F.col("result").rlike(parts)

    def part(group: int) -> Column:
        return F.when(named, F.regexp_extract("result", parts, group)).otherwise("unknown")

    names = {c.strip().rsplit(" ", 1)[0] for c in schema.split(",")}
    return rows.select(
        *[F.col(c).alias(snake_case(c)) for c in rows.columns if c in names and snake_case(c) != "run_id"],
        part(1).alias("run_id"),
        part(2).alias("method_key"),
        part(3).alias("time_setting"),
        F.concat_ws("_", part(2), part(3)).alias("experiment"),
        "row_no",
    )


def _as_regex(pattern: str) -> str:
    """A file-name pattern with ``*`` and ``?`` as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _result_of(path: Column) -> Column:
    """Name of the result a file belongs to: its own, or for a part that of the folder."""
    plain = F.regexp_replace(path, "/[^/]*=[^/]*(?=/)", "")
    name = F.substring_index(plain, "/", -1)
    parent = F.substring_index(F.substring_index(plain, "/", -2), "/", 1)
    return F.when(name.startswith("part-"), parent).otherwise(F.regexp_replace(name, "[.]csv$", ""))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files below a folder with something in them; only the listing is read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .filter("length > 0")
    )
    return listed.select(
        "path", F.substring_index("path", "/", -1).alias("file_name"), _result_of(F.col("path")).alias("result")
    )


def _path() -> Column:
    """Path of the file that a row is read from, without the encoding of a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _union(found: DataFrame, schema: str, by_folder: bool) -> DataFrame | None:
    """Rows of the files, read once per distinct header.

    The headers are found in tasks, in one pass over the files that keeps a line of each. To the driver come the
    distinct headers and, for each, what to read; ``by_folder``, a folder of parts with one header is read as a whole.
    """
    spark = found.sparkSession
    paths = [row.path for row in found.select("path").collect()]
    if not paths:
        return None
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    first = (
        spark.read.text(paths)
        .select(_path().alias("path"), place.alias("place"), "value")
        .groupBy("path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    name = F.substring_index("path", "/", -1)
    folder = F.left("path", F.length("path") - F.length(name) - 1)
    alone = Window.partitionBy("folder")
    units = (
        first.withColumns({"folder": folder, "is_part": name.startswith("part-")})
        .withColumn("whole", F.lit(by_folder) & (F.size(F.collect_set("header").over(alone)) == 1) & F.min("is_part").over(alone))
        .groupBy("header")
        .agg(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("folder")).otherwise(F.col("path")))).alias("units"))
        .orderBy("header")
    )
    columns = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    union = None
    for row in units.collect():
        header = next(csv.reader([row.header]))
        present = [(name, kind) for name, kind in columns if header.count(name) == 1]
        if not present:
            continue
        # names of the file may repeat, or differ from others in case only
        texts = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
        part = (
            spark.read.schema(texts)
            .option("header", True)
            .option("enforceSchema", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("pathGlobFilter", "*.csv")
            .csv(row.units)
            .select(
                *[F.col(f"c{header.index(name)}").try_cast(kind).alias(name) for name, kind in present],
                F.col("_metadata.file_name").alias("file_name"),
                _result_of(_path()).alias("result"),
                F.struct(
                    _path().alias("path"),
                    F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("id"),
                ).alias("row_no"),
            )
        )
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union


def mode_from_name(file_name: Column) -> Column:
    """Mode between underscores in a file name, ``unknown`` without one."""
    found = F.regexp_extract(file_name, f"_({'|'.join(MODES)})_", 1)
    return F.when(found == "", "unknown").otherwise(found)


def with_run(samples: DataFrame) -> DataFrame:
    """Add run id, method, time setting and experiment from the file name.

    A file with another name takes the method from its first probe, its run and
    time setting are unknown. Needs ``file_name, probe, ts_ms``.
    """
    kind, ending = "standard_throughput_metrics_", ".csv"
    name = F.col("file_name")
    rest = F.split(F.expr(f"substring(file_name, {len(kind) + 1}, length(file_name) - {len(kind + ending)})"), "_", 3)
    named = name.startswith(kind) & name.endswith(ending) & (F.size(rest) == 3) & F.get(rest, F.lit(1)).isin(*MODES)

    def part(group: int) -> Column:
        return F.get(rest, F.lit(group - 1))

    first = samples.groupBy("file_name").agg(F.min_by("probe", "ts_ms").alias("_probe"))
    method = F.when(named, part(2)).otherwise(
        F.substring_index(F.coalesce("_probe", F.lit("unknown")), "_", 1)
    )
    time_setting = F.when(named, part(3)).otherwise("unknown")
    return (
        samples.join(first, "file_name")
        .withColumns(
            {
                "run_id": F.when(named, part(1)).otherwise("unknown"),
                "method_key": method,
                "time_setting": time_setting,
                "experiment": F.concat_ws("_", method, time_setting),
            }
        )
        .drop("_probe")
    )


# Kinds of pause that are read, and those whose heap sizes are read.
PAUSES = ("Young", "Full", "Remark", "Cleanup")
SIZED_PAUSES = ("Young", "Full")


def gc_events(
    lines: DataFrame, kinds: tuple[str, ...] = PAUSES, sizes_needed: bool = False
) -> DataFrame:
    """Pauses in log lines: time, type, sizes in MB and duration.

    The parts of a line are found one by one: the time in the first brackets
    with a date, the word after ``Pause``, the sizes around the first arrow and the number
    before the last ``ms``. A line without time, kind or duration is no pause.
    """
    stamp = F.regexp_extract("value", r"\[(\d+-\d\d-\d\dT[^\]]+)\]", 1)
    pause = F.substring_index("value", "Pause ", -1)
    kind = F.regexp_extract(pause, r"^\W*([A-Za-z]+)", 1)
    duration = F.regexp_extract(pause, r"([0-9]+[.][0-9]+)ms", 1)
    arrow = F.contains(pause, F.lit("->"))
    left = F.regexp_extract(F.substring_index(pause, "->", 1), r"(\d+)[A-Z]?$", 1)
    right = F.substring_index(pause, "->", -1)
    after, capacity = F.regexp_extract(right, r"^(\d+)", 1), F.regexp_extract(right, r"\((\d+)", 1)

    def size(text: Column) -> Column:
        return F.when(arrow, text.try_cast("double"))

    # the offset is part of the text, so the session zone plays no role
    instant = F.try_to_timestamp(F.regexp_replace(stamp, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    others = [c for c in lines.columns if c != "value"]
    found = lines.filter(F.contains("value", F.lit("Pause "))).select(
        *others,
        F.unix_millis(instant).alias("ts_ms"),
        kind.alias("type"),
        size(left).alias("before_mb"),
        size(after).alias("after_mb"),
        size(capacity).alias("capacity_mb"),
        duration.try_cast("double").alias("duration_ms"),
    )
    pauses = found.filter(
        F.col("ts_ms").isNotNull() & F.col("type").isin(*kinds) & F.col("duration_ms").isNotNull()
    )
    if sizes_needed:
        pauses = pauses.filter("before_mb IS NOT NULL AND after_mb IS NOT NULL AND capacity_mb IS NOT NULL")
    return pauses.withColumn("recovered_mb", F.col("before_mb") - F.col("after_mb"))
