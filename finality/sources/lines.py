"""Text sources: historical gzip files, the message bus, meter metadata."""

from __future__ import annotations

import logging
import re
from datetime import date, timedelta
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from finality.functions.scan import blocks_of, running
from finality.functions.timecols import instant_text
from finality.sources import segments

_log = logging.getLogger(__name__)
_DATE_AT_END = re.compile(r"(\d{8})\.gz$")
# a partition numbers its rows in the low 33 bits
_ROW_BITS = 33
# of a bus: 2^20 partitions, and offsets up to 2^43
_BUS_PARTITION_BITS = 20
_BROADCAST_FILES = 100_000


def bus_options(topic: str, servers: str, group_id: str) -> dict[str, str]:
    """Options of the Kafka source: from the earliest offset, one group."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.group.id": group_id,
    }


def read_bus(spark: SparkSession, topic: str, servers: str, group_id: str) -> DataFrame:
    """Stream of message values as text; needs the Kafka connector on the classpath."""
    return _messages(spark.readStream.format("kafka").options(**bus_options(topic, servers, group_id)).load())


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the messages of a topic that is kept as a folder of segments, in the form of ``read_bus``."""
    segments.register(spark)
    return _messages(spark.readStream.format(segments.FORMAT).load(folder))


def _messages(bus: DataFrame) -> DataFrame:
    """Values as text; ``arrival_seq`` follows the offsets, with the partition in the low bits."""
    return bus.select(
        F.col("value").cast("string").alias("value"),
        (F.shiftleft("offset", _BUS_PARTITION_BITS) + F.col("partition")).alias("arrival_seq"),
    ).filter("value <> ''")


def in_date_range(name: str, from_date: str | None, to_date: str | None) -> bool:
    """Whether a file name's date lies in the range; names without a date do."""
    match = _DATE_AT_END.search(name)
    if match is None:
        return True
    return (from_date is None or match[1] >= from_date) and (to_date is None or match[1] <= to_date)


def list_files(
    spark: SparkSession, glob: str, from_date: str | None = None, to_date: str | None = None
) -> list[str]:
    """Paths matching the glob and date range, sorted; fails when there are none."""
    span = f" (dates {from_date or '*'} to {to_date or '*'})" if from_date or to_date else ""
    try:
        # only the listing is read, not the content
        found = spark.read.format("binaryFile").load(glob).select("path").collect()
    except AnalysisException as error:
        raise ValueError(f"No files matched: {glob}{span}") from error
    paths = sorted(
        row.path for row in found if in_date_range(row.path.rsplit("/", 1)[-1], from_date, to_date)
    )
    if not paths:
        raise ValueError(f"No files matched: {glob}{span}")
    return paths


def daily_files(
    spark: SparkSession, template: str, first: date, last: date
) -> tuple[list[str], list[str]]:
    """Paths of the daily files that exist, and the days without one, which are logged as a warning.

    ``template`` holds ``{date}`` for the day as YYYYMMDD.
    """
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    by_name = {}
    try:
        by_name = {p.rsplit("/", 1)[-1]: p for p in list_files(spark, template.format(date="*"))}
    except ValueError:
        pass
    names = {f"{day:%Y%m%d}": template.format(date=f"{day:%Y%m%d}").rsplit("/", 1)[-1] for day in days}
    present = [by_name[name] for name in names.values() if name in by_name]
    absent = [day for day, name in names.items() if name not in by_name]
    for day in absent:
        _log.warning("no file for %s: %s", day, names[day])
    return present, absent


def _plain_path(column: str) -> Column:
    """A path as text; files of the machine itself are written with or without a scheme."""
    return F.regexp_replace(F.col(column), "^file:/+", "/")


def read_lines(spark: SparkSession, paths: list[str], clock: bool = False) -> DataFrame:
    """Non-empty lines with their arrival order.

    Files are taken in the order given: the position of a file is
    ``arrival_epoch``, and ``arrival_seq`` counts up through its lines. A gzip
    file cannot be split, so the row number of its partition follows the lines.
    With ``clock``, ``read_ms`` is the time at which the task read the line; it
    is another one each time the table is read, so store it first.
    """
    if not all(path.endswith(".gz") for path in paths):
        raise ValueError("historical files must be gzip files")
    order = spark.createDataFrame(
        [(path, rank) for rank, path in enumerate(paths)], "given string, arrival_epoch bigint"
    ).select(_plain_path("given").alias("path"), "arrival_epoch")
    lines = (
        spark.read.text(paths)
        .select(
            "value",
            F.col("_metadata.file_name").alias("file_name"),
            _plain_path("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("row_id"),
            *([_now().alias("read_ms")] if clock else []),
        )
        .filter("value <> ''")
    )
    row = F.col("row_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return lines.join(
        F.broadcast(order) if len(paths) <= _BROADCAST_FILES else order, "path"
    ).select(
        "value",
        "file_name",
        "arrival_epoch",
        (F.shiftleft("arrival_epoch", _ROW_BITS) + row).alias("arrival_seq"),
        F.coalesce(
            F.nullif(F.regexp_extract("file_name", r"(\d{8})\.gz$", 1), F.lit("")), F.col("file_name")
        ).alias("day"),
        *(["read_ms"] if clock else []),
    )


def _now() -> Column:
    """The clock of the machine at each row, where ``current_timestamp`` is the start of the query."""
    return F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint")


def stream_lines(spark: SparkSession, folder: str, pattern: str = "*.gz") -> DataFrame:
    """Lines of gzip files as they appear in a folder, one file per micro-batch."""
    return (
        spark.readStream.format("text")
        .schema("value string")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", 1)
        .load(folder)
        .filter("value <> ''")
    )


def number_lines(batch: DataFrame, batch_id: int) -> DataFrame:
    """Lines of one micro-batch with their arrival order.

    An ``arrival_seq`` that the source gives, such as the order of a bus, is kept.
    Otherwise lines are numbered partition by partition: the rows of each are
    counted first, one number per partition, and added up.
    """
    epoch = F.lit(batch_id).cast("bigint").alias("arrival_epoch")
    if "arrival_seq" in batch.columns:
        return batch.select("value", epoch, "arrival_seq")
    numbered = batch.select("value", F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", _ROW_BITS)
    counts = sorted(tuple(r) for r in numbered.groupBy(part.alias("part")).count().collect())
    ends = list(accumulate(n for _, n in counts))
    before = batch.sparkSession.createDataFrame(
        [(k, end - n) for (k, n), end in zip(counts, ends)], "part bigint, before bigint"
    )
    row = F.col("id").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        numbered.withColumn("part", part)
        .join(F.broadcast(before), "part")  # a row per partition
        .select("value", epoch, (F.col("before") + row + (batch_id << _ROW_BITS)).alias("arrival_seq"))
    )


def first_records(rows: DataFrame, count: int | None) -> DataFrame:
    """The first records in arrival order, for a quick trial; all without a count."""
    if count is None:
        return rows
    ranked = running(
        rows,
        blocks_of("arrival_seq", 16),
        ["arrival_seq"],
        {"_rank": ("sum", F.lit(1))},
        inclusive=True,
        block=["_blk"],
    )
    return ranked.filter(F.col("_rank") <= count).select(*rows.columns)


def ingestion_progress(lines: DataFrame, every_ms: int = 300_000) -> DataFrame:
    """Start and finish of every file, and progress inside it each ``every_ms``, in file order.

    ``lines`` are stored lines of ``read_lines`` with ``clock``, or what was parsed from them. ``lines_read``
    counts the files before and this one so far. Tasks read files side by side, so the clock need not ascend
    from file to file; inside a file it does. Lines are counted by file and second first, so what is ordered is as short
    as the time that a file took. A file without lines has no rows.
    """
    ticks = lines.groupBy("arrival_epoch", "file_name", F.floor(F.col("read_ms") / 1000).alias("tick")).agg(
        F.count("*").alias("n"), F.min("read_ms").alias("from_ms"), F.max("read_ms").alias("at_ms")
    )
    in_file = Window.partitionBy("arrival_epoch").orderBy("tick")
    passed = F.floor((F.col("at_ms") - F.min("from_ms").over(Window.partitionBy("arrival_epoch"))) / every_ms)
    ticks = ticks.withColumns({"so_far": F.sum("n").over(in_file), "passed": passed})
    due = ticks.withColumn("before", F.coalesce(F.lag("passed").over(in_file), F.lit(0))).filter("passed > before")
    files = ticks.groupBy("arrival_epoch", "file_name").agg(
        F.sum("n").alias("lines"), F.min("from_ms").alias("from_ms"), F.max("at_ms").alias("at_ms")
    )
    # one short row per file
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("arrival_epoch")
    files = files.select(
        "arrival_epoch",
        F.col("file_name").alias("current_file"),
        (F.sum("lines").over(upto) - F.col("lines")).alias("earlier"),
        "lines",
        F.row_number().over(upto).alias("file_index"),
        F.count("*").over(every).cast("int").alias("total_files"),
        F.min("from_ms").over(every).alias("run_ms"),
        F.col("from_ms").alias("started_ms"),
        F.col("at_ms").alias("ended_ms"),
    )
    inside = due.groupBy("arrival_epoch").agg(
        # at most the time of a file divided by ``every_ms``
        F.array_sort(F.collect_list(F.struct("so_far", "at_ms"))).alias("due")
    )
    none = F.array().cast("array<struct<so_far:bigint,at_ms:bigint>>")

    def event(name: str, so_far: Column, at: Column) -> Column:
        return F.struct(F.lit(name).alias("event"), so_far.alias("so_far"), at.alias("at_ms"))

    events = F.concat(
        F.array(event("START", F.lit(0).cast("bigint"), F.col("started_ms"))),
        F.transform(F.coalesce("due", none), lambda d: event("PROGRESS", d["so_far"], d["at_ms"])),
        F.array(event("FINISH", F.col("lines"), F.col("ended_ms"))),
    )
    elapsed = F.col("at_ms") - F.col("run_ms")
    read = F.col("earlier") + F.col("so_far")
    return (
        files.join(inside, "arrival_epoch", "left")
        .select("*", F.posexplode(events).alias("event_no", "e"))
        .select("*", "e.*")
        .orderBy("file_index", "event_no")
        .select(
            instant_text(F.col("at_ms")).alias("timestamp"),
            "event",
            read.alias("lines_read"),
            "file_index",
            "total_files",
            "current_file",
            F.floor(elapsed / 1000).alias("elapsed_sec"),
            F.coalesce(F.round(F.try_divide(read * 1000.0, elapsed), 2), F.lit(0.0)).alias("lines_per_sec"),
        )
    )


def profile_progress(parsed: DataFrame) -> DataFrame:
    """Records and parse errors per file and in total up to it."""
    bad = F.col("parse_error").isNotNull()
    files = parsed.groupBy("arrival_epoch", "file_name").agg(
        F.count_if(~bad).alias("records"), F.count_if(bad).alias("errors")
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("arrival_epoch")
    return files.select(
        "file_name",
        "records",
        "errors",
        F.sum("records").over(upto).alias("total_records"),
        F.sum("errors").over(upto).alias("total_errors"),
    )


def read_meter_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct meter ids: the first field of every line that is not a header."""
    meter = F.trim(F.split(F.trim("value"), ",", 2)[0])
    return (
        spark.read.text(path)
        .select(meter.alias("meter_id"))
        .filter((F.col("meter_id") != "") & (F.lower("meter_id") != "meterid"))
        .distinct()
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Meter metadata lines."""
    return spark.read.text(path)
