"""From a stream of raw lines to emissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from finality.config import SERIES_L1, THREE, Policy, WindowSpec
from finality.operators.meters import is_voltage
from finality.plans.reports import counted_faults, faulty_only, first_faults
from finality.sinks.writers import write_batches
from finality.sources.lines import number_lines
from finality.sources.parse import parse_strict, readings_of
from finality.streaming.processor import LATE, fired_windows

#: Name of a probe's count in the progress of a query.
PROBED = "probed_rows"

# Columns of a stored reading.
READINGS = (
    "arrival_epoch bigint, arrival_seq bigint, series_id string, location_id string, "
    "meter_id string, event_ms bigint, value double, value_status string, insert_ms bigint, "
    "extract_ms bigint"
)


def routed(readings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Readings with ``phase_group``, null where the phase filter drops them.

    All readings stay in the stream, because all of them move the watermark.
    """
    kept = is_voltage() & ((F.col("phase_group") == THREE) | (F.col("series_id") == SERIES_L1))
    return readings.join(lookup, "meter_id", "left").withColumn(
        "phase_group", F.when(kept, F.col("phase_group"))
    )


def start_parsing(
    lines: DataFrame, store: str, checkpoint: str, spec: WindowSpec = WindowSpec()
) -> StreamingQuery:
    """Parse lines into a Parquet store, one folder per micro-batch.

    The store fixes the arrival order; a repeated batch replaces its folder, and
    a bad line ends the stream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # numbering goes over the lines twice; the source is read, and its rows are counted in the progress, once
        batch.persist()
        try:
            numbered = number_lines(batch, batch_id)
            readings = readings_of(parse_strict(numbered, spec.zone), fail=True)
            readings.write.mode("overwrite").parquet(f"{store}/batch={batch_id:012d}")
        finally:
            batch.unpersist()

    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def stored_readings(spark: SparkSession, store: str) -> DataFrame:
    """Stream of the parsed readings, one stored batch at a time."""
    return (
        spark.readStream.schema(READINGS)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{store}/batch=*")
    )


def probed(stream: DataFrame, probe: str, counted: Column | None = None) -> DataFrame:
    """Counts the rows of each micro-batch that pass here, or those where ``counted`` holds.

    The count comes out in the progress of the query, where ``BatchRates`` reads it.
    """
    return stream.observe(probe, F.count_if(F.lit(True) if counted is None else counted).alias(PROBED))


def fired_from_store(
    spark: SparkSession,
    store: str,
    lookup: DataFrame,
    policy: Policy,
    spec: WindowSpec = WindowSpec(),
    probes: str | None = None,
) -> DataFrame:
    """Firings over the parsed readings.

    ``probes`` is the label of a run; with it, four points inside the query are counted as
    ``<label>_<point>``: rows read, readings with a time, routed readings and emissions.
    """
    rows = stored_readings(spark, store)
    if probes is None:
        return fired_windows(routed(rows, lookup), policy, spec)
    rows = probed(rows, f"{probes}_source_after_ingestion")
    rows = probed(rows, f"{probes}_source_after_parse", F.col("event_ms").isNotNull())
    kept = probed(routed(rows, lookup), f"{probes}_post_filter", F.col("phase_group").isNotNull())
    return probed(fired_windows(kept, policy, spec), f"{probes}_post_window_aggregation", F.col("why") != LATE)


_SEEN = "phase_group string, meter_id string, fire_seq bigint, fire_phase int, window_end_ms bigint, emit_no int"


def faulty_batches(
    spark: SparkSession, folder: str, spec: WindowSpec = WindowSpec()
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on emissions: faulty windows with the unique faulty meters so far.

    Meters first seen in a batch are written to ``<folder>/seen``, its rows to ``<folder>/faulty``, both in a
    folder of the batch; a repeated batch reads the batches before it only and replaces its own
    folders. Firings by the watermark belong to the batch before and come first.
    """
    seen = f"{folder}/seen"
    spark.createDataFrame([], _SEEN).write.mode("overwrite").parquet(f"{seen}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        placed = {"fire_seq": F.coalesce("fire_seq", F.lit(-1).cast("bigint")), "emit_no": F.col("emit_no").cast("int")}
        faulty = faulty_only(batch).withColumns(placed).persist()
        try:
            earlier = own.read.schema(f"{_SEEN}, batch int").parquet(seen).filter(F.col("batch") < batch_id)
            new = first_faults(faulty).join(earlier, ["phase_group", "meter_id"], "left_anti")
            here = f"{seen}/batch={batch_id:012d}"
            new.select(*own.read.schema(_SEEN).parquet(f"{seen}/batch=-1").columns).write.mode("overwrite").parquet(here)
            three = F.col("phase_group") == THREE
            before = earlier.agg(F.count_if(~three), F.count_if(three)).first()
            firsts = own.read.schema(_SEEN).parquet(here)
            counted = counted_faults(faulty, firsts, spec, tuple(before))
            counted.write.mode("overwrite").parquet(f"{folder}/faulty/batch={batch_id:012d}")
        finally:
            faulty.unpersist()

    return write


def start_csv(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as headed CSV, one folder per micro-batch."""
    return (
        table.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batches(path))
        .trigger(availableNow=True)
        .start()
    )


class BatchRates(StreamingQueryListener):
    """One short row per micro-batch with input, of all named queries and of all points that ``probed`` counts;
    a query itself only remembers its last batches.

    Register it with ``spark.streams.addListener`` before the queries start. Progress comes in after its batch has ended.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, int]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs["triggerExecution"] if p.durationMs else 0
        if p.name and p.numInputRows:
            self.rows.append((p.timestamp, p.name, p.numInputRows, took))
        for probe, row in p.observedMetrics.items():
            if row and PROBED in row.asDict() and row[PROBED]:
                self.rows.append((p.timestamp, probe, row[PROBED], took))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def samples(self) -> DataFrame:
        """Throughput samples so far; the probe is a query's name or that of a point inside it."""
        return _samples(list(self.rows))


def rate_samples(query: StreamingQuery, probe: str) -> DataFrame:
    """Throughput samples of the batches that a query remembers; ``BatchRates`` keeps those of long runs."""
    return _samples(
        [
            (p.timestamp, probe, p.numInputRows, p.durationMs["triggerExecution"])
            for p in query.recentProgress
            if p.numInputRows
        ]
    )


def _samples(rows: list[tuple[str, str, int, int]]) -> DataFrame:
    table = SparkSession.active().createDataFrame(
        rows, "stamp string, probe string, count_in_interval bigint, interval_ms bigint"
    )
    return table.select(
        F.unix_millis(F.to_timestamp("stamp")).alias("ts_ms"),
        "probe",
        "count_in_interval",
        F.try_divide(F.col("count_in_interval") * 1000.0, F.col("interval_ms")).alias(
            "events_per_second"
        ),
        "interval_ms",
    )

