"""The window job, the classification job and the lateness profile, from files to result files."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from finality.config import SINGLE, THREE, JobArgs, WindowSpec
from finality.functions.timecols import instant_text
from finality.operators.arrival import NO_MORE_INPUT
from finality.operators.meters import classify_meters, is_voltage, lookup_of, route
from finality.operators.replay import finalize
from finality.plans import lateness_state, reports
from finality.plans.lateness import MODES
from finality.plans.throughput import chained_samples, probe_counts
from finality.sinks import writers
from finality.sources.lines import (
    daily_files,
    first_records,
    ingestion_progress,
    list_files,
    read_bus,
    read_lines,
    read_meter_ids,
    read_segments,
)
from finality.sources.parse import parse_permissive, parse_strict, quarantine, readings_of
from finality.streaming.job import READINGS, start_parsing


def window_job(
    spark: SparkSession,
    args: JobArgs,
    single_ids: str,
    three_ids: str,
    spec: WindowSpec = WindowSpec(),
    max_records: int | None = None,
) -> None:
    """Run one policy over historical files or a bus and write all of its result files.

    The parsed readings are written once, as Parquet by file or micro-batch, and
    every result is computed from there. The run summary gets its row even when
    the run fails.

    Of a bus, everything published so far is read. A job that is run again with the
    same arguments goes on at the offsets of its checkpoint, adds to the readings and
    replaces the results by those over all of them.
    """
    out = args.out_dir
    counts = {"total_input_records": 0, "dropped_records": 0}

    def path(metric: str) -> str:
        return writers.output_path(out, metric, args.run_id, args.mode, args.time_setting)

    try:
        store = path("readings")
        if args.source == "gzip":
            counts["total_input_records"] = _store_files(spark, args, spec, max_records, store)
            readings = spark.read.parquet(store)
            progress = writers.csv_view(ingestion_progress(readings), writers.PROGRESS)
            writers.write_csv(progress, f"{out}/ingestion_progress")
        else:
            bus = (
                read_segments(spark, args.topic_folder)
                if args.topic_folder
                else read_bus(spark, args.topic, args.servers, args.group_id)
            )
            start_parsing(bus, store, path("offsets"), spec).awaitTermination()
            readings = first_records(spark.read.schema(READINGS).parquet(f"{store}/batch=*"), max_records)
            counts["total_input_records"] = readings.count()
        lookup = lookup_of(read_meter_ids(spark, single_ids), read_meter_ids(spark, three_ids))

        def to_phases(rows: DataFrame) -> DataFrame:
            return route(rows, lookup)

        emitted, routed = path("emissions"), Observation()
        finalize(
            readings, args.policy, spec, route=to_phases, keep=is_voltage(), counters=routed
        ).write.mode("overwrite").parquet(emitted)
        counts["dropped_records"] = routed.get["dropped"]
        emissions = spark.read.parquet(emitted)
        _write_reports(emissions, args, spec, path)
        _write_throughput(readings, to_phases(readings), emissions, args, path)
    finally:
        writers.write_csv(_run_summary(spark, args, counts), f"{out}/run_summary", append=True)


def _store_files(
    spark: SparkSession, args: JobArgs, spec: WindowSpec, max_records: int | None, store: str
) -> int:
    """Parse historical files into the store; gives the number of readings."""
    files = list_files(spark, args.path_glob, args.from_date, args.to_date)
    lines = first_records(read_lines(spark, files, clock=True), max_records)
    parsed = Observation()
    (
        readings_of(parse_strict(lines, spec.zone), fail=True)
        .observe(parsed, F.count("*").alias("records"))
        .write.mode("overwrite")
        .partitionBy("arrival_epoch")
        .parquet(store)
    )
    return parsed.get["records"]


def _write_reports(emissions: DataFrame, args: JobArgs, spec: WindowSpec, path) -> None:
    counts = writers.csv_view(reports.output_counts(emissions), writers.OUTPUT_COUNTS)
    writers.write_csv(counts, path("output_counts"))
    faulty = writers.csv_view(reports.faulty_windows(emissions, spec), writers.FAULTY)
    if args.policy.completes_early:
        latency = writers.csv_view(reports.latency_rows(emissions), writers.FINALIZATION)
        writers.write_csv(latency, path("finalization_latency_metrics"))
        writers.write_csv(faulty, path("faulty_window_counts"))
    else:
        writers.write_csv(faulty, path("native_faulty_window_counts"))


def _write_throughput(readings, routed, emissions, args: JobArgs, path) -> None:
    """Rates at the four points of the job, on the clock of insertion.

    Every line is a reading here, so both points before the filter count the
    same records.
    """
    one = F.lit(1).alias("n")
    clock = readings.select("arrival_seq", F.col("insert_ms").alias("ms"), one)
    # many windows can fire on one arrival: fold them before the join
    fired = (
        emissions.filter(F.col("fire_seq") < NO_MORE_INPUT)
        .groupBy(F.col("fire_seq").alias("arrival_seq"))
        .agg(F.count("*").alias("n"))
        .join(clock.drop("n"), "arrival_seq")
    )
    filtered = routed.select(F.col("insert_ms").alias("ms"), one)
    for metric, points in (
        (
            "standard_throughput_metrics",
            {"source_after_ingestion": clock, "post_filter": filtered},
        ),
        ("throughput_metrics", {"source_after_parse": clock, "post_window_aggregation": fired}),
    ):
        counts = None
        for stage, rows in points.items():
            part = probe_counts(rows, f"{args.mode}_{stage}", "ms", "n")
            counts = part if counts is None else counts.unionByName(part)
        samples = chained_samples(counts).withColumn("timestamp", instant_text(F.col("ts_ms")))
        writers.write_csv(writers.csv_view(samples, writers.THROUGHPUT), path(metric))


def _run_summary(spark: SparkSession, args: JobArgs, counts: dict) -> DataFrame:
    total, dropped = counts["total_input_records"], counts["dropped_records"]
    ratio = f"{dropped / total if total else 0.0:.6f}"
    return spark.createDataFrame(
        [(args.mode, args.run_id, args.time_setting, total, dropped, ratio)],
        "mode string, runId string, timeSetting string, totalInputRecords bigint, "
        "droppedRecords bigint, droppedRecordRatio string",
    )


def lateness_job(
    spark: SparkSession,
    template: str,
    first: date,
    last: date,
    state: str,
    out_dir: str,
    spec: WindowSpec = WindowSpec(),
    modes: tuple[str, ...] = MODES,
) -> list[str]:
    """Profile the daily files from ``first`` to ``last``, and write the results over all days so far.

    ``template`` is a path with ``{date}`` for the day as YYYYMMDD. Days that ``state`` holds
    already are not read again, so the next day costs its own file. Days without a file are
    logged, and given back. A file that appears after a later day was profiled is an error.
    Results are written even when a day fails; they are those of the days before it.
    """
    present, absent = daily_files(spark, template, first, last)
    held = {row.batch for row in lateness_state.batches(spark, state).select("batch").collect()}
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    days = [day for day in map("{:%Y%m%d}".format, days) if day not in absent]
    try:
        for day, path in zip(days, present):
            if day in held:
                continue
            parsed = parse_permissive(read_lines(spark, [path]), spec.zone)
            store, seen = f"{state}/lines/day={day}", Observation()
            parsed.observe(seen, F.count_if(F.col("parse_error").isNotNull()).alias("errors")).write.mode(
                "overwrite"
            ).parquet(store)
            lines = spark.read.parquet(store).withColumn("day", F.lit(day))
            lateness_state.add_batch(
                state, day, readings_of(lines), spec, modes, errors=seen.get["errors"]
            )
            writers.write_csv(quarantine(lines), f"{out_dir}/quarantine/day={day}")
    finally:
        if lateness_state.last_batch(spark, state) is not None:
            _write_profile(spark, state, out_dir, spec)
    return absent


def _write_profile(spark: SparkSession, state: str, out: str, spec: WindowSpec) -> None:
    profile = lateness_state
    days = profile.day_summary(spark, state)
    dated = {"date": "day", "total": "total_records", "late": "late_records"}
    others = [c for c in days.columns if c not in ("mode", *dated.values())]
    by_mode = {
        "per_day_summary": days.select(
            "mode", *[F.col(c).alias(header) for header, c in dated.items()], *others
        ),
        "histogram_overall": profile.histogram(spark, state, ["mode"]),
        "cdf_overall": profile.cdf(spark, state, ["mode"]),
        "hourly_data": profile.hourly(spark, state, spec),
    }
    by_day = {
        "histogram": profile.histogram(spark, state, ["mode", "day"]),
        "cdf": profile.cdf(spark, state, ["mode", "day"]),
    }
    for name, table in by_mode.items():
        writers.write_csv(table, f"{out}/{name}", by=["mode"])
    for name, table in by_day.items():
        writers.write_csv(table, f"{out}/{name}", by=["mode", "day"])
    writers.write_csv(profile.overall_summary(spark, state), f"{out}/compare_summary")
    writers.write_csv(profile.progress(spark, state), f"{out}/progress")


def classification_job(lines: DataFrame, out_dir: str) -> DataFrame:
    """Write the meter ids of both phase groups and return the class totals."""
    classified = classify_meters(lines)
    for group, name in ((SINGLE, "single_phase_meters"), (THREE, "three_phase_meters")):
        rows = classified.filter(F.col("class") == group).select(
            "meter_id", "type_description", "phases"
        )
        rows.write.mode("append").option("header", False).csv(f"{out_dir}/{name}")
    return classified.groupBy("class").agg(F.count("*").alias("meters"))
