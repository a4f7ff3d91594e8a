"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from finality.config import BASELINE, DELAYED, FAST, MODES, PROPOSED, Policy
from finality.functions import labels, windowing
from finality.functions.points import default_content
from finality.functions.timecols import local_text
from finality.operators import meters, plain
from finality.operators.arrival import replay_watermark, watermark_passes
from finality.operators.replay import completeness_windows, finalize, late_records, place, window_counts
from finality.plans import latency, lateness, lateness_state, reports, resources, throughput
from finality.plans.standins import DAY_MS, SPARSE, events, readings
from finality.session import new_folder, ship
from finality.sources.lines import first_records, profile_progress
from finality.sources.metrics import gc_events
from finality.sources.parse import parse_permissive, parse_strict

Query = Callable[[SparkSession, str], DataFrame]

POLICIES = {
    "sw": Policy(FAST),
    "dww": Policy(DELAYED, delay_ms=DAY_MS),
    "alw": Policy(BASELINE, lateness_ms=DAY_MS),
    "cbw": Policy(PROPOSED, lateness_ms=DAY_MS),
}
HOUR_MS = 3_600_000
TOLERANCE_MS = 600_000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, so that engines agree.

    The small shift keeps exact halves from being rounded up by one engine only.
    """
    return df.select(
        *[
            F.round(F.col(c) + 1e-9, digits).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def routed_only():
    return F.col("phase_group").isNotNull()


def emissions(spark: SparkSession, folder: str, name: str, content: list[str] | None = None) -> DataFrame:
    """Emissions of a policy; ``content`` names what is needed of a window's content, all of it by default."""
    makes = default_content(SPARSE)
    makes = makes if content is None else {n: makes[n] for n in content}
    return finalize(readings(spark, folder), POLICIES[name], SPARSE, makes, keep=routed_only())


def placed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return place(readings(spark, folder), POLICIES[name], SPARSE, keep=routed_only())


def counts(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """Output counts of several policies with ``experiment`` and a row number."""
    parts = [
        reports.output_counts(emissions(spark, folder, n, ["distinct_slot_count"])).withColumn(
            "experiment", F.lit(POLICIES[n].mode)
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def with_faults_in_file(table: DataFrame) -> DataFrame:
    """Output counts as a damaged file: copied rows and rows without bounds."""
    meter = F.col("meter_id").cast("bigint")
    numbered = table.withColumn("row_no", F.lit(0))
    copies = table.filter(meter % 7 == 0).withColumns(
        {"row_no": F.lit(1), "output_count": F.lit(99), "final_count": F.lit(99)}
    )
    unbound = table.filter(meter % 11 == 0).withColumns(
        {
            "row_no": F.lit(2),
            "window_start_ms": F.lit(0).cast("bigint"),
            "window_end_ms": F.lit(0).cast("bigint"),
        }
    )
    return numbered.unionByName(copies).unionByName(unbound)


def faulty(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    parts = [
        reports.faulty_only(emissions(spark, folder, n)).withColumn(
            "experiment", F.lit(POLICIES[n].mode)
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def finals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.latency_rows(emissions(spark, folder, "cbw")).withColumn(
        "experiment", F.lit(PROPOSED)
    )


def method_key():
    """Stand-in method of an event: the user's number modulo four."""
    return F.element_at(
        F.array(*[F.lit(m) for m in MODES]), (F.col("user_id") % 4 + 1).cast("int")
    )


def samples(spark: SparkSession, folder: str, stages: tuple[str, str]) -> DataFrame:
    """Stand-in throughput samples: arrivals per method, stage and hour."""
    arrival_s = F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint")
    stage = F.when(F.col("event_id") % 2 == 0, stages[0]).otherwise(stages[1])
    return (
        events(spark, folder)
        .select(
            method_key().alias("method_key"),
            stage.alias("stage"),
            arrival_s.alias("s"),
        )
        .groupBy("method_key", "stage", F.expr("s div 3600").alias("hour"))
        .agg(F.count("*").alias("count_in_interval"), (F.max("s") * 1000).alias("ts_ms"))
        .select(
            "method_key",
            F.lit("465m").alias("time_setting"),
            F.concat("method_key", F.lit("_465m")).alias("experiment"),
            F.concat("method_key", F.lit("_"), "stage").alias("probe"),
            "ts_ms",
            "count_in_interval",
            (F.col("count_in_interval") / 3600.0).alias("events_per_second"),
            F.lit(HOUR_MS).cast("bigint").alias("interval_ms"),
        )
    )


PARSED = ("source_after_parse", "post_window_aggregation")
INGESTED = ("source_after_ingestion", "post_filter")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in resource samples: one per method and hour."""
    arrival_s = F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        events(spark, folder)
        .select(method_key().alias("experiment"), arrival_s.alias("s"), "value")
        .groupBy("experiment", F.expr("s div 3600").alias("hour"))
        .agg(cents.alias("cents"), F.count("*").alias("n"), (F.max("s") * 1000).alias("ts_ms"))
        .select(
            "experiment",
            "ts_ms",
            F.round(F.col("cents") / (F.col("n") * 100.0) + 1e-9, 4).alias("cpu_percent"),
            F.round(100.0 + F.col("cents") / (F.col("n") * 10.0) + 1e-9, 4).alias("rss_mib"),
            F.col("n").cast("int").alias("threads"),
        )
    )


def staged(spark: SparkSession, folder: str, drop_first: int = 0) -> DataFrame:
    return throughput.with_stages(samples(spark, folder, INGESTED), drop_first)


def series(spark: SparkSession, folder: str) -> DataFrame:
    return resources.resource_series(metrics(spark, folder))


def with_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = readings(spark, folder)
    return rows.withColumn("day", local_text(F.col("insert_ms"), "UTC").substr(1, 10))


# ------------------------------------------------------------------ queries


def replay_watermark_query(spark, folder):
    return replay_watermark(readings(spark, folder), SPARSE).select(
        "arrival_seq",
        "max_seen_ms",
        (F.col("max_seen_ms") - DAY_MS).alias("delayed_ms"),
    )


def window_arithmetic(spark, folder):
    event = F.col("event_ms")
    label = windowing.series_label(F.col("phase_group"))
    return readings(spark, folder).select(
        "arrival_seq",
        windowing.window_start(event, SPARSE).alias("window_start_ms"),
        windowing.slot_index(event, SPARSE).alias("slot"),
        windowing.phase_index(F.col("series_id")).alias("phase"),
        windowing.expected_of_label(label, SPARSE).alias("expected"),
        local_text(windowing.window_start(event, SPARSE), "UTC").alias("window_start"),
        windowing.floor_to(event - 1_706_000_000_000, SPARSE.size_ms).alias("below_zero"),
    )


def scalar_functions(spark, folder):
    """Durations, labels, keys, ratios and bins of every event."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("bigint")
    unit = F.element_at(F.array(*map(F.lit, ("m", "h", "d", "x"))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.when(k == 0, F.lit("0")).otherwise(F.concat(k.cast("string"), unit))
    method = F.element_at(
        F.array(*map(F.lit, ("fast", "Baseline2", "ALW", "proposed", "other"))),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    probe = F.concat(
        F.element_at(F.array(*map(F.lit, ("fast", "delayed", "baseline", "mystery"))), (F.col("event_id") % 4 + 1).cast("int")),
        F.when(F.col("event_id") % 3 == 0, "_post_filter").otherwise("_source_after_ingestion"),
    )
    series_id = F.when(F.col("event_type") == "view", "Spänning L2").otherwise("Ström L1")
    meter, series_name = windowing.split_legacy_key(
        F.concat_ws("_", F.col("user_id").cast("string"), series_id)
    )
    seconds = k * k * k
    rows = events(spark, folder).select(
        "event_id",
        windowing.duration_ms(text).alias("duration_ms"),
        windowing.duration_label(seconds.cast("double")).alias("duration_label"),
        labels.method_label(method).alias("method_label"),
        labels.method_order(method).alias("method_order"),
        labels.probe_mode(probe).alias("probe_mode"),
        labels.probe_stage(probe).alias("probe_stage"),
        labels.stage_label(probe).alias("stage_label"),
        meter.alias("legacy_meter"),
        series_name.alias("legacy_series"),
        labels.safe_div(k, F.col("event_id") % 3).alias("ratio"),
        labels.percent_change(k, F.col("event_id") % 3).alias("change_pct"),
        labels.percent_saving(F.col("event_id") % 3, k).alias("saving_pct"),
        lateness.bin_index(seconds / 60.0).alias("lateness_bin"),
        windowing.preliminary_met(k % 10, F.lit(8), SPARSE).alias("preliminary_met"),
        windowing.final_met(k % 10, F.lit(8)).alias("final_met"),
        windowing.early_purge_inferred(
            F.when(k % 3 == 0, "DEADLINE").when(k % 3 == 1, "completeness"), k % 10, F.lit(8)
        ).alias("early_purge"),
    )
    return rounded(rows)


def phase_routing(spark, folder):
    """Routing through a lookup table instead of a phase column."""
    rows = readings(spark, folder).drop("phase_group")
    ids = events(spark, folder).select("user_id").distinct()
    meter = F.col("user_id").cast("string").alias("meter_id")
    lookup = meters.lookup_of(
        ids.filter("user_id % 3 <> 0").select(meter), ids.filter("user_id % 3 = 0").select(meter)
    )
    return meters.route(rows, lookup).select("arrival_seq", "meter_id", "series_id", "phase_group")


def metadata_lines(spark, folder):
    customers = spark.read.schema(
        "c_custkey bigint, c_name string, c_mktsegment string"
    ).parquet(f"{folder}/customer.parquet")
    kind = (
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "1-Phase")
        .when(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"), "3-Phase")
        .otherwise("CT")
    )
    last = F.when(F.col("c_custkey") % 10 == 0, F.lit("n/a")).otherwise(
        (F.col("c_custkey") % 4).cast("string")
    )
    return customers.select(
        F.concat_ws(",", F.lit("row"), F.concat(F.lit(" "), F.col("c_custkey").cast("string")), "c_name",
                    F.concat(F.lit("E-Meter "), kind, F.lit(" ")), last).alias("value")
    )


def meter_classes(spark, folder):
    return meters.classify_meters(metadata_lines(spark, folder))


def meter_class_totals(spark, folder):
    return meters.class_totals(meter_classes(spark, folder))


def first_arrivals(spark, folder):
    return first_records(readings(spark, folder), 1000).select("arrival_seq", "meter_id", "event_ms")


def sum_windows(spark, folder):
    taken = placed(spark, folder, "sw").filter("NOT dropped")
    rows = reports.sum_text(plain.sum_windows(taken, SPARSE), SPARSE)
    return rounded(rows, 2)


def sum_windows_with_completeness(spark, folder):
    policy = POLICIES["alw"]
    taken = placed(spark, folder, "alw").filter("NOT dropped")
    passes = watermark_passes(readings(spark, folder), SPARSE, policy.lateness_ms)
    rows = plain.sum_windows_with_completeness(taken, passes, policy, SPARSE)
    return rounded(reports.sum_text(rows, SPARSE), 2)


def distinct_slots(spark, folder):
    return plain.distinct_slot_windows(placed(spark, folder, "alw").filter("NOT dropped"), SPARSE)


def completeness_window_counts(spark, folder):
    return completeness_windows(placed(spark, folder, "cbw"), SPARSE).select(
        "phase_group", "meter_id", "window_start_ms", "window_end_ms", "taken", "dropped", "swallowed"
    )


def contract(spark, folder):
    """Windows of the completeness policy and how many break its contract."""
    rows = emissions(spark, folder, "cbw")
    broken = reports.contract_violations(rows).agg(F.count("*").alias("violations"))
    return rows.agg(
        F.count_if(F.col("result_type") == "FINAL").alias("finals"),
        F.count_if(F.col("result_type") == "PRELIMINARY").alias("preliminaries"),
    ).crossJoin(broken)


def late_rows(spark, folder):
    return late_records(placed(spark, folder, "sw")).select(
        "arrival_seq", "phase_group", "meter_id", "window_start_ms", "event_ms", "max_seen_ms"
    )


def run_totals(spark, folder):
    rows = readings(spark, folder)
    parts = [
        reports.run_totals(placed(spark, folder, n), POLICIES[n].mode, rows) for n in POLICIES
    ]
    return rounded(reduce(DataFrame.unionByName, parts))


def probe_samples(spark, folder):
    """Arrivals per six hours at the four points of the completeness job."""
    rows = readings(spark, folder)
    clock = rows.select(F.col("arrival_seq").alias("fire_seq"), F.col("insert_ms").alias("ms"))
    fired = emissions(spark, folder, "cbw").filter("fire_phase = 0").join(clock, "fire_seq")
    points = {
        "proposed_source_after_ingestion": clock,
        "proposed_source_after_parse": clock,
        "proposed_post_filter": rows.filter(routed_only()).withColumn("ms", F.col("insert_ms")),
        "proposed_post_window_aggregation": fired,
    }
    parts = [throughput.probe_counts(r, name, "ms") for name, r in points.items()]
    return rounded(throughput.tumbling_samples(reduce(DataFrame.unionByName, parts), 6 * HOUR_MS))


def chained_probe_samples(spark, folder):
    """Chained intervals of at least three hours on the clock of arrival."""
    ship(spark)
    rows = readings(spark, folder).withColumn(
        "probe", F.when(routed_only(), "kept").otherwise("other")
    )
    per_ms = rows.groupBy("probe", F.col("insert_ms").alias("ms")).agg(F.count("*").alias("n"))
    return throughput.chained_samples(per_ms, 3 * HOUR_MS)


def output_summary(spark, folder):
    damaged = with_faults_in_file(counts(spark, folder, ("alw", "cbw")))
    return rounded(reports.with_coverage(reports.summarize_outputs(damaged, SPARSE)))


def inferred_output_summary(spark, folder):
    rows = finals(spark, folder)
    doubled = rows.withColumn("row_no", F.lit(0)).unionByName(
        rows.filter(F.col("meter_id").cast("bigint") % 7 == 0).withColumn("row_no", F.lit(1))
    )
    return rounded(
        reports.infer_outputs(doubled, SPARSE).drop("distinct_slot_count_mean", "distinct_slot_count_p95")
    )


def mechanism_summary(spark, folder):
    table = counts(spark, folder, tuple(POLICIES)).withColumn("row_no", F.lit(0))
    return rounded(reports.mechanism_summary(reports.summarize_outputs(table, SPARSE)))


def output_distribution(spark, folder):
    return reports.output_distribution(counts(spark, folder, ("alw", "cbw")))


def output_distribution_pivot(spark, folder):
    return reports.distribution_pivot(
        output_distribution(spark, folder), [BASELINE, PROPOSED]
    )


def output_totals(spark, folder):
    return rounded(reports.output_totals(counts(spark, folder, ("alw", "cbw"))))


def outputs_cdf(spark, folder):
    return rounded(reports.outputs_cdf(counts(spark, folder, ("alw", "cbw"))))


def early_purge_shares(spark, folder):
    return rounded(reports.early_purge_shares(counts(spark, folder, ("cbw",))))


def missing_slots(spark, folder):
    dropped = placed(spark, folder, "cbw").agg(F.count_if("dropped").alias("dropped_records"))
    return reports.missing_slots(counts(spark, folder, ("cbw",)), dropped, SPARSE)


def incomplete_samples(spark, folder):
    return reports.incomplete_samples(counts(spark, folder, ("cbw",)), SPARSE)


def dropped_ratio(spark, folder):
    rows = readings(spark, folder)
    runs = [
        reports.run_totals(placed(spark, folder, n), POLICIES[n].label, rows) for n in ("sw", "cbw")
    ]
    parts = rows.filter(routed_only()).groupBy("phase_group").agg(
        F.count("*").alias("post_filter_total_events")
    )
    totals = parts.crossJoin(
        spark.createDataFrame([("fast",), ("proposed",), ("delayed",)], "mode string")
    )
    return rounded(reports.dropped_ratio(reduce(DataFrame.unionByName, runs), totals))


def top_faulty(spark, folder):
    return reports.top_faulty(faulty(spark, folder, ("alw", "cbw")))


def faulty_summary(spark, folder):
    return rounded(reports.faulty_summary(faulty(spark, folder, ("alw", "cbw"))))


def faulty_per_day(spark, folder):
    return reports.faulty_per_day(faulty(spark, folder, ("alw", "cbw")), SPARSE)


def latency_summary(spark, folder):
    return rounded(latency.latency_summary(finals(spark, folder)))


def latency_distribution(spark, folder):
    rows = latency.select_rows(latency.final_or_purge(finals(spark, folder)), "proposed", "final")
    return rounded(latency.distribution_summary(rows))


def latency_distribution_by_deadline(spark, folder):
    """The summary when rows state no reason: the deadline follows from the latency."""
    rows = finals(spark, folder).drop("finalization_reason")
    return rounded(latency.distribution_summary(rows, deadline_tolerance_ms=1, immediate_tolerance_ms=60_000))


def latency_quantiles(spark, folder):
    return rounded(latency.quantile_table(finals(spark, folder)))


def latency_histogram(spark, folder):
    return rounded(latency.latency_histogram(finals(spark, folder), 60.0))


def lateness_rows(mode: str) -> Query:
    def query(spark, folder):
        rows = lateness.lateness(with_day(spark, folder), mode, SPARSE)
        return rows.filter("late_s IS NOT NULL").groupBy("meter_id", "series_id").agg(
            F.count("*").alias("late"),
            F.sum("late_s").alias("sum_s"),
            F.max("late_s").alias("max_s"),
        )

    return query


def lateness_histogram(spark, folder):
    late = lateness.lateness(with_day(spark, folder), "per_meter", SPARSE)
    return lateness.histogram(late, ["mode", "day"])


def lateness_histogram_overall(spark, folder):
    late = lateness.lateness(with_day(spark, folder), "post_window_delay", SPARSE)
    return lateness.histogram(late, ["mode"])


def lateness_cdf(spark, folder):
    late = lateness.lateness(with_day(spark, folder), "post_window_delay", SPARSE)
    return lateness.cdf(late, ["mode"])


def lateness_days(mode: str) -> Query:
    return lambda spark, folder: lateness.day_summary(with_day(spark, folder), mode, SPARSE)


def lateness_days_carried(spark, folder):
    """All measures by day, from a state that is added to ten days at a time."""
    rows, state = with_day(spark, folder), new_folder(spark, "lateness")
    month_part = (F.dayofmonth(F.col("day").cast("date")) - 1) / 10
    part = F.concat(F.substring("day", 1, 8), F.floor(month_part).cast("string"))
    dealt = new_folder(spark, "readings")
    rows.withColumn("part", part).write.partitionBy("part").parquet(dealt)
    table = spark.read.parquet(dealt)
    for row in table.select("part").distinct().orderBy("part").collect():
        batch = table.filter(F.col("part") == row.part).drop("part")
        lateness_state.add_batch(state, row.part, batch, SPARSE)
    return lateness_state.day_summary(spark, state)


def lateness_overall(spark, folder):
    return lateness.overall_summary(with_day(spark, folder), SPARSE)


def lateness_hourly(spark, folder):
    return lateness.hourly(with_day(spark, folder), "per_meter_series", SPARSE)


def recommended_lateness(spark, folder):
    return lateness.recommended_lateness(with_day(spark, folder), SPARSE)


def probe_summary(spark, folder):
    kept = throughput.drop_warmup(
        throughput.usable_samples(samples(spark, folder, PARSED), 1000), ["probe"], 3
    )
    return rounded(throughput.probe_summary(kept))


def stage_ratio(spark, folder):
    return rounded(
        throughput.stage_ratio(throughput.probe_summary(samples(spark, folder, PARSED)))
    )


def stage_summary(spark, folder):
    return rounded(throughput.stage_summary(staged(spark, folder)))


def stage_progress(spark, folder):
    return rounded(
        staged(spark, folder, 2).select(
            "experiment", "stage", "sample_index", "ts_ms", "elapsed_sec", "runtime_percent"
        )
    )


def throughput_overall(spark, folder):
    return rounded(throughput.overall(throughput.stage_summary(staged(spark, folder))))


def throughput_ranking(spark, folder):
    rows = throughput.ranking(throughput.overall(throughput.stage_summary(staged(spark, folder))))
    return rounded(
        rows.select("experiment", "method_label", "post_filter_weighted_avg_events_per_sec")
    )


def runtime_curve(spark, folder):
    return rounded(throughput.runtime_curve(staged(spark, folder), 86_400.0))


def nearest_pairs(spark, folder):
    return rounded(throughput.nearest_source(staged(spark, folder), TOLERANCE_MS))


def ratio_summary(spark, folder):
    return rounded(
        throughput.ratio_summary(throughput.nearest_source(staged(spark, folder), TOLERANCE_MS))
    )


def ratio_curve(spark, folder):
    pairs = throughput.nearest_source(staged(spark, folder), TOLERANCE_MS)
    return rounded(throughput.ratio_curve(pairs, 86_400.0))


def probe_totals(spark, folder):
    return rounded(throughput.probe_totals(samples(spark, folder, PARSED), ["method_key"]))


def cpu_buckets(spark, folder):
    return rounded(resources.cpu_buckets(series(spark, folder), 86_400))


def memory_buckets(spark, folder):
    rows = resources.resource_series(metrics(spark, folder), drop_first_sec=86_400.0)
    return rounded(resources.memory_buckets(rows, 86_400))


def runtime_bins(spark, folder):
    rows = resources.resource_series(metrics(spark, folder), positive_only=True)
    return rounded(resources.runtime_bins(rows, 5.0, cpu="p95", memory="median"))


def system_summary(spark, folder):
    return rounded(resources.system_summary(series(spark, folder)))


def _comparable(spark, folder):
    totals = throughput.probe_totals(samples(spark, folder, PARSED), ["method_key"])
    return resources.system_summary(series(spark, folder)).join(
        totals.withColumnRenamed("method_key", "experiment"), "experiment"
    )


def performance_comparison(spark, folder):
    return rounded(resources.performance_comparison(_comparable(spark, folder)))


def metric_table(spark, folder):
    summary = resources.system_summary(series(spark, folder))
    return rounded(
        resources.metric_table(
            summary,
            "system",
            {"runtime_sec": "sec", "cpu_mean_percent": "%", "memory_p95_mib": "MiB"},
        )
    )


def metric_table_all(spark, folder):
    return rounded(
        resources.full_metric_table(
            system_summary(spark, folder),
            pause_summary(spark, folder),
            samples(spark, folder, PARSED).withColumn("experiment", F.col("method_key")),
            latency_summary(spark, folder),
        )
    )


def smoothed_cpu(spark, folder):
    rows = resources.progress(resources.rolling_mean(series(spark, folder), "cpu_percent", 30))
    return rounded(
        rows.select("experiment", "ts_ms", "cpu_percent_smooth", "progress_pct"), 5
    )


def sampling_interval(spark, folder):
    return rounded(resources.sampling_interval(series(spark, folder)))


def _per_policy(make: Callable[[str], Query], prefix: str) -> dict[str, Query]:
    return {f"{prefix}_{name}": make(name) for name in POLICIES}


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw lines, some of them broken in one way or another."""
    arrival_ms = F.unix_micros("ts").cast("bigint") / 1000
    stamp = local_text(arrival_ms, "UTC")
    kind = F.col("event_id") % 16
    time = F.when(kind == 5, F.concat(F.substring(stamp, 1, 5), F.lit("13"), F.substring(stamp, 8, 12))).otherwise(F.concat(stamp, F.lit(".25")))
    text = F.concat(
        F.when(kind == 3, "Row{").otherwise("Struct{"),
        F.lit("series_id="), "event_type",
        F.lit(",location_id=place "), (F.col("user_id") % 10).cast("string"), F.when(kind == 8, ", upper floor").otherwise(""),
        F.when(kind == 4, "").otherwise(F.concat(F.when(kind == 11, ", ").otherwise(","), F.lit("meter_id= "), F.col("user_id").cast("string"), F.lit(" "))),
        F.lit(",time="), time,
        F.lit(",value="), F.when(kind == 6, "n/a").otherwise(F.concat((F.col("event_id") % 977).cast("string"), F.lit(".5"))),
        F.lit(",value_status=ok,insert_time="), stamp, F.lit(",extract_time="), F.when(kind == 9, "today").otherwise(stamp),
        F.when(kind == 10, "").otherwise("}"),
    )
    day = F.expr("CAST(floor(unix_micros(ts) / 86400000000) AS BIGINT)")
    return events(spark, folder).select(
        F.col("event_id").alias("arrival_seq"),
        day.alias("arrival_epoch"),
        F.concat(F.lit("lines-"), day.cast("string")).alias("file_name"),
        F.when(kind == 7, "  ").otherwise(text).alias("value"),
    )


def parsed_lines(spark, folder):
    return parse_strict(raw_lines(spark, folder).drop("file_name", "arrival_epoch"), "UTC")


def profiled_lines(spark, folder):
    return parse_permissive(raw_lines(spark, folder).drop("file_name", "arrival_epoch"), "UTC")


def profiled_files(spark, folder):
    return profile_progress(parse_permissive(raw_lines(spark, folder), "UTC"))


def pauses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of a collector's log, some without size or duration."""
    n = F.col("event_id")
    stamp = local_text(F.unix_micros("ts") / 1000, "UTC")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Young (Normal)", "Full", "Remark", "Cleanup", "Sweep")]), (n % 5 + 1).cast("int"))
    text = F.concat(
        F.lit("["), F.replace(stamp, F.lit(" "), F.lit("T")), F.lit(".250+0000][info][gc] GC("), n.cast("string"), F.lit(") Pause "), kind,
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit(" "), (n % 300 + 20).cast("string"), F.lit("M->"), (n % 20).cast("string"), F.lit("M(512M)"))),
        F.when(n % 11 == 0, "").otherwise(F.concat(F.lit(" "), (n % 40).cast("string"), F.lit(".125ms"))),
    )
    lines = events(spark, folder).select(n.alias("arrival_seq"), method_key().alias("experiment"), text.alias("value"))
    return gc_events(lines)


def pause_summary(spark, folder):
    return rounded(resources.gc_summary(resources.gc_series(pauses(spark, folder))))


def queries() -> dict[str, Query]:
    table: dict[str, Query] = {
        "replay_watermark": replay_watermark_query,
        "window_arithmetic": window_arithmetic,
        "scalar_functions": scalar_functions,
        "phase_routing": phase_routing,
        "meter_classes": meter_classes,
        "meter_class_totals": meter_class_totals,
        "first_arrivals": first_arrivals,
        "late_records": late_rows,
        "sum_windows": sum_windows,
        "sum_windows_with_completeness": sum_windows_with_completeness,
        "distinct_slots": distinct_slots,
        "completeness_windows": completeness_window_counts,
        "completeness_contract": contract,
        "run_totals": run_totals,
        "probe_samples": probe_samples,
        "chained_probe_samples": chained_probe_samples,
        "latency_rows": lambda s, d: reports.latency_rows(emissions(s, d, "cbw")),
        "latency_text": lambda s, d: reports.latency_text(emissions(s, d, "cbw"), SPARSE),
        "emission_text": lambda s, d: reports.emission_text(
            emissions(s, d, "cbw"), SPARSE, purge_ms=F.col("window_end_ms") + DAY_MS
        ),
        "output_summary": output_summary,
        "inferred_output_summary": inferred_output_summary,
        "mechanism_summary": mechanism_summary,
        "output_distribution": output_distribution,
        "output_distribution_pivot": output_distribution_pivot,
        "output_totals": output_totals,
        "outputs_cdf": outputs_cdf,
        "early_purge_shares": early_purge_shares,
        "missing_slots": missing_slots,
        "incomplete_samples": incomplete_samples,
        "dropped_ratio": dropped_ratio,
        "top_faulty": top_faulty,
        "faulty_summary": faulty_summary,
        "faulty_per_day": faulty_per_day,
        "latency_summary": latency_summary,
        "latency_distribution": latency_distribution,
        "latency_distribution_by_deadline": latency_distribution_by_deadline,
        "latency_quantiles": latency_quantiles,
        "latency_histogram": latency_histogram,
        "lateness_per_meter": lateness_rows("per_meter"),
        "lateness_per_meter_series": lateness_rows("per_meter_series"),
        "lateness_global": lateness_rows("global"),
        "lateness_post_window": lateness_rows("post_window_delay"),
        "lateness_histogram": lateness_histogram,
        "lateness_histogram_overall": lateness_histogram_overall,
        "lateness_cdf": lateness_cdf,
        "lateness_days_per_meter": lateness_days("per_meter"),
        "lateness_days_post_window": lateness_days("post_window_delay"),
        "lateness_days_carried": lateness_days_carried,
        "lateness_overall": lateness_overall,
        "lateness_hourly": lateness_hourly,
        "recommended_lateness": recommended_lateness,
        "probe_summary": probe_summary,
        "stage_ratio": stage_ratio,
        "stage_summary": stage_summary,
        "stage_progress": stage_progress,
        "throughput_overall": throughput_overall,
        "throughput_ranking": throughput_ranking,
        "runtime_curve": runtime_curve,
        "nearest_pairs": nearest_pairs,
        "ratio_summary": ratio_summary,
        "ratio_curve": ratio_curve,
        "probe_totals": probe_totals,
        "cpu_buckets": cpu_buckets,
        "memory_buckets": memory_buckets,
        "runtime_bins": runtime_bins,
        "system_summary": system_summary,
        "performance_comparison": performance_comparison,
        "metric_table": metric_table,
        "metric_table_all": metric_table_all,
        "smoothed_cpu": smoothed_cpu,
        "sampling_interval": sampling_interval,
        "parsed_lines": parsed_lines,
        "profiled_lines": profiled_lines,
        "profiled_files": profiled_files,
        "pause_rows": pauses,
        "pause_summary": pause_summary,
    }
    table |= _per_policy(lambda n: lambda s, d: window_counts(placed(s, d, n)), "window_counts")
    table |= _per_policy(lambda n: lambda s, d: emissions(s, d, n), "emissions")
    table |= _per_policy(
        lambda n: lambda s, d: reports.output_counts(emissions(s, d, n, ["distinct_slot_count"])), "output_counts"
    )
    for name in ("alw", "cbw"):
        table[f"faulty_windows_{name}"] = (
            lambda s, d, n=name: reports.faulty_windows(emissions(s, d, n), SPARSE)
        )
    return table
