"""Reports on emissions: output counts, faults, dropped and missing readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from finality.config import SERIES_L1, SINGLE, THREE, THREE_PHASE_LABEL, WindowSpec
from finality.functions.labels import method_label, method_order, safe_div
from finality.functions.scan import TOP_BITS, running
from finality.functions.timecols import local_day, local_text
from finality.functions.windowing import (
    early_purge_inferred,
    early_purges,
    expected_of_label,
    final_met,
    preliminary_met,
)
from finality.session import only_row, settled
from finality.sources import metrics
from finality.sources.metrics import read_results

KEY = ["mode", "meter_id", "series_id", "window_start_ms", "window_end_ms"]


def output_counts(emissions: DataFrame) -> DataFrame:
    """One row per window: emissions, last count and slots, early purge.

    ``early_purged_raw`` compares the latency with the allowed lateness alone,
    so a deadline met on the last millisecond counts as early;
    ``early_purged`` asks for completion by count.
    """
    purges = early_purges()
    return emissions.groupBy(*KEY).agg(
        F.count("*").cast("int").alias("output_count"),
        *[F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in purges.items()],
        F.max_by("count", "emit_no").alias("final_count"),
        F.max_by("distinct_slot_count", "emit_no").alias("distinct_slot_count"),
    )


def final_only(emissions: DataFrame) -> DataFrame:
    return emissions.filter(F.col("result_type") == "FINAL")


def faulty_only(emissions: DataFrame) -> DataFrame:
    """Faulty emissions; of the completeness policy only the final ones."""
    return emissions.filter(
        F.col("fault_indicator")
        & ((F.col("mode") != "PROPOSED") | (F.col("result_type") == "FINAL"))
    )


def latency_rows(emissions: DataFrame) -> DataFrame:
    """Finalization-latency rows of the final emissions."""
    return final_only(emissions).select(
        "mode",
        "result_type",
        "finalization_reason",
        "meter_id",
        "series_id",
        "count",
        "fault_indicator",
        "window_start_ms",
        "window_end_ms",
        "watermark_at_purge_ms",
        "allowed_lateness_ms",
        "finalization_latency_ms",
        "latency_reduction_ms",
    )


def faulty_windows(emissions: DataFrame, spec: WindowSpec) -> DataFrame:
    """Faulty emissions with the number of unique faulty meters so far.

    A meter is new at its first faulty emission. Those are marked by joining
    the first emission of each meter back on the full emission key, and summed
    up along the emission order block by block.
    """
    faulty = settled(faulty_only(emissions))
    return counted_faults(faulty, first_faults(faulty), spec)


#: Identifies an emission by its place in the order of emissions.
POSITION = ["fire_seq", "fire_phase", "window_end_ms", "emit_no"]


def first_faults(faulty: DataFrame) -> DataFrame:
    """The position of each meter's first faulty emission."""
    return (
        faulty.groupBy("phase_group", "meter_id")
        .agg(F.min(F.struct(*POSITION)).alias("at"))
        .select("phase_group", "meter_id", "at.*")
    )


def counted_faults(
    faulty: DataFrame, firsts: DataFrame, spec: WindowSpec, before: tuple[int, int] = (0, 0)
) -> DataFrame:
    """Faulty emissions with the unique meters up to each: those that begin at ``firsts``, and so many ``before``."""
    marked = faulty.join(
        firsts.withColumn("is_first", F.lit(1)), ["phase_group", "meter_id", *POSITION], "left"
    )
    three = F.col("phase_group") == THREE
    # many windows close on one arrival, and all open ones at the end of input, so the
    # arrival alone does not bound a block: the last characters of the meter split it further
    counted = running(
        marked,
        [
            {"_top": F.shiftright("fire_seq", spec.block_bits + TOP_BITS)},
            {"_blk": F.shiftright("fire_seq", spec.block_bits)},
            {"_seq": F.col("fire_seq"), "_phase": F.col("fire_phase"), "_end": F.col("window_end_ms")},
            {"_tail": F.right("meter_id", F.lit(3))},
        ],
        ["phase_group", "meter_id", "emit_no"],
        {
            "single_unique": ("sum", F.when(~three, F.col("is_first"))),
            "three_unique": ("sum", F.when(three, F.col("is_first"))),
        },
        inclusive=True,
    )
    single, three = (
        (F.col(name) + F.lit(n)).cast("int")
        for name, n in zip(("single_unique", "three_unique"), before, strict=True)
    )
    return counted.select(
        "meter_id",
        "series_id",
        local_text(F.col("window_start_ms"), spec.zone).alias("window_start"),
        local_text(F.col("window_end_ms"), spec.zone).alias("window_end"),
        "mode",
        single.alias("single_unique"),
        three.alias("three_unique"),
        (single + three).alias("total_unique"),
        "voltage_data",
    )


def contract_violations(emissions: DataFrame) -> DataFrame:
    """Windows with more than one preliminary or other than one final emission."""
    return (
        emissions.groupBy(*KEY)
        .agg(
            F.count_if(F.col("result_type") == "PRELIMINARY").alias("preliminary"),
            F.count_if(F.col("result_type") == "FINAL").alias("final"),
        )
        .filter("preliminary > 1 OR final <> 1")
    )


def run_totals(placed: DataFrame, policy_label: str, input_records: DataFrame) -> DataFrame:
    """Run summary row: parsed and dropped readings and their ratio."""
    dropped = placed.agg(F.count_if("dropped").alias("dropped_records"))
    total = input_records.agg(F.count("*").alias("total_input_records"))
    return total.crossJoin(dropped).select(
        F.lit(policy_label).alias("mode"),
        "total_input_records",
        "dropped_records",
        F.round(
            safe_div(F.col("dropped_records"), F.col("total_input_records")), 6
        ).alias("dropped_record_ratio"),
    )


# --------------------------------------------------------------- summaries


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, with ``copies`` and ``outputs`` of the key.

    The first row of a key is found by a partial aggregate, not by a window,
    so a key repeated very often is folded before the shuffle.
    """
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("copies"),
            F.sum("output_count").alias("outputs"),
            F.min_by(F.struct(*others), order).alias("row"),
        )
        .select(*keys, "row.*", "copies", "outputs")
    )


def _summary(rows: DataFrame, order: str) -> DataFrame:
    """Summary per experiment from rows with ``output_count, final_count, early``."""
    windows = first_per_key(rows, ["experiment", *KEY], order).withColumn(
        "bad", (F.col("window_start_ms") == 0) & (F.col("window_end_ms") == 0)
    )
    good = ~F.col("bad")

    def total(column: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, column)), F.lit(0))

    def of_good(name: str) -> list[Column]:
        value = F.when(good, F.col(name))
        return [
            F.avg(value).alias(f"{name}_mean"),
            F.percentile(value, F.lit(0.95)).alias(f"{name}_p95"),
        ]

    return windows.groupBy("experiment").agg(
        F.count_if(good).alias("emitted_windows"),
        total(F.col("copies") - 1, good).alias("duplicate_window_rows"),
        F.count_if(good & F.col("early")).alias("early_purged_windows"),
        total(F.col("output_count"), good).alias("valid_window_outputs"),
        *of_good("final_count"),
        *of_good("distinct_slot_count"),
        total(F.col("copies"), F.col("bad")).alias("invalid_window_rows"),
        F.count_if("bad").alias("invalid_unique_windows"),
        total(F.col("outputs"), F.col("bad")).alias("missing_window_metadata_outputs"),
    )


def summarize_outputs(counts: DataFrame, spec: WindowSpec, order: str = "row_no") -> DataFrame:
    """Output-count summary per ``experiment``.

    Rows whose window bounds are both zero are set apart; of rows with the same
    key the first in ``order`` counts. A window is early when it says so and its
    count is complete.
    """
    expected = expected_of_label(F.col("series_id"), spec)
    rows = counts.withColumns(
        {
            "output_count": F.coalesce(F.col("output_count").cast("bigint"), F.lit(0)),
            "early": F.col("early_purged") & final_met(F.col("final_count"), expected),
        }
    )
    return _with_totals(_summary(rows, order))


def infer_outputs(finals: DataFrame, spec: WindowSpec, order: str = "row_no") -> DataFrame:
    """The same summary inferred from finalization rows.

    A window has one output, and one more if its count reached the preliminary
    threshold. No row is taken for damaged, and slots are unknown.
    """
    expected = expected_of_label(F.col("series_id"), spec)
    reason = F.col("finalization_reason") if "finalization_reason" in finals.columns else None
    rows = finals.withColumns(
        {
            "final_count": F.coalesce(F.col("count"), F.lit(0)),
            "distinct_slot_count": F.lit(None).cast("int"),
            "output_count": F.lit(1)
            + preliminary_met(F.col("count"), expected, spec).cast("bigint"),
            "early": early_purge_inferred(reason, F.col("count"), expected),
        }
    )
    return _with_totals(_summary(rows, order))


def _with_totals(summary: DataFrame) -> DataFrame:
    total = F.col("valid_window_outputs") + F.col("missing_window_metadata_outputs")
    return summary.withColumns(
        {
            "early_purge_ratio": safe_div(F.col("early_purged_windows"), F.col("emitted_windows")),
            "total_outputs": total,
            "mean_output_count": safe_div(total, F.col("emitted_windows")),
        }
    )


def outputs_of(counts: DataFrame | None, finals: DataFrame | None, spec: WindowSpec) -> DataFrame:
    """Summary from output counts if there are any, else from finalization rows."""
    if counts is not None:
        return summarize_outputs(counts, spec)
    if finals is not None:
        return infer_outputs(finals, spec)
    raise ValueError("neither output counts nor finalization rows given")


def outputs_of_folder(spark: SparkSession, folder: str, spec: WindowSpec) -> DataFrame:
    """Summary of all runs whose results lie below a folder.

    An experiment without rows of output counts is inferred from its finalization rows.
    """
    counts = read_results(spark, folder, "output_counts", metrics.OUTPUT_COUNTS)
    finals = read_results(spark, folder, "finalization_latency_metrics", metrics.FINALIZATION)
    if counts is None or finals is None:
        return outputs_of(counts, finals, spec)
    counted = F.broadcast(counts.select("experiment").distinct())  # a row per run
    others = infer_outputs(finals.join(counted, "experiment", "left_anti"), spec)
    return summarize_outputs(counts, spec).unionByName(others)


def with_coverage(summary: DataFrame) -> DataFrame:
    """Compare emitted windows with the reference experiment.

    The reference is the experiment named like ``baseline`` with most windows,
    or the one with most windows when none is named so.
    """
    named = F.lower("experiment").contains("baseline")
    best = Window.partitionBy(F.lit(0)).orderBy(
        named.desc(), F.desc("emitted_windows"), "experiment"
    )
    return summary.withColumns(
        {
            "reference_window_experiment": F.first("experiment").over(best),
            "reference_emitted_windows": F.first("emitted_windows").over(best),
        }
    ).withColumn(
        "emitted_window_coverage_ratio",
        safe_div(F.col("emitted_windows"), F.col("reference_emitted_windows")),
    )


def output_distribution(counts: DataFrame) -> DataFrame:
    """Number of windows per experiment and output count."""
    return counts.groupBy("experiment", "output_count").agg(F.count("*").alias("windows"))


def distribution_pivot(distribution: DataFrame, experiments: list[str]) -> DataFrame:
    """Distribution with one column per experiment, empty cells as zero."""
    return (
        distribution.groupBy("output_count")
        .pivot("experiment", experiments)
        .agg(F.sum("windows"))
        .na.fill(0)
    )


def mechanism_summary(summary: DataFrame) -> DataFrame:
    """Window and output totals per method, also in millions, in method order."""
    return summary.select(
        F.col("experiment").alias("method"),
        method_label(F.col("experiment")).alias("method_label"),
        method_order(F.col("experiment")).alias("method_order"),
        "emitted_windows",
        (F.col("emitted_windows") / 1_000_000).alias("emitted_windows_m"),
        "total_outputs",
        (F.col("total_outputs") / 1_000_000).alias("total_outputs_m"),
        "valid_window_outputs",
        "missing_window_metadata_outputs",
        "early_purged_windows",
        "early_purge_ratio",
        "duplicate_window_rows",
        "invalid_window_rows",
        "invalid_unique_windows",
    ).orderBy("method_order", "method")


# ------------------------------------------------------------------ faults


def faulty_summary(faulty: DataFrame) -> DataFrame:
    """Faulty windows and meters per experiment.

    Counts per meter come first, so distinct meters need no second pass over
    the faulty windows.
    """
    by_series = faulty.groupBy("experiment", "meter_id").agg(
        F.count("*").alias("windows"),
        F.bool_or(F.col("series_id") == SERIES_L1).alias("single"),
        F.bool_or(F.col("series_id").contains("L1/L2/L3")).alias("three"),
    )
    return by_series.groupBy("experiment").agg(
        F.sum("windows").alias("faulty_windows"),
        F.count("*").alias("unique_faulty_meters"),
        F.count_if("single").alias("single_phase_unique_faulty_meters"),
        F.count_if("three").alias("three_phase_unique_faulty_meters"),
        safe_div(F.sum("windows"), F.count("*")).alias("faulty_windows_per_meter_mean"),
        F.percentile("windows", F.lit(0.95)).alias("faulty_windows_per_meter_p95"),
    )


def top_faulty(faulty: DataFrame, top: int = 50) -> DataFrame:
    """Meters and series with most faulty windows of each experiment."""
    counted = faulty.groupBy("experiment", "meter_id", "series_id").agg(
        F.count("*").alias("faulty_windows")
    )
    rank = Window.partitionBy("experiment").orderBy(
        F.desc("faulty_windows"), "meter_id", "series_id"
    )
    return (
        counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    )


def faulty_per_day(faulty: DataFrame, spec: WindowSpec) -> DataFrame:
    return faulty.groupBy(
        "experiment", local_day(F.col("window_start_ms"), spec.zone).alias("day")
    ).agg(F.count("*").alias("faulty_windows"))


# ------------------------------------------------- missing versus dropped


def missing_slots(counts: DataFrame, dropped: DataFrame, spec: WindowSpec) -> DataFrame:
    """Expected, found and missing readings in total and per phase.

    ``dropped`` is a one-row table ``dropped_records``; only the total row is
    compared with it.
    """
    expected = expected_of_label(F.col("series_id"), spec)
    phase = F.when(F.col("series_id") == THREE_PHASE_LABEL, "three_phase").otherwise("single_phase")
    rows = counts.select(
        phase.alias("phase"),
        expected.alias("expected"),
        "final_count",
        "distinct_slot_count",
        F.greatest(F.lit(0), expected - F.col("final_count")).alias("missing_count"),
        F.greatest(F.lit(0), expected - F.col("distinct_slot_count")).alias("missing_slots"),
    )
    stats = rows.rollup("phase").agg(
        F.count("*").alias("windows"),
        F.sum("expected").alias("expected"),
        F.sum("final_count").alias("final_count"),
        F.sum("distinct_slot_count").alias("distinct_slot_count"),
        F.sum("missing_count").alias("missing_by_count"),
        F.sum("missing_slots").alias("missing_by_slots"),
        F.count_if(F.col("missing_count") > 0).alias("incomplete_by_count"),
        F.count_if(F.col("missing_slots") > 0).alias("incomplete_by_slots"),
    )
    total = F.col("phase").isNull()
    return stats.crossJoin(F.broadcast(only_row(dropped, "dropped records"))).select(
        F.coalesce("phase", F.lit("all_windows")).alias("phase"),
        *stats.columns[1:],
        F.when(total, F.col("missing_by_count") - F.col("dropped_records")).alias(
            "missing_by_count_minus_dropped"
        ),
        F.when(total, F.col("missing_by_slots") - F.col("dropped_records")).alias(
            "missing_by_slots_minus_dropped"
        ),
    )


def incomplete_samples(counts: DataFrame, spec: WindowSpec, limit: int = 10) -> DataFrame:
    """The first windows with missing slots, in key order."""
    expected = expected_of_label(F.col("series_id"), spec)
    return (
        counts.filter(F.col("distinct_slot_count") < expected)
        .select(
            *KEY,
            expected.alias("expected"),
            "final_count",
            "distinct_slot_count",
            (expected - F.col("distinct_slot_count")).alias("missing_distinct_slots"),
        )
        .orderBy("window_start_ms", "meter_id", "series_id", "mode")
        .limit(limit)
    )


def dropped_ratio(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Dropped readings over post-filter events, matched by run when both know it.

    Rows without a match or with a zero denominator are left out.
    """
    keys = ["mode", "run_id"] if "run_id" in runs.columns and "run_id" in totals.columns else ["mode"]
    lowered = [t.withColumn("mode", F.lower("mode")) for t in (runs, totals)]
    denominators = (
        lowered[1]
        .filter(F.col("post_filter_total_events").isNotNull())
        .groupBy(*keys)
        .agg(F.sum("post_filter_total_events").alias("post_filter_total_events"))
    )
    return (
        lowered[0]
        .join(denominators, keys, "left")
        .filter((F.col("post_filter_total_events") > 0) & F.col("dropped_records").isNotNull())
        .select(
            *keys,
            method_label(F.col("mode")).alias("method_label"),
            method_order(F.col("mode")).alias("method_order"),
            "dropped_records",
            "post_filter_total_events",
            (F.col("dropped_records") / F.col("post_filter_total_events")).alias(
                "dropped_record_ratio"
            ),
        )
        .orderBy("method_order", *keys)
    )


# ------------------------------------------------------- outputs per window


def output_totals(counts: DataFrame, proposed: str = "PROPOSED", baseline: str = "BASELINE") -> DataFrame:
    """Total outputs of two modes, their ratio, and outputs per window of each."""

    def stats(mode: str, prefix: str) -> list[Column]:
        value = F.when(F.col("mode") == mode, F.col("output_count"))
        return [
            F.sum(value).alias(f"{prefix}_outputs"),
            F.percentile(value, F.lit(0.5)).alias(f"{prefix}_median"),
            F.percentile(value, F.lit(0.95)).alias(f"{prefix}_p95"),
        ]

    both = counts.filter(F.col("mode").isin(proposed, baseline))
    return both.agg(
        *stats(proposed, "proposed"),
        *stats(baseline, "baseline"),
        F.greatest(F.floor(F.percentile("output_count", F.lit(0.99))), F.lit(5)).alias("axis_limit"),
    ).withColumn(
        "baseline_over_proposed",
        F.try_divide(F.col("baseline_outputs"), F.col("proposed_outputs")),
    )


def outputs_cdf(counts: DataFrame) -> DataFrame:
    """Share of windows with at most so many outputs, per mode.

    The running sum goes over the distinct values, of which there are few.
    """
    values = counts.groupBy("mode", "output_count").agg(F.count("*").alias("windows"))
    upto = Window.partitionBy("mode").orderBy("output_count")
    return values.withColumn(
        "cumulative_share",
        F.sum("windows").over(upto) / F.sum("windows").over(Window.partitionBy("mode")),
    )


def early_purge_shares(counts: DataFrame, proposed: str = "PROPOSED") -> DataFrame:
    """Share of windows flagged early, overall and by series."""
    return (
        counts.filter(F.col("mode") == proposed)
        .rollup("series_id")
        .agg(F.count("*").alias("windows"), F.avg(F.col("early_purged_raw").cast("int")).alias("early_share"))
        .withColumn("series_id", F.coalesce("series_id", F.lit("Overall")))
    )


def emission_text(emissions: DataFrame, spec: WindowSpec, purge_ms: Column | None = None) -> DataFrame:
    """One line of text per emission.

    ``purge_ms`` is the clock when the emission was made, the start of the query without it.
    """
    if purge_ms is None:
        purge_ms = F.unix_millis(F.current_timestamp())
    proposed = F.col("mode") == "PROPOSED"
    label = F.concat(
        F.when(proposed, "PROPOSED_").otherwise("BASELINE_"),
        F.when(F.col("result_type") == "FINAL", "PURGE").otherwise("UPDATE"),
    )
    line = F.format_string(
        "[%s] Window: %s TO %s | Meter: %s | Series: %s | Count: %d | Completeness: %s"
        " | FinalizationReason: %s | Fault: %s | PurgeTimeMin: %.2f",
        label,
        local_text(F.col("window_start_ms"), spec.zone),
        local_text(F.col("window_end_ms"), spec.zone),
        "meter_id",
        "series_id",
        "count",
        "completeness",
        F.coalesce("finalization_reason", F.lit("null")),
        F.col("fault_indicator").cast("string"),
        purge_ms / 60_000.0,
    )
    return emissions.select(*KEY, "emit_no", line.alias("line"))


def sum_text(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Text of plain sum windows, with completeness when the rows carry it."""
    bounds = [local_text(F.col(c), spec.zone) for c in ("window_start_ms", "window_end_ms")]
    if "result_type" in windows.columns:
        line = F.format_string(
            "[%s] Window: %s TO %s | Meter: %s | Count: %d | Completeness: %s | Sum Value: %.2f",
            "result_type", *bounds, "meter_id", "count", "completeness", "sum_value",
        )
    else:
        line = F.format_string(
            "[BASELINE] Window: %s TO %s | Meter: %s | Count: %d | Sum Value: %.2f",
            *bounds, "meter_id", "count", "sum_value",
        )
    return windows.withColumn("line", line)


def latency_text(emissions: DataFrame, spec: WindowSpec) -> DataFrame:
    """One line of text per final emission with its latency in minutes."""

    def minutes(name: str) -> Column:
        return F.col(name) / 60_000.0

    line = F.format_string(
        "[FINALIZATION_LATENCY] Mode: %s | Window: %s TO %s | Meter: %s | Series: %s"
        " | Count: %d | Completeness: %s | Fault: %s | FinalizationReason: %s"
        " | WatermarkAtPurgeMin: %.2f | WindowEndMin: %.2f | AllowedLatenessMin: %.2f"
        " | FinalizationLatencyMin: %.2f | LatencyReductionMin: %.2f",
        "mode",
        local_text(F.col("window_start_ms"), spec.zone),
        local_text(F.col("window_end_ms"), spec.zone),
        "meter_id",
        "series_id",
        "count",
        "completeness",
        F.col("fault_indicator").cast("string"),
        "finalization_reason",
        minutes("watermark_at_purge_ms"),
        minutes("window_end_ms"),
        minutes("allowed_lateness_ms"),
        minutes("finalization_latency_ms"),
        minutes("latency_reduction_ms"),
    )
    return final_only(emissions).select(*KEY, line.alias("line"))
