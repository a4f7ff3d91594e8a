"""CPU, memory and garbage-collection samples of runs, and run comparison.

Metric tables have ``experiment, ts_ms, cpu_percent`` and a memory column: one
row per experiment and second at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from finality.config import BASELINE, MODES, PROPOSED
from finality.functions.frames import centred_mean, previous, with_extremes
from finality.functions.labels import percent_change, percent_saving, probe_mode, probe_stage, safe_div
from finality.session import only_row

# Memory columns in order of preference.
MEMORY_COLUMNS = ("rss_mib", "memory_used_mib", "heap_used_mib")

STATISTICS = {
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "mean": F.avg,
    "p95": lambda c: F.percentile(c, F.lit(0.95)),
    "max": F.max,
}


def memory_column(metrics: DataFrame) -> str:
    for name in MEMORY_COLUMNS:
        if name in metrics.columns:
            return name
    raise ValueError(f"metrics need one of: {', '.join(MEMORY_COLUMNS)}")


def resource_series(
    metrics: DataFrame, drop_first_sec: float = 0.0, positive_only: bool = False
) -> DataFrame:
    """Samples with ``memory``, elapsed time and share of the run.

    The warm-up is cut first and time then starts at the first sample left.
    """
    memory = memory_column(metrics)
    rows = metrics.withColumn("memory", F.col(memory).cast("double")).dropna(
        subset=["ts_ms", "cpu_percent", "memory"]
    )
    if positive_only:
        rows = rows.filter("cpu_percent > 0 AND memory > 0")
    if drop_first_sec > 0:
        rows = (
            with_extremes(rows, ["experiment"], {"_start": F.min("ts_ms")})
            .filter((F.col("ts_ms") - F.col("_start")) / 1000.0 >= drop_first_sec)
            .drop("_start")
        )
    rows = with_extremes(rows, ["experiment"], {"_first": F.min("ts_ms"), "_last": F.max("ts_ms")})
    elapsed = (F.col("ts_ms") - F.col("_first")) / 1000.0
    longest = (F.col("_last") - F.col("_first")) / 1000.0
    return rows.withColumns(
        {
            "elapsed_sec": elapsed,
            "elapsed_min": elapsed / 60.0,
            "runtime_percent": F.when(longest > 0, elapsed / longest * 100.0).otherwise(0.0),
        }
    ).drop("_first", "_last")


def _bucket(bucket_sec: int) -> Column:
    return F.floor(F.col("elapsed_sec") / bucket_sec).cast("int")


def cpu_buckets(series: DataFrame, bucket_sec: int) -> DataFrame:
    """CPU median and quartiles per time bucket."""
    return series.groupBy("experiment", _bucket(bucket_sec).alias("bucket")).agg(
        F.avg("elapsed_min").alias("elapsed_min"),
        *[
            F.percentile("cpu_percent", F.lit(share)).alias(f"cpu_{name}")
            for name, share in (("median", 0.5), ("p95", 0.95), ("p25", 0.25), ("p75", 0.75))
        ],
        F.count("*").alias("samples"),
    )


def memory_buckets(series: DataFrame, bucket_sec: int) -> DataFrame:
    """Memory mean, maximum and p95 per time bucket."""
    return series.groupBy("experiment", _bucket(bucket_sec).alias("bucket")).agg(
        F.avg("elapsed_min").alias("elapsed_min"),
        F.avg("memory").alias("memory_mean"),
        F.max("memory").alias("memory_max"),
        F.percentile("memory", F.lit(0.95)).alias("memory_p95"),
        F.count("*").alias("samples"),
    )


def runtime_bins(
    series: DataFrame, bin_percent: float = 5.0, cpu: str = "mean", memory: str = "mean"
) -> DataFrame:
    """Chosen CPU and memory statistic per share of the run, at most 100 %."""
    if bin_percent <= 0:
        raise ValueError("bin_percent must be positive")
    bin_start = F.least(
        F.floor(F.col("runtime_percent") / bin_percent) * bin_percent, F.lit(100.0)
    ).cast("double")
    return series.groupBy("experiment", bin_start.alias("runtime_percent")).agg(
        STATISTICS[cpu]("cpu_percent").alias("cpu_usage"),
        STATISTICS[memory]("memory").alias("memory_usage_mib"),
        F.count("*").alias("samples"),
    )


def system_summary(series: DataFrame) -> DataFrame:
    """Run time, CPU and memory mean, p95 and peak per experiment."""
    out = [
        ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0).alias("runtime_sec"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 60_000.0).alias("runtime_min"),
        F.avg("cpu_percent").alias("cpu_mean_percent"),
        F.percentile("cpu_percent", F.lit(0.95)).alias("cpu_p95_percent"),
        F.max("cpu_percent").alias("cpu_peak_percent"),
        F.avg("memory").alias("memory_mean_mib"),
        F.percentile("memory", F.lit(0.95)).alias("memory_p95_mib"),
        F.max("memory").alias("memory_peak_mib"),
        F.count("*").alias("system_samples"),
    ]
    for name in ("memory_percent", "threads"):
        if name in series.columns:
            out.append(F.percentile(name, F.lit(0.95)).alias(f"{name}_p95"))
    return series.groupBy("experiment").agg(*out)


def performance_comparison(summary: DataFrame, proposed: str = PROPOSED) -> DataFrame:
    """Savings and changes of one experiment against every other.

    ``summary`` joins the system summary with the probe totals.
    """
    measures = [
        "cpu_mean_percent",
        "cpu_p95_percent",
        "cpu_peak_percent",
        "memory_mean_mib",
        "memory_p95_mib",
        "memory_peak_mib",
        "runtime_sec",
        "source_throughput_weighted_eps",
        "output_emission_rate_weighted_eps",
    ]
    mine = summary.filter(F.col("experiment") == proposed).select(
        *[F.col(m).alias(f"proposed_{m}") for m in measures]
    )
    rows = summary.filter(F.col("experiment") != proposed).crossJoin(F.broadcast(only_row(mine, f"summary of {proposed}")))

    def saving(measure: str, unit: str) -> Column:
        return percent_saving(F.col(f"{measure}_{unit}"), F.col(f"proposed_{measure}_{unit}")).alias(
            f"{measure}_saving_percent"
        )

    def change(measure: str, name: str) -> Column:
        return percent_change(F.col(f"proposed_{measure}"), F.col(measure)).alias(
            f"{name}_change_percent"
        )

    shown = [
        "cpu_mean_percent",
        "memory_mean_mib",
        "runtime_sec",
        "source_throughput_weighted_eps",
        "output_emission_rate_weighted_eps",
    ]
    return rows.select(
        F.concat(F.lit(f"{proposed} vs "), "experiment").alias("comparison"),
        F.col("experiment").alias("reference_experiment"),
        F.lit(proposed).alias("proposed_experiment"),
        *[saving(f"cpu_{s}", "percent") for s in ("mean", "p95", "peak")],
        *[saving(f"memory_{s}", "mib") for s in ("mean", "p95", "peak")],
        (F.col("proposed_runtime_sec") - F.col("runtime_sec")).alias("runtime_change_sec"),
        change("runtime_sec", "runtime"),
        change("source_throughput_weighted_eps", "source_throughput"),
        change("output_emission_rate_weighted_eps", "output_emission_rate"),
        *[F.col(f"proposed_{m}") for m in shown],
        *[F.col(m).alias(f"reference_{m}") for m in shown],
    )


def rolling_mean(series: DataFrame, column: str, samples: int = 30) -> DataFrame:
    """Centred rolling mean; an even window reaches one sample further back."""
    return centred_mean(
        series, ["experiment"], "ts_ms", column, samples // 2, (samples - 1) // 2, f"{column}_smooth"
    )


def progress(series: DataFrame) -> DataFrame:
    """Share of the run in percent, 0 when the run has no length."""
    rows = with_extremes(
        series, ["experiment"], {"_first": F.min("elapsed_sec"), "_last": F.max("elapsed_sec")}
    )
    first, last = F.col("_first"), F.col("_last")
    return rows.withColumn(
        "progress_pct",
        F.when(last > first, (F.col("elapsed_sec") - first) / (last - first) * 100.0).otherwise(0.0),
    ).drop("_first", "_last")


def sampling_interval(series: DataFrame) -> DataFrame:
    """Median time between samples of an experiment in seconds."""
    return (
        previous(series, ["experiment"], "ts_ms", "_previous")
        .withColumn("gap", (F.col("ts_ms") - F.col("_previous")) / 1000.0)
        .groupBy("experiment")
        .agg(F.percentile("gap", F.lit(0.5)).alias("median_interval_sec"))
    )


# --------------------------------------------------------------------- gc


def gc_series(events: DataFrame, drop_first_sec: float = 0.0) -> DataFrame:
    """Pauses with elapsed time and recovered memory per experiment."""
    rows = with_extremes(events, ["experiment"], {"_first": F.min("ts_ms")})
    rows = rows.withColumn("elapsed_sec", (F.col("ts_ms") - F.col("_first")) / 1000.0).drop("_first")
    if drop_first_sec > 0:
        rows = rows.filter(F.col("elapsed_sec") >= drop_first_sec)
        rows = with_extremes(rows, ["experiment"], {"_first": F.min("elapsed_sec")})
        rows = rows.withColumn("elapsed_sec", F.col("elapsed_sec") - F.col("_first")).drop("_first")
    return rows.withColumn("recovered_mb", F.col("before_mb") - F.col("after_mb"))


def gc_summary(series: DataFrame) -> DataFrame:
    minutes = F.greatest((F.max("elapsed_sec") - F.min("elapsed_sec")) / 60.0, F.lit(1e-9))
    return series.groupBy("experiment").agg(
        F.count("*").alias("gc_events"),
        (F.count("*") / minutes).alias("gc_events_per_min"),
        F.sum("duration_ms").alias("gc_total_pause_ms"),
        F.percentile("duration_ms", F.lit(0.95)).alias("gc_p95_pause_ms"),
        F.max("duration_ms").alias("gc_max_pause_ms"),
        F.count_if(F.col("type") == "Full").alias("full_gc_events"),
        F.count_if(F.col("type") == "Young").alias("young_gc_events"),
    )


def gc_per_minute(series: DataFrame) -> DataFrame:
    return series.groupBy(
        "experiment", F.floor(F.col("elapsed_sec") / 60).cast("int").alias("minute")
    ).agg(F.count("*").alias("gc_events"))


# ------------------------------------------------------------ metric table


# Rows of the metric table by category. Metric, column of the summary, unit, whether lower is better.
METRICS = {
    "system": [
        ("duration_sec", "runtime_sec", "sec", True),
        ("cpu_mean", "cpu_mean_percent", "%", True),
        ("cpu_p95", "cpu_p95_percent", "%", True),
        ("memory_mean", "memory_mean_mib", "MiB", True),
        ("memory_p95", "memory_p95_mib", "MiB", True),
        ("memory_max", "memory_peak_mib", "MiB", True),
    ],
    "gc": [
        ("gc_events_per_min", "gc_events_per_min", "events/min", True),
        ("gc_total_pause_ms", "gc_total_pause_ms", "ms", True),
        ("gc_p95_pause_ms", "gc_p95_pause_ms", "ms", True),
        ("full_gc_events", "full_gc_events", "count", True),
    ],
    "finalization": [
        ("finalization_samples", "finalized_windows", "count", False),
        ("finalization_latency_mean_min", "finalization_latency_mean_min", "min", True),
        ("finalization_latency_p95_min", "finalization_latency_p95_min", "min", True),
        ("latency_reduction_mean_min", "latency_reduction_mean_min", "min", False),
        ("latency_reduction_p95_min", "latency_reduction_p95_min", "min", False),
        ("latency_reduction_mean_ratio", "latency_reduction_mean_ratio", "ratio", False),
    ],
}
_LONG = ("category", "metric", "unit", "lower_is_better")


def metric_rows(summary: DataFrame, category: str, metrics: list[tuple] | None = None) -> DataFrame:
    """A summary with a row per ``experiment`` as one row per experiment and metric."""
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(unit).alias("unit"),
            F.lit(lower).alias("lower_is_better"),
            F.col(column).cast("double").alias("value"),
        )
        for metric, column, unit, lower in metrics or METRICS[category]
    ]
    return summary.select(F.lit(category).alias("category"), "experiment", F.inline(F.array(*rows)))


def throughput_rows(samples: DataFrame) -> DataFrame:
    """Weighted rate and 95th percentile per stage; a probe without mode counts for its experiment."""
    mode = probe_mode(F.col("probe"))
    staged = samples.dropna(subset=["count_in_interval", "events_per_second", "interval_ms"]).select(
        F.when(mode == "unknown", F.col("experiment")).otherwise(mode).alias("experiment"),
        F.replace(probe_stage(F.col("probe")), F.lit("-"), F.lit("_")).alias("stage"),
        "count_in_interval",
        "events_per_second",
        "interval_ms",
    )
    rates = staged.groupBy("experiment", "stage").agg(
        safe_div(F.sum("count_in_interval"), F.sum("interval_ms") / 1000.0).alias("weighted"),
        F.percentile("events_per_second", F.lit(0.95)).alias("p95"),
    )
    named = [
        F.struct(
            F.concat(F.lit("throughput_"), "stage", F.lit(f"_{name}_eps")).alias("metric"),
            F.lit("events/sec").alias("unit"),
            F.lit(False).alias("lower_is_better"),
            F.col(name).alias("value"),
        )
        for name in ("weighted", "p95")
    ]
    return rates.select(F.lit("throughput").alias("category"), "experiment", F.inline(F.array(*named)))


def by_mode(rows: DataFrame) -> DataFrame:
    """One row per metric, one column per mode, and the change from the baseline.

    The change in percent is null when the baseline is zero, both are null when
    one of the two modes is missing. Values that aren't finite are taken for missing.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    wide = (
        rows.withColumn("value", finite)
        .groupBy(*_LONG)
        .pivot("experiment", list(MODES))
        .agg(F.first("value", ignorenulls=True))
    )
    delta = F.col(PROPOSED) - F.col(BASELINE)
    return wide.select(
        *_LONG,
        *MODES,
        delta.alias("delta_proposed_vs_baseline"),
        (F.try_divide(delta, F.col(BASELINE)) * 100.0).alias("delta_pct_proposed_vs_baseline"),
    )


def metric_table(summary: DataFrame, category: str, metrics: dict[str, str]) -> DataFrame:
    """Metrics of one category by mode; ``metrics`` maps a column of the summary to its unit."""
    rows = metric_rows(summary, category, [(name, name, unit, True) for name, unit in metrics.items()])
    return by_mode(rows).drop("lower_is_better")


def full_metric_table(
    system: DataFrame | None = None,
    pauses: DataFrame | None = None,
    samples: DataFrame | None = None,
    finalization: DataFrame | None = None,
) -> DataFrame:
    """All categories in one table, from summaries whose ``experiment`` is a mode.

    ``system`` is a ``system_summary``, ``pauses`` a ``gc_summary``, ``samples`` are rates of
    probes, ``finalization`` is a ``latency_summary``, of which only the proposed
    mode counts. A category that isn't given has no rows.
    """
    parts = []
    if system is not None:
        parts.append(metric_rows(system, "system"))
    if pauses is not None:
        parts.append(metric_rows(pauses, "gc"))
    if samples is not None:
        parts.append(throughput_rows(samples))
    if finalization is not None:
        parts.append(metric_rows(finalization.filter(F.col("experiment") == PROPOSED), "finalization"))
    if not parts:
        raise ValueError("the metric table needs at least one category")
    return by_mode(reduce(DataFrame.unionByName, parts))
