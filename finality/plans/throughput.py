"""Throughput samples: probes, summaries, stage ratios.

Sample tables have ``ts_ms, probe, count_in_interval, events_per_second,
interval_ms``: at most one row per probe and second of a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from finality.functions.frames import numbered, with_extremes
from finality.functions.labels import (
    method_label,
    method_order,
    probe_mode,
    probe_stage,
    safe_div,
    stage_label,
)

_CHUNK_MS = 3_600_000
_FAN_BITS = 8
_SAMPLE = (
    "probe string, ts_ms bigint, count_in_interval bigint, interval_ms bigint"
)


# ------------------------------------------------------------------- probes


def probe_counts(
    rows: DataFrame, probe: str, clock_ms: str, weight: str | None = None
) -> DataFrame:
    """Records per millisecond at one point of the job; ``weight`` counts folded rows."""
    return (
        rows.groupBy(F.col(clock_ms).alias("ms"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"))
        .select(F.lit(probe).alias("probe"), "ms", "n")
    )


def tumbling_samples(counts: DataFrame, interval_ms: int) -> DataFrame:
    """One sample per probe and fixed interval that saw a record."""
    start = F.col("ms") - F.pmod("ms", F.lit(interval_ms))
    return (
        counts.groupBy("probe", (start + interval_ms).alias("ts_ms"))
        .agg(F.sum("n").alias("count_in_interval"))
        .select(
            "probe",
            "ts_ms",
            "count_in_interval",
            (F.col("count_in_interval") / (interval_ms / 1000.0)).alias("events_per_second"),
            F.lit(interval_ms).cast("bigint").alias("interval_ms"),
        )
    )


def _steps(enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ways with the same exit as one step, named by the last way in."""
    last = np.append(leave[1:] != leave[:-1], True)[: len(leave)]
    return enter[last], leave[last]


def _exits(key, rows: pd.DataFrame, interval_ms: int, chunk_ms: int) -> pd.DataFrame:
    """Where a chain of intervals leaves this chunk, for every way to enter it."""
    probe, chunk = key
    ms = np.sort(rows["ms"].to_numpy())
    last = np.searchsorted(ms, ms + interval_ms)
    last = np.where(last < len(ms), last, np.arange(len(ms)))
    while (last[last] != last).any():
        last = last[last]
    ways = int(np.searchsorted(ms, chunk * chunk_ms + interval_ms)) + 1
    enter, leave = _steps(ms[:ways], ms[last[:ways]])
    return pd.DataFrame({"probe": probe, "chunk": chunk, "enter_ms": enter, "exit_ms": leave})


def _maps(rows: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Steps of each chunk, in order."""
    rows = rows.sort_values(["chunk", "enter_ms"])
    chunk, enter, leave = (rows[c].to_numpy() for c in ("chunk", "enter_ms", "exit_ms"))
    edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
    return [(int(chunk[a]), enter[a:b], leave[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _composed(key, rows: pd.DataFrame, interval_ms: int) -> pd.DataFrame:
    """The chunks of a group as one: its ways in are those of the first chunk, and the next one for a chain that passes it by."""
    probe, group = key
    maps = _maps(rows)
    enter, at = maps[0][1], maps[0][2]
    for i, (_, ways, leave) in enumerate(maps[1:]):
        found = np.searchsorted(ways, at + interval_ms)
        at = np.where(found < len(ways), leave[np.minimum(found, len(ways) - 1)], at)
        if i == 0:
            enter, at = np.append(enter, ways[0]), np.append(at, leave[0])
    enter, at = _steps(enter, at)
    return pd.DataFrame({"probe": probe, "chunk": group, "enter_ms": enter, "exit_ms": at})


def _opened(rows: pd.DataFrame, interval_ms: int) -> pd.DataFrame:
    """The interval that is open when each chunk of a group begins; ``open_ms`` of the group comes with its rows."""
    opened = rows["open_ms"].iloc[0]
    start, out = None if pd.isna(opened) else int(opened), []
    for chunk, ways, leave in _maps(rows):
        out.append((rows["probe"].iloc[0], chunk, start))
        at = 0 if start is None else int(np.searchsorted(ways, start + interval_ms))
        if at < len(ways):
            start = int(leave[at])
    return pd.DataFrame(out, columns=["probe", "chunk", "open_ms"]).astype({"open_ms": "Int64"})


def _spans(rows: pd.DataFrame, interval_ms: int) -> pd.DataFrame:
    """Records per interval within one chunk and the start of the next one; the first may have begun earlier."""
    rows = rows.sort_values("ms")
    ms, n = rows["ms"].to_numpy(), rows["n"].to_numpy()
    opened = rows["open_ms"].iloc[0]
    starts = [] if pd.isna(opened) else [int(opened)]
    follow = np.searchsorted(ms, ms + interval_ms)
    at = int(np.searchsorted(ms, starts[0] + interval_ms)) if starts else 0
    while at < len(ms):
        starts.append(int(ms[at]))
        at = int(follow[at])
    owner = np.searchsorted(np.array(starts), ms, side="right") - 1
    counts = np.bincount(owner, weights=n, minlength=len(starts)).astype("int64")
    first = np.zeros(len(starts), dtype=np.int64)
    first[0] = pd.isna(opened)
    follower = pd.array([*starts[1:], None], dtype="Int64")
    return pd.DataFrame({"probe": rows["probe"].iloc[0], "start_ms": starts, "n": counts, "ts_ms": follower, "first": first})


def chained_samples(counts: DataFrame, interval_ms: int = 1000) -> DataFrame:
    """Intervals that close at the first record at least ``interval_ms`` after
    their start, where the next one starts.

    The chain is sequential, but a chunk of time, no shorter than two intervals,
    is a step function: the interval that is open when it begins decides the one
    that is open when it ends. Functions of 256 chunks are composed to one, twice;
    the open interval is then handed down from the groups to their chunks, which are
    worked through side by side. No group grows with the length of the run. The
    last, open interval gives no sample; the record that closes an interval is
    counted in it.
    """
    chunk_ms = max(_CHUNK_MS, 2 * interval_ms)
    schema = "probe string, chunk bigint, enter_ms bigint, exit_ms bigint"
    opens = "probe string, chunk bigint, open_ms bigint"
    chunks = counts.withColumn("chunk", F.floor(F.col("ms") / chunk_ms).cast("bigint"))
    levels = [
        chunks.groupBy("probe", "chunk").applyInPandas(
            lambda key, rows: _exits(key, rows, interval_ms, chunk_ms), schema
        )
    ]
    for _ in range(2):
        parent = F.shiftright("chunk", _FAN_BITS).alias("parent")
        levels.append(
            levels[-1].groupBy("probe", parent).applyInPandas(
                lambda key, rows: _composed(key, rows, interval_ms), schema
            )
        )
    path = (
        levels.pop()
        .withColumn("open_ms", F.lit(None).cast("bigint"))
        .groupBy("probe")
        .applyInPandas(lambda rows: _opened(rows, interval_ms), opens)
    )
    for level in reversed(levels):
        path = (
            level.withColumn("parent", F.shiftright("chunk", _FAN_BITS))
            .join(path.withColumnRenamed("chunk", "parent"), ["probe", "parent"])
            .groupBy("probe", "parent")
            .applyInPandas(lambda rows: _opened(rows, interval_ms), opens)
        )
    return (
        chunks.join(path, ["probe", "chunk"])
        .groupBy("probe", "chunk")
        .applyInPandas(
            lambda rows: _spans(rows, interval_ms),
            "probe string, start_ms bigint, n bigint, ts_ms bigint, first bigint",
        )
        .groupBy("probe", "start_ms")
        .agg((F.sum("n") + F.max("first")).alias("n"), F.max("ts_ms").alias("ts_ms"))
        .filter("ts_ms IS NOT NULL")
        .select(
            "probe",
            "ts_ms",
            F.col("n").alias("count_in_interval"),
            F.round(F.col("n") / ((F.col("ts_ms") - F.col("start_ms")) / 1000.0), 3).alias("events_per_second"),
            (F.col("ts_ms") - F.col("start_ms")).alias("interval_ms"),
        )
    )


# ---------------------------------------------------------------- summaries


def _percentiles(column: str, suffix: str, shares: dict[str, float]) -> list[Column]:
    return [
        F.percentile(column, F.lit(share)).alias(f"{name}_{suffix}")
        for name, share in shares.items()
    ]


def usable_samples(samples: DataFrame, min_interval_ms: int = 1) -> DataFrame:
    """Samples with a probe name, all numbers and a long enough interval."""
    return samples.filter(
        (F.trim("probe") != "")
        & F.col("count_in_interval").isNotNull()
        & F.col("events_per_second").isNotNull()
        & (F.col("interval_ms") >= min_interval_ms)
    )


def drop_warmup(samples: DataFrame, by: list[str], first: int) -> DataFrame:
    """Number the samples of each group in time order and leave out the first ones."""
    return (
        numbered(samples, by, ["ts_ms", "count_in_interval"], "sample_index")
        .filter(F.col("sample_index") > first)
        .withColumn("sample_index", F.col("sample_index") - first)
    )


def probe_summary(samples: DataFrame) -> DataFrame:
    """Throughput per mode, stage and probe, with the sample deviation."""
    rate = F.col("events_per_second")
    seconds = F.sum("interval_ms") / 1000.0
    deviation = F.coalesce(F.stddev_samp(rate), F.lit(0.0))
    return (
        samples.withColumns({"mode": probe_mode(F.col("probe")), "stage": probe_stage(F.col("probe"))})
        .groupBy("mode", "stage", "probe")
        .agg(
            F.count("*").alias("samples"),
            F.sum("count_in_interval").alias("total_events"),
            seconds.alias("total_interval_sec"),
            safe_div(F.sum("count_in_interval"), seconds).alias("weighted_avg_eps"),
            F.avg(rate).alias("mean_eps"),
            F.min(rate).alias("min_eps"),
            *_percentiles(
                "events_per_second",
                "eps",
                {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95},
            ),
            F.max(rate).alias("max_eps"),
            deviation.alias("stddev_eps"),
            safe_div(deviation * 100.0, F.avg(rate)).alias("cv_percent"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
    )


def stage_ratio(summary: DataFrame) -> DataFrame:
    """Rate after windowing over rate after parsing, per mode."""

    def rate(stage: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col("weighted_avg_eps")))

    return (
        summary.groupBy("mode")
        .agg(
            rate("source_after_parse").alias("source_eps"),
            rate("post_window_aggregation").alias("post_window_eps"),
        )
        .filter("source_eps > 0 AND post_window_eps IS NOT NULL")
        .withColumn("ratio", F.col("post_window_eps") / F.col("source_eps"))
    )


def with_stages(samples: DataFrame, drop_first: int = 0) -> DataFrame:
    """Samples with stage, elapsed time and share of the run per experiment and stage.

    Needs ``experiment, method_key, time_setting``.
    """
    staged = samples.filter("interval_ms > 0").withColumn("stage", stage_label(F.col("probe")))
    staged = drop_warmup(staged, ["experiment", "stage"], drop_first)
    staged = with_extremes(
        staged, ["experiment", "stage"], {"_first": F.min("ts_ms"), "_last": F.max("ts_ms")}
    )
    elapsed = (F.col("ts_ms") - F.col("_first")) / 1000.0
    longest = (F.col("_last") - F.col("_first")) / 1000.0
    return staged.withColumns(
        {
            "method_label": method_label(F.col("method_key")),
            "elapsed_sec": elapsed,
            "elapsed_min": elapsed / 60.0,
            "runtime_percent": elapsed / F.when(longest > 0, longest).otherwise(1.0) * 100.0,
        }
    ).drop("_first", "_last")


def stage_summary(staged: DataFrame) -> DataFrame:
    """Throughput per experiment and stage, with the population deviation."""
    rate = F.col("events_per_second")
    seconds = F.sum("interval_ms") / 1000.0
    return staged.groupBy("method_key", "method_label", "experiment", "time_setting", "stage").agg(
        F.min_by("probe", "ts_ms").alias("probe"),
        F.count("*").alias("samples"),
        F.sum("count_in_interval").alias("total_events"),
        F.max("elapsed_sec").alias("duration_sec"),
        (F.max("elapsed_sec") / 60.0).alias("duration_min"),
        seconds.alias("total_interval_sec"),
        safe_div(F.sum("count_in_interval"), seconds).alias("weighted_avg_events_per_sec"),
        F.avg(rate).alias("mean_events_per_sec"),
        *_percentiles(
            "events_per_second",
            "events_per_sec",
            {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99},
        ),
        F.min(rate).alias("min_events_per_sec"),
        F.max(rate).alias("max_events_per_sec"),
        F.stddev_pop(rate).alias("std_events_per_sec"),
        safe_div(F.stddev_pop(rate), F.avg(rate)).alias("cv_events_per_sec"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )


def overall(stages: DataFrame, reference: str = "baseline", proposed: str = "proposed") -> DataFrame:
    """Source against post-filter per experiment, compared with two methods."""
    keys = ["method_key", "method_label", "experiment", "time_setting"]
    measures = ["total_events", "duration_min", "weighted_avg_events_per_sec"]
    more = ["median_events_per_sec", "p95_events_per_sec", "p99_events_per_sec", "cv_events_per_sec"]

    def of_stage(stage: str, prefix: str, names: list[str]) -> list[Column]:
        return [
            F.max(F.when(F.col("stage") == stage, F.col(m))).alias(f"{prefix}_{m}") for m in names
        ]

    rows = (
        stages.groupBy(*keys)
        .agg(
            *of_stage("Source", "source", measures),
            *of_stage("Post-filter", "post_filter", measures + more),
        )
        .filter("source_total_events IS NOT NULL AND post_filter_total_events IS NOT NULL")
        .withColumn(
            "post_filter_source_event_ratio_pct",
            F.col("post_filter_total_events") / F.col("source_total_events") * 100.0,
        )
    )
    runtime, rate = F.col("post_filter_duration_min"), F.col("post_filter_weighted_avg_events_per_sec")
    everything = Window.partitionBy(F.lit(0))
    relative = {}
    for method in dict.fromkeys((reference, proposed)):
        name = F.when(F.col("method_key") == method, F.col("experiment"))
        base_runtime = F.min_by(runtime, name).over(everything)
        base_rate = F.min_by(rate, name).over(everything)
        relative[f"runtime_vs_{method}_pct"] = (F.try_divide(runtime, base_runtime) - 1) * 100
        relative[f"post_filter_eps_vs_{method}_pct"] = (F.try_divide(rate, base_rate) - 1) * 100
        if method == reference:
            relative[f"speedup_vs_{method}_pct"] = (F.try_divide(base_runtime, runtime) - 1) * 100
    return (
        rows.withColumns(relative)
        .withColumn("method_order", method_order(F.col("method_key")))
        .orderBy("method_order", "experiment")
    )


def ranking(overall_rows: DataFrame) -> DataFrame:
    return overall_rows.orderBy(F.desc("post_filter_weighted_avg_events_per_sec"), "experiment")


def _bucket(bin_sec: float) -> Column:
    if bin_sec <= 0:
        raise ValueError("bin_sec must be positive")
    return (F.floor(F.col("elapsed_sec") / bin_sec) * bin_sec).cast("double")


def runtime_curve(staged: DataFrame, bin_sec: float = 5.0) -> DataFrame:
    """Rates per time bucket since the start of a stage."""
    return staged.groupBy(
        "method_key", "method_label", "experiment", "stage", _bucket(bin_sec).alias("elapsed_bucket_sec")
    ).agg(
        F.avg("elapsed_sec").alias("elapsed_sec"),
        F.avg("elapsed_min").alias("elapsed_min"),
        F.avg("runtime_percent").alias("runtime_percent"),
        F.avg("events_per_second").alias("mean_events_per_sec"),
        F.percentile("events_per_second", F.lit(0.5)).alias("median_events_per_sec"),
        F.percentile("events_per_second", F.lit(0.95)).alias("p95_events_per_sec"),
        F.count("*").alias("samples"),
    )


# -------------------------------------------------------------- nearest pairs


def nearest_source(staged: DataFrame, tolerance_ms: int = 1500) -> DataFrame:
    """Pair each post-filter sample with the nearest source sample in time.

    Only source samples within the tolerance matter, so time is cut into hours
    and source samples near an edge are put on both sides of it. At equal
    distance the earlier sample wins, among equal times the last one looking
    back and the first one looking ahead.
    """
    if tolerance_ms <= 0:
        raise ValueError("tolerance_ms must be positive")
    hour = max(_CHUNK_MS, 2 * tolerance_ms)
    columns = ["ts_ms", "events_per_second", "count_in_interval", "elapsed_sec"]
    keys = ["method_key", "method_label", "experiment"]
    post = staged.filter("stage = 'Post-filter'").select(
        *keys,
        *columns,
        F.floor(F.col("ts_ms") / hour).alias("hour"),
        F.lit(None).cast("struct<ts_ms:bigint,rate:double,n:bigint>").alias("source"),
        F.lit(True).alias("is_post"),
    )
    first, last = (F.floor((F.col("ts_ms") + d) / hour) for d in (-tolerance_ms, tolerance_ms))
    source = staged.filter("stage = 'Source'").select(
        *keys,
        *columns,
        F.explode(F.sequence(first, last)).alias("hour"),
        F.struct(
            F.col("ts_ms"), F.col("events_per_second").alias("rate"), F.col("count_in_interval").alias("n")
        ).alias("source"),
        F.lit(False).alias("is_post"),
    )
    part = ["experiment", "hour"]
    ties = ["count_in_interval", "events_per_second"]
    back = Window.partitionBy(*part).orderBy("ts_ms", "is_post", *ties)
    ahead = Window.partitionBy(*part).orderBy("ts_ms", F.desc("is_post"), *ties)
    both = post.unionByName(source).withColumns(
        {
            "back": F.last("source", ignorenulls=True).over(
                back.rowsBetween(Window.unboundedPreceding, 0)
            ),
            "ahead": F.first("source", ignorenulls=True).over(
                ahead.rowsBetween(0, Window.unboundedFollowing)
            ),
        }
    )
    behind = F.col("ts_ms") - F.col("back.ts_ms")
    before = F.col("ahead.ts_ms") - F.col("ts_ms")
    pick = F.when(
        F.col("ahead").isNull() | (behind <= before), F.col("back")
    ).otherwise(F.col("ahead"))
    return (
        both.filter("is_post")
        .withColumn("source", pick)
        .filter(F.abs(F.col("ts_ms") - F.col("source.ts_ms")) <= tolerance_ms)
        .select(
            *keys,
            F.col("ts_ms").alias("post_filter_ts_ms"),
            F.col("source.ts_ms").alias("source_ts_ms"),
            (F.col("ts_ms") - F.col("source.ts_ms")).alias("timestamp_delta_ms"),
            "elapsed_sec",
            (F.col("elapsed_sec") / 60.0).alias("elapsed_min"),
            F.col("source.rate").alias("source_events_per_sec"),
            F.col("events_per_second").alias("post_filter_events_per_sec"),
            (F.col("events_per_second") / F.col("source.rate")).alias("throughput_ratio"),
            (1.0 - F.col("events_per_second") / F.col("source.rate")).alias("filter_drop_ratio"),
            F.col("source.n").alias("source_count"),
            F.col("count_in_interval").alias("post_filter_count"),
        )
    )


def ratio_summary(pairs: DataFrame) -> DataFrame:
    percent = F.col("throughput_ratio") * 100.0
    return (
        pairs.withColumn("pct", percent)
        .groupBy("method_key", "method_label", "experiment")
        .agg(
            F.count("*").alias("paired_samples"),
            F.avg("pct").alias("mean_ratio_pct"),
            F.percentile("pct", F.lit(0.5)).alias("median_ratio_pct"),
            F.percentile("pct", F.lit(0.05)).alias("p05_ratio_pct"),
            F.percentile("pct", F.lit(0.95)).alias("p95_ratio_pct"),
            F.min("pct").alias("min_ratio_pct"),
            F.max("pct").alias("max_ratio_pct"),
            F.avg(F.abs("timestamp_delta_ms")).alias("mean_abs_timestamp_delta_ms"),
        )
    )


def ratio_curve(pairs: DataFrame, bin_sec: float = 5.0) -> DataFrame:
    return pairs.groupBy(
        "method_key", "method_label", "experiment", _bucket(bin_sec).alias("elapsed_bucket_sec")
    ).agg(
        F.avg("elapsed_sec").alias("elapsed_sec"),
        F.avg("elapsed_min").alias("elapsed_min"),
        (F.avg("throughput_ratio") * 100.0).alias("mean_ratio_pct"),
        (F.percentile("throughput_ratio", F.lit(0.5)) * 100.0).alias("median_ratio_pct"),
        F.count("*").alias("samples"),
    )


def probe_totals(samples: DataFrame, by: list[str]) -> DataFrame:
    """Weighted, mean and p95 rate and total at two probes, null without samples."""
    out = []
    for part, prefix, total in (
        ("_source_after_parse", "source_throughput", "source_events_total"),
        ("_post_window_aggregation", "output_emission_rate", "output_emitted_events_total"),
    ):
        hit = F.col("probe").contains(part)
        rate = F.when(hit, F.col("events_per_second"))
        events = F.sum(F.when(hit, F.col("count_in_interval")))
        out += [
            F.try_divide(events * 1000.0, F.sum(F.when(hit, F.col("interval_ms")))).alias(
                f"{prefix}_weighted_eps"
            ),
            F.avg(rate).alias(f"{prefix}_mean_eps"),
            F.percentile(rate, F.lit(0.95)).alias(f"{prefix}_p95_eps"),
            events.alias(total),
        ]
    return samples.groupBy(*by).agg(*out)
