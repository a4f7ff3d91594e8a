"""Hand-worked cases of reports, profiles and metric tables."""

from __future__ import annotations

import dataclasses
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from finality.config import THREE_PHASE_LABEL, WindowSpec
from finality.functions import frames
from finality.plans import latency, lateness, reports, resources, throughput
from finality.plans.standins import SPARSE
from finality.session import only_row
from finality.sinks.writers import OUTPUT_COUNTS, csv_view

MIN = 60_000


def latencies(spark, minutes, allowed=None):
    rows = [("x", int(m * MIN), allowed) for m in minutes]
    return spark.createDataFrame(
        rows, "experiment string, finalization_latency_ms bigint, allowed_lateness_ms bigint"
    )


def test_histogram_edges(spark):
    rows = latency.latency_histogram(latencies(spark, [0, 5, 9.9, 10, 20], 20 * MIN), 10.0).collect()
    got = [(r.bin_start_min, r.bin_end_min, r.windows, r.cumulative_window_share) for r in rows]
    # the last bin is closed on the right
    assert got == [(0.0, 10.0, 3, 0.6), (10.0, 20.0, 2, 1.0)]
    capped = latency.latency_histogram(latencies(spark, [1, 2, 30], 5 * MIN), 10.0, max_minutes=10.0)
    assert [(r.bin_end_min, r.windows) for r in capped.collect()] == [(10.0, 2), (30.0, 1)]
    assert latency.latency_histogram(latencies(spark, []), 10.0).count() == 0
    with pytest.raises(ValueError):
        latency.latency_histogram(latencies(spark, [1]), 0)


def test_long_axis_is_laid_out_in_blocks(spark):
    """More bins than a block has, a latency before the axis, an empty stretch in between."""
    minutes = [-3.0, 0.0, 0.4, 4095.5, 4096.0, 9000.2, 9000.9]
    rows = latency.latency_histogram(latencies(spark, minutes), 1.0).collect()
    assert [r.bin_start_min for r in rows] == [float(b) for b in range(len(rows))]
    assert {r.bin_start_min: r.windows for r in rows if r.windows} == {0.0: 2, 4095.0: 1, 4096.0: 1, 9000.0: 2}
    assert rows[-1].cumulative_window_share == pytest.approx(6 / 7)


def test_quantiles_equal_those_of_one_array(spark):
    rng = random.Random(5)
    values = [rng.choice([0, 7, 70_000, rng.randrange(10**9), -rng.randrange(10**6)]) for _ in range(501)]
    table = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    shares = [0.0, 0.013, 0.25, 0.5, 0.951, 1.0]
    counted = frames.counted_values(table, {"v": F.col("v"), "twice": F.col("v") * 2})
    rows = frames.quantiles(counted, shares, 10.0).collect()
    found = {r.quantile: r.value for r in rows if r.measure == "v"}
    assert {r.quantile: r.value / 2 for r in rows if r.measure == "twice"} == pytest.approx(found, rel=1e-12)
    expected = np.quantile(np.array(values) / 10.0, shares)
    assert [found[s] for s in shares] == pytest.approx(list(expected), rel=1e-12)
    none = frames.counted_values(table.filter("v IS NULL"), {"v": F.col("v")})
    assert frames.quantiles(none, shares).count() == 0
    assert frames.quantile_row(none, {"x": ("v", 0.5)}).first().x is None


def test_blocks_with_a_halo_equal_one_window(spark, monkeypatch):
    """Small blocks, a group without key, pauses longer than blocks, nulls among the values."""
    monkeypatch.setattr(frames, "_POSITIONS", 16)
    monkeypatch.setattr(frames, "_BLOCK_BITS", 12)
    rng, rows = random.Random(8), []
    for run in ("a", "b", None):
        at = 0
        for _ in range(150):
            at += rng.choice([1_000, 1_000, 50_000])
            rows.append((run, at, rng.choice([None, float(rng.randrange(100))])))
    table = spark.createDataFrame(rows, "experiment string, ts_ms bigint, x double")
    run = Window.partitionBy("experiment").orderBy("ts_ms")
    plain = table.select(
        "*",
        F.round(F.avg("x").over(run.rowsBetween(-6, 5)), 9).alias("mean"),
        F.row_number().over(run).alias("at"),
        F.lag("ts_ms").over(run).alias("before"),
        F.min("x").over(Window.partitionBy("experiment")).alias("least"),
    )
    by = ["experiment"]
    found = frames.centred_mean(table, by, "ts_ms", "x", 6, 5, "mean").withColumn("mean", F.round("mean", 9))
    found = frames.previous(frames.numbered(found, by, ["ts_ms"], "at"), by, "ts_ms", "before")
    found = frames.with_extremes(found, by, {"least": F.min("x")})
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))


def test_latency_filters_and_reference(spark):
    rows = spark.createDataFrame(
        [("PROPOSED", "final", 1), ("proposed", "PURGE", 2), ("fast", "PRELIMINARY", 3), ("fast", "FINAL", None)],
        "mode string, result_type string, finalization_latency_ms bigint",
    )
    assert latency.final_or_purge(rows).count() == 3
    assert latency.select_rows(rows, "Proposed", "FINAL").count() == 1
    assert latency.select_rows(rows).count() == 3
    empty = latency.distribution_summary(latencies(spark, [])).first()
    assert (empty.windows, empty.immediate_windows, empty.immediate_ratio, empty.latency_std_min) == (0, 0, None, None)
    assert latency.distribution_summary(latencies(spark, [3])).first().latency_std_min is None
    summary = latency.distribution_summary(latencies(spark, [1, 2], 5 * MIN))
    assert summary.first().latency_std_min == pytest.approx(0.5**0.5)
    assert latency.reference_latency_min(summary) == 5.0
    assert latency.reference_latency_min(summary, 7.0) == 7.0
    with pytest.raises(ValueError):
        latency.reference_latency_min(summary.drop("allowed_lateness_max_min"))
    ratio = latency.latency_summary(
        latencies(spark, [0], 0).withColumn("latency_reduction_ms", F.lit(0).cast("bigint"))
    ).first()
    assert ratio.latency_reduction_mean_ratio is None


def arrivals(spark, rows):
    """``(day, meter, event second)`` in arrival order."""
    data = [(i, d, m, "s", t * 1000, (i + 1) * 1000) for i, (d, m, t) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "arrival_seq bigint, day string, meter_id string, series_id string, event_ms bigint, insert_ms bigint",
    )


def test_lateness_carries_over_days(spark):
    rows = arrivals(
        spark, [("d1", "a", 6000), ("d1", "b", 100), ("d2", "a", 5400), ("d2", "c", 1), ("d3", "a", 7000)]
    )
    days = {r.day: r for r in lateness.day_summary(rows, "per_meter", WindowSpec()).collect()}
    assert [days[d].late_records for d in ("d1", "d2", "d3")] == [0, 1, 0]
    assert [days[d].unique_keys for d in ("d1", "d2", "d3")] == [2, 3, 3]
    assert days["d2"].mean_lateness_min == 10.0 and days["d2"].max_min == 10.0
    # ten minutes fall into the bin from 6 to 12, half of one count reaches its middle
    assert days["d2"].p50_min == 9.0 and days["d1"].p50_min is None
    late = lateness.lateness(rows, "global", WindowSpec())
    assert late.filter("late_s IS NOT NULL").count() == 3


def test_histogram_percentiles(spark):
    bins = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(n).alias("n"), F.lit(u).alias("upto"))
                     for b, n, u in ((1, 2, 2), (3, 2, 4))])
    got = spark.range(1).select(
        *[lateness.bin_percentile(bins, F.lit(4), F.lit(float(q))) for q in (0, 25, 50, 75, 100)],
        lateness.bin_percentile(F.lit(None).cast(bins_type()), F.lit(None).cast("int"), F.lit(50.0)),
    ).first()
    assert list(got) == [0.0, 9.0, 12.0, 21.0, 24.0, None]
    assert spark.range(1).select(
        *[lateness.bin_index(F.lit(x)) for x in (-1.0, 0.0, 5.9, 6.0, 2999.0, 3000.0, 9e9)]
    ).first()[:] == (0, 0, 0, 1, 499, 499, 499)


def bins_type():
    return "array<struct<bin:int,n:int,upto:int>>"


def samples(spark, source, post):
    rows = [("m", "m", "e", "Source", t, 10.0, n, 0.0) for t, n in source]
    rows += [("m", "m", "e", "Post-filter", t, 5.0, n, 0.0) for t, n in post]
    return spark.createDataFrame(
        rows,
        "method_key string, method_label string, experiment string, stage string, ts_ms bigint, "
        "events_per_second double, count_in_interval bigint, elapsed_sec double",
    )


def test_nearest_pairs(spark):
    source = [(1000, 1), (3000, 2), (3000, 3), (9000, 4), (3_600_000, 5)]
    post = [(2000, 1), (3000, 2), (4000, 3), (6000, 4), (10_501, 5), (7_500, 6), (3_599_000, 7)]
    pairs = throughput.nearest_source(samples(spark, source, post), 1500).collect()
    got = {p.post_filter_ts_ms: p.source_count for p in pairs}
    # the earlier one at equal distance, the last of equal times looking back
    assert got == {2000: 1, 3000: 3, 4000: 3, 7500: 4, 3_599_000: 5}
    with pytest.raises(ValueError):
        throughput.nearest_source(samples(spark, source, post), 0)


def chain(counts, interval):
    """Intervals record by record."""
    out, start, count = [], None, 0
    for ms, n in counts:
        for _ in range(n):
            start = ms if start is None else start
            count += 1
            if ms - start >= interval:
                out.append((ms, count, ms - start))
                start, count = ms, 0
    return out


def test_chained_samples(spark):
    rng = random.Random(1)
    for gap in (400, 900_000, 5_000_000):
        at, counts = 10, []
        for _ in range(150):
            at += rng.randrange(1, gap)
            counts.append((at, rng.randrange(1, 4)))
        df = spark.createDataFrame([("p", *c) for c in counts], "probe string, ms bigint, n bigint")
        rows = throughput.chained_samples(df, 1000).orderBy("ts_ms").collect()
        assert [(r.ts_ms, r.count_in_interval, r.interval_ms) for r in rows] == chain(counts, 1000)


@pytest.mark.parametrize("chunk_ms, fan_bits", [(3_600_000, 8), (3_000, 1), (1, 2)])
def test_chained_samples_over_many_chunks(spark, monkeypatch, chunk_ms, fan_bits):
    monkeypatch.setattr(throughput, "_CHUNK_MS", chunk_ms)
    monkeypatch.setattr(throughput, "_FAN_BITS", fan_bits)
    rng, rows, expected = random.Random(2), [], {}
    for probe, gap in (("dense", 120), ("even", 1_500), ("sparse", 30_000)):
        at, counts = -40_000, []
        for _ in range(200):
            at += rng.randrange(1, gap)
            counts.append((at, rng.randrange(1, 4)))
        rows += [(probe, *c) for c in counts]
        expected[probe] = chain(counts, 1000)
    df = spark.createDataFrame(rows, "probe string, ms bigint, n bigint")
    got = throughput.chained_samples(df, 1000).orderBy("probe", "ts_ms").collect()
    for probe, samples_of in expected.items():
        assert [(r.ts_ms, r.count_in_interval, r.interval_ms) for r in got if r.probe == probe] == samples_of


def test_groups_of_chunks_stay_small():
    """A composed group has the ways of its first chunk and one more, however many chunks it has."""
    rows = pd.DataFrame([("p", c, c * 10_000 + w, c * 10_000 + 9_000 + w) for c in range(256) for w in range(5)], columns=["probe", "chunk", "enter_ms", "exit_ms"])
    assert len(throughput._composed(("p", 0), rows, 1000)) <= 6


def test_sample_filters(spark):
    df = spark.createDataFrame(
        [("fast_x", 1, 1.0, 1000), (" ", 1, 1.0, 1000), ("fast_x", None, 1.0, 1000), ("fast_x", 1, 1.0, 10)],
        "probe string, count_in_interval bigint, events_per_second double, interval_ms bigint",
    )
    assert throughput.usable_samples(df, 100).count() == 1


def test_progress_of_a_run_without_length(spark):
    df = spark.createDataFrame([("e", 5, 50.0, 10.0)], "experiment string, ts_ms bigint, cpu_percent double, heap_used_mib double")
    series = resources.progress(resources.resource_series(df))
    row = series.first()
    assert (row.progress_pct, row.runtime_percent, row.memory) == (0.0, 0.0, 10.0)
    assert resources.memory_column(df) == "heap_used_mib"
    with pytest.raises(ValueError):
        resources.memory_column(df.drop("heap_used_mib"))


def count_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "experiment string, mode string, meter_id string, series_id string, window_start_ms bigint, "
        "window_end_ms bigint, output_count int, early_purged boolean, final_count int, "
        "distinct_slot_count int, row_no int",
    )


def test_output_summary_sets_damage_apart(spark):
    table = count_rows(
        spark,
        [
            ("proposed", "P", "a", "Spänning L1", 0, 10, 2, True, 8, 8, 0),
            ("proposed", "P", "a", "Spänning L1", 0, 10, 7, False, 1, 1, 1),
            ("proposed", "P", "b", THREE_PHASE_LABEL, 0, 10, 1, True, 8, 8, 2),
            ("proposed", "P", "c", "Spänning L1", 0, 0, 3, False, 1, 1, 3),
            ("proposed", "P", "c", "Spänning L1", 0, 0, None, False, 1, 1, 4),
            ("lost", "P", "c", "Spänning L1", 0, 0, 4, False, 1, 1, 5),
        ],
    )
    summary = reports.with_coverage(reports.summarize_outputs(table, WindowSpec()))
    row = summary.filter("experiment = 'proposed'").first()
    assert (row.emitted_windows, row.duplicate_window_rows, row.invalid_window_rows) == (2, 1, 2)
    assert (row.invalid_unique_windows, row.missing_window_metadata_outputs) == (1, 3)
    # the three-phase window says early but is not complete
    assert (row.early_purged_windows, row.valid_window_outputs, row.total_outputs) == (1, 3, 6)
    assert row.reference_window_experiment == "proposed"
    lost = summary.filter("experiment = 'lost'").first()
    assert (lost.emitted_windows, lost.total_outputs, lost.mean_output_count) == (0, 4, 0.0)


def test_source_of_the_summary(spark):
    finals = spark.createDataFrame(
        [("x", "P", "a", "Spänning L1", 0, 10, 8, 0), ("x", "P", "b", "Spänning L1", 0, 10, 5, 1)],
        "experiment string, mode string, meter_id string, series_id string, window_start_ms bigint, "
        "window_end_ms bigint, count int, row_no int",
    )
    row = reports.outputs_of(None, finals, WindowSpec()).first()
    assert (row.emitted_windows, row.total_outputs, row.early_purged_windows) == (2, 3, 1)
    with pytest.raises(ValueError):
        reports.outputs_of(None, None, WindowSpec())


def test_dropped_ratio_matches_runs(spark):
    runs = spark.createDataFrame(
        [("FAST", "r1", 5), ("proposed", "r1", 2), ("proposed", "r2", 1)],
        "mode string, run_id string, dropped_records bigint",
    )
    totals = spark.createDataFrame(
        [("fast", "r1", 10), ("fast", "r1", 10), ("proposed", "r1", 0), ("proposed", "r2", 4)],
        "mode string, run_id string, post_filter_total_events bigint",
    )
    rows = reports.dropped_ratio(runs, totals).collect()
    assert [(r.method_label, r.dropped_record_ratio) for r in rows] == [("SW", 0.25), ("CBW", 0.25)]
    by_mode = reports.dropped_ratio(runs.drop("run_id"), totals.drop("run_id")).collect()
    assert [r.post_filter_total_events for r in by_mode] == [20, 4, 4]


def test_unknown_slots_are_minus_one_in_the_file(spark):
    table = spark.createDataFrame(
        [("FAST", "a", "s", 0, 1, 1, False, 2, None)],
        "mode string, meter_id string, series_id string, window_start_ms bigint, window_end_ms bigint, "
        "output_count int, early_purged_raw boolean, final_count int, distinct_slot_count int",
    )
    assert csv_view(table, OUTPUT_COUNTS).first().distinctSlotCount == -1


def test_faulty_windows_count_on_in_order(spark, folder):
    """Small blocks give the same running counts as one block."""
    from checks.queries import emissions

    rows = emissions(spark, folder, "alw")
    one = reports.faulty_windows(rows, SPARSE)
    many = reports.faulty_windows(rows, dataclasses.replace(SPARSE, block_bits=2))
    assert one.count() > 10 and one.exceptAll(many).isEmpty()


def test_only_row(spark):
    table = spark.createDataFrame([(1, None)], "a int, b string")
    assert [tuple(r) for r in only_row(table, "t").collect()] == [(1, None)]
    assert only_row(table.filter("false"), "t").collect() == []
    with pytest.raises(Exception, match="one row expected"):
        only_row(table.union(table), "t").collect()
