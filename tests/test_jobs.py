"""Whole jobs from raw files to result files, and the streaming form."""

from __future__ import annotations

import gzip
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row, functions as F

from finality.config import JobArgs, Policy, WindowSpec
from finality.operators.replay import finalize, place
from finality.plans.jobs import classification_job, window_job
from finality.plans.reports import faulty_windows, output_counts, outputs_of, outputs_of_folder
from finality.plans.standins import DAY_MS, SPARSE, readings
from finality.streaming.processor import (
    FLUSH_MS,
    WindowProcessor,
    closed_windows,
    counted_outputs,
    emissions_of,
    fired_windows,
    late_of,
)
from finality.operators.meters import lookup_of, route
from finality.sources import metrics
from finality.sources.lines import read_meter_ids, read_segments, stream_lines
from finality.sources.segments import SegmentStream, publish
from finality.streaming.job import (
    READINGS,
    BatchRates,
    faulty_batches,
    fired_from_store,
    rate_samples,
    routed,
    start_csv,
    start_parsing,
)
from test_sources import line, write_gz


@pytest.fixture
def raw(tmp_path):
    rng = random.Random(11)
    base = tmp_path / "raw"
    base.mkdir()
    for day in (16, 17):
        texts = []
        for n in range(120):
            hour, minute = n // 10 + (day - 16) * 12, n % 10 * 6
            late = rng.choice([0, 0, 3, 6])
            texts.append(
                line(
                    meter_id=f"m{rng.randrange(3)}",
                    series_id=rng.choice(["Spänning L1", "Spänning L2", "Ström L1"]),
                    time=f"2025-04-16 {max(hour - late, 0):02d}:{minute:02d}:00",
                    value=rng.choice(["0.0", "230.1"]),
                    insert_time=f"2025-04-16 {hour:02d}:{minute:02d}:30",
                )
            )
        write_gz(base / f"raw_meter_data.log-202504{day}.gz", texts)
    (tmp_path / "single.csv").write_text("meterId\nm0\n", encoding="utf-8")
    (tmp_path / "three.csv").write_text("m1\nm2\n", encoding="utf-8")
    return tmp_path


@pytest.mark.parametrize("mode", ["proposed", "baseline"])
def test_window_job(spark, raw, mode):
    out = raw / "out"
    args = JobArgs("run1", mode, "1h", "gzip", f"{raw}/raw/*.gz", "20250416", "20250417", str(out))
    window_job(spark, args, str(raw / "single.csv"), str(raw / "three.csv"))

    def table(name):
        return spark.read.option("header", True).csv(f"{out}/{name}")

    summary = table("run_summary").first()
    assert (summary.mode, summary.runId, summary.totalInputRecords) == (mode, "run1", "240")
    assert 0 < int(summary.droppedRecords) < 240
    assert float(summary.droppedRecordRatio) == pytest.approx(int(summary.droppedRecords) / 240, abs=1e-6)
    counts = table(f"output_counts_run1_{mode}_1h")
    assert counts.columns == [
        "mode", "meterId", "seriesId", "windowStartMs", "windowEndMs", "outputCount",
        "earlyPurged", "finalCount", "distinctSlotCount",
    ]
    assert counts.count() > 10
    slots = {r.distinctSlotCount for r in counts.collect()}
    assert (slots == {"-1"}) == (mode == "baseline")
    latency = out / f"finalization_latency_metrics_run1_{mode}_1h"
    assert latency.exists() == (mode == "proposed")
    prefix = "faulty" if mode == "proposed" else "native_faulty"
    assert table(f"{prefix}_window_counts_run1_{mode}_1h").columns[5] == "singlePhaseUniqueFaultyMeterCount"
    for metric in ("throughput_metrics", "standard_throughput_metrics"):
        samples = table(f"{metric}_run1_{mode}_1h").collect()
        assert samples and all(int(s.intervalMs) >= 1000 for s in samples)
    progress = table("ingestion_progress")
    assert progress.columns == [
        "timestamp", "event", "linesRead", "fileIndex", "totalFiles", "currentFile", "elapsedSec", "linesPerSec",
    ]
    assert [(r.event, r.linesRead) for r in progress.collect()] == [
        ("START", "0"), ("FINISH", "120"), ("START", "120"), ("FINISH", "240"),
    ]


def test_results_are_read_back_by_run(spark, raw):
    """All runs below a folder, from the names of their results, as if each were read by its name."""
    out = raw / "all runs"
    for run, mode, setting in (("run_1", "proposed", "1h"), ("run_1", "baseline", "1h"), ("r2", "proposed", "30m")):
        args = JobArgs(run, mode, setting, "gzip", f"{raw}/raw/*.gz", "20250416", "20250417", str(out / "deep"))
        window_job(spark, args, str(raw / "single.csv"), str(raw / "three.csv"))
    counts = metrics.read_results(spark, str(out), "output_counts", metrics.OUTPUT_COUNTS)
    runs = {tuple(r) for r in counts.select("run_id", "method_key", "time_setting", "experiment").distinct().collect()}
    assert runs == {
        ("run_1", "proposed", "1h", "proposed_1h"),
        ("run_1", "baseline", "1h", "baseline_1h"),
        ("r2", "proposed", "30m", "proposed_30m"),
    }
    direct = metrics.read_metrics(
        spark, f"{out}/deep/output_counts_run_1_proposed_1h", metrics.OUTPUT_COUNTS, ["meterId"], snake=True
    ).withColumns({"experiment": F.lit("proposed_1h"), "row_no": F.lit(0)})
    columns = [c for c in direct.columns if c not in ("experiment", "row_no")]
    got = counts.filter("experiment = 'proposed_1h'").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, direct.select(columns).collect()))
    summary = {r.experiment: r for r in outputs_of_folder(spark, str(out), WindowSpec()).collect()}
    assert set(summary) == {"proposed_1h", "baseline_1h", "proposed_30m"}
    assert summary["proposed_1h"] == outputs_of(direct, None, WindowSpec()).first()
    # rates of two kinds, told apart by the whole name of the metric
    rates = metrics.read_results(spark, str(out), "throughput_metrics", metrics.THROUGHPUT)
    assert {r.probe.split("_", 1)[1] for r in rates.collect()} == {"source_after_parse", "post_window_aggregation"}


def test_results_in_files_and_batches(spark, tmp_path):
    """Rows in the order of their file, the first of equal windows counts; inferred where no counts are."""
    header = "mode,meterId,seriesId,windowStartMs,windowEndMs,outputCount,earlyPurged,finalCount,distinctSlotCount"
    row = "PROPOSED,a,Ström L1,600000,1200000,{},false,5,5\n"
    many = "".join(row.format(n) for n in range(7, 3000))
    (tmp_path / "output_counts_x_fast_0.csv").write_text(f"{header}\n{many}", encoding="utf-8")
    (tmp_path / "output_counts_x_delayed_0.csv").write_text(f"{header}\n", encoding="utf-8")
    (tmp_path / "output_counts.csv").write_text("meterId,outputCount\nz,1\n", encoding="utf-8")
    for n in range(2):
        folder = tmp_path / "output_counts_y_baseline_1h" / f"batch={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.csv").write_text(f"{header}\n{row.format(n)}", encoding="utf-8")
    final = "mode,resultType,finalizationReason,meterId,seriesId,count,windowStartMs,windowEndMs"
    for mode in ("delayed", "fast"):
        (tmp_path / f"finalization_latency_metrics_x_{mode}_0.csv").write_text(
            f"{final}\nPROPOSED,FINAL,DEADLINE,b,Ström L1,3,0,600000\n", encoding="utf-8"
        )
    counts = metrics.read_results(spark, str(tmp_path), "output_counts", metrics.OUTPUT_COUNTS)
    found = {(r.experiment, r.n) for r in counts.groupBy("experiment").agg(F.count("*").alias("n")).collect()}
    assert found == {("fast_0", 2993), ("baseline_1h", 2), ("unknown_unknown", 1)}
    ordered = counts.filter("experiment = 'fast_0'").orderBy("row_no").collect()
    assert [r.output_count for r in ordered] == list(range(7, 3000))
    summary = {r.experiment: r for r in outputs_of_folder(spark, str(tmp_path), WindowSpec()).collect()}
    assert summary["fast_0"].valid_window_outputs == 7 and summary["baseline_1h"].valid_window_outputs == 0
    assert summary["delayed_0"].emitted_windows == 1 and set(summary) >= {"delayed_0", "unknown_unknown"}
    assert metrics.read_results(spark, str(tmp_path), "none", metrics.OUTPUT_COUNTS) is None


def bus_lines(raw):
    return [text for name in sorted(os.listdir(raw / "raw")) for text in gzip.open(raw / "raw" / name, "rt", encoding="utf-8").read().splitlines()]


def test_window_job_on_a_bus(spark, raw):
    """Default arguments but for folders; the job goes on where one that was stopped ended, each message once."""
    texts, topic, out = bus_lines(raw), str(raw / "topic"), raw / "out"
    publish(topic, 0, texts[:50])
    publish(topic, 0, texts[50:90])
    publish(topic, 1, texts[90:130])
    store, offsets = (f"{out}/{name}_default_run_proposed_50h" for name in ("readings", "offsets"))
    start_parsing(read_segments(spark, topic), store, offsets).awaitTermination()
    assert spark.read.parquet(f"{store}/batch=*").count() == 130
    publish(topic, 1, texts[130:200])
    publish(topic, 2, texts[200:])
    args = JobArgs(topic_folder=topic, out_dir=str(out))
    window_job(spark, args, str(raw / "single.csv"), str(raw / "three.csv"))
    assert spark.read.option("header", True).csv(f"{out}/run_summary").first().totalInputRecords == "240"
    expected = {(n << 20) + part for part, size in ((0, 90), (1, 110), (2, 40)) for n in range(size)}
    stored = spark.read.schema(READINGS).parquet(f"{store}/batch=*")
    assert sorted(r.arrival_seq for r in stored.collect()) == sorted(expected)
    # nothing new: nothing is read
    start_parsing(read_segments(spark, topic), store, offsets).awaitTermination()
    assert stored.count() == 240
    for name in ("output_counts", "finalization_latency_metrics", "faulty_window_counts", "throughput_metrics"):
        assert spark.read.option("header", True).csv(f"{out}/{name}_default_run_proposed_50h").columns


def test_segments(spark, tmp_path):
    topic = f"{tmp_path}/topic"
    reader = SegmentStream(topic)
    assert reader.initialOffset() == reader.latestOffset() == {}
    assert publish(topic, 0, ["a", "b", "c"]) == (0, 3)
    assert publish(topic, 0, ["d", ""]) == (3, 5)
    assert publish(topic, 7, ["é,x"]) == (0, 1)
    os.makedirs(f"{topic}/partition=0/.x")
    (tmp_path / "topic" / "partition=0" / "notes.txt").write_text("no segment")
    assert reader.latestOffset() == {"0": 5, "7": 1}
    def read(start, end):
        rows = [r for part in reader.partitions(start, end) for b in reader.read(part) for r in b.to_pylist()]
        return [(r["partition"], r["offset"], r["value"]) for r in rows]
    assert read({"0": 2}, {"0": 4, "7": 1}) == [(0, 2, "c"), (0, 3, "d"), (7, 0, "é,x")]
    assert read({"0": 5}, {"0": 5}) == []
    # a gap waits, a lost or short segment is an error, and so are overlaps
    (tmp_path / "topic" / "partition=0" / f"{9:020d}-{10:020d}.log").write_text("z\n")
    assert reader.latestOffset()["0"] == 5
    with pytest.raises(ValueError, match="no longer"):
        reader.partitions({"0": 5}, {"0": 7})
    (tmp_path / "topic" / "partition=0" / f"{5:020d}-{9:020d}.log").write_text("x\n")
    with pytest.raises(ValueError, match="ends at 6"):
        read({"0": 5}, {"0": 9})
    (tmp_path / "topic" / "partition=0" / f"{8:020d}-{9:020d}.log").write_text("y\n")
    with pytest.raises(ValueError, match="overlap"):
        reader.latestOffset()
    for bad in ([], ["two\nlines"]):
        with pytest.raises(ValueError):
            publish(topic, 1, bad)


def test_failed_job_still_writes_its_summary(spark, tmp_path):
    args = JobArgs("r", "fast", "0", "gzip", f"{tmp_path}/none/*.gz", out_dir=str(tmp_path / "out"))
    with pytest.raises(ValueError):
        window_job(spark, args, "x", "y")
    row = spark.read.option("header", True).csv(f"{tmp_path}/out/run_summary").first()
    assert (row.totalInputRecords, row.droppedRecordRatio) == ("0", "0.000000")


def test_classification_job(spark, tmp_path):
    lines = spark.createDataFrame(
        [("x,m1,y,Meter 3-Phase,3",), ("x,m2,y,Meter 1-Phase,1",), ("x,m3,y,CT,1",)], "value string"
    )
    totals = {r["class"]: r.meters for r in classification_job(lines, str(tmp_path)).collect()}
    assert totals == {"THREE": 1, "SINGLE": 1, "OTHER": 1}
    assert spark.read.csv(f"{tmp_path}/three_phase_meters").first()[0] == "m1"


# ---------------------------------------------------------------- streaming


def test_rates_of_more_batches_than_a_query_remembers(spark, tmp_path):
    for i in range(4):
        spark.range(10 + i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rates = BatchRates()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    spark.streams.addListener(rates)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stream.writeStream.queryName("fast_post_filter").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 20
        while len(rates.rows) < 4 and time.time() < end:
            time.sleep(0.1)
        assert len(query.recentProgress) <= 2
    finally:
        spark.streams.removeListener(rates)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    found = rates.samples().collect()
    assert sorted(s.count_in_interval for s in found) == [10, 11, 12, 13]
    assert {s.probe for s in found} == {"fast_post_filter"}


def test_raw_lines_as_a_stream(spark, raw, tmp_path):
    """Gzip files in, late readings out as CSV; rates from the query's progress."""
    lookup = lookup_of(
        read_meter_ids(spark, str(raw / "single.csv")), read_meter_ids(spark, str(raw / "three.csv"))
    )
    lines = stream_lines(spark, str(raw / "raw"))
    parsing = start_parsing(lines, f"{tmp_path}/store", f"{tmp_path}/parsing")
    parsing.awaitTermination()
    samples = rate_samples(parsing, "baseline_source_after_parse").collect()
    assert sum(s.count_in_interval for s in samples) == 240
    policy = Policy("baseline", lateness_ms=3_600_000)
    late = late_of(fired_from_store(spark, f"{tmp_path}/store", lookup, policy))
    start_csv(late, f"{tmp_path}/late", f"{tmp_path}/checkpoint").awaitTermination()
    written = spark.read.option("header", True).csv(f"{tmp_path}/late/batch=*")
    # the second file arrives after the first has moved the watermark
    assert written.count() > 0


def test_stream_routing_keeps_all_readings(spark):
    lookup = spark.createDataFrame(
        [("a", "SINGLE"), ("b", "THREE")], "meter_id string, phase_group string"
    )
    rows = spark.createDataFrame(
        [(m, s) for m in "abc" for s in ("Spänning L1", "Spänning L2", "Ström L1")],
        "meter_id string, series_id string",
    )
    streamed = routed(rows, lookup)
    assert streamed.count() == rows.count()
    columns = ["meter_id", "series_id", "phase_group"]
    kept = streamed.filter("phase_group IS NOT NULL").select(*columns)
    assert kept.exceptAll(route(rows, lookup).select(*columns)).isEmpty() and kept.count() == 3


@pytest.fixture(scope="module")
def feed(spark, folder, tmp_path_factory):
    """Readings as one file per micro-batch, the last one ending the input."""
    source = tmp_path_factory.mktemp("feed")
    rows = readings(spark, folder).withColumn("arrival_epoch", F.expr("arrival_epoch div 5"))
    frame = rows.toPandas()
    end = frame.tail(1).assign(
        meter_id=None, phase_group=None, event_ms=FLUSH_MS,
        arrival_seq=frame["arrival_seq"].max() + 1, arrival_epoch=frame["arrival_epoch"].max() + 1,
    )
    schema = pa.Table.from_pandas(frame, preserve_index=False).schema
    for epoch, part in [*frame.groupby("arrival_epoch"), (end["arrival_epoch"].iloc[0], end)]:
        path = source / f"{epoch:09d}.parquet"
        pq.write_table(pa.Table.from_pandas(part, schema=schema, preserve_index=False), path)
        os.utime(path, (1_700_000_000 + epoch,) * 2)
    return rows, str(source)


@pytest.mark.parametrize(
    "policy",
    [
        Policy("fast"),
        Policy("delayed", delay_ms=DAY_MS),
        Policy("baseline", lateness_ms=DAY_MS),
        Policy("proposed", lateness_ms=DAY_MS),
    ],
    ids=lambda p: p.mode,
)
def test_stream_equals_stored_form(spark, feed, policy, tmp_path):
    rows, source = feed
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = f"{tmp_path}/fired"
    (
        fired_windows(stream, policy, SPARSE)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    fired = spark.read.parquet(out)
    steps = {"per": "epoch", "keep": F.col("phase_group").isNotNull()}
    streamed = emissions_of(fired, policy, SPARSE).drop("fire_seq")
    stored = finalize(rows, policy, SPARSE, **steps).drop("fire_seq")
    assert streamed.count() == stored.count() > 100
    assert streamed.exceptAll(stored).isEmpty()
    late = place(rows, policy, SPARSE, **steps).filter("dropped")
    assert sorted(r.seq for r in late_of(fired).collect()) == sorted(
        r.arrival_seq for r in late.select("arrival_seq").collect()
    )
    assert output_counts(streamed).exceptAll(output_counts(stored)).isEmpty()


@pytest.mark.parametrize(
    "policy",
    [Policy("delayed", delay_ms=DAY_MS), Policy("baseline", lateness_ms=DAY_MS), Policy("proposed", lateness_ms=DAY_MS)],
    ids=lambda p: p.mode,
)
def test_streamed_output_counts_equal_stored_ones(spark, feed, policy, tmp_path):
    """Two stateful operators in one query; each window comes out once."""
    rows, source = feed
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    (
        counted_outputs(fired_windows(stream, policy, SPARSE), policy, SPARSE)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
        .awaitTermination()
    )
    streamed = spark.read.parquet(f"{tmp_path}/out")
    stored = output_counts(finalize(rows, policy, SPARSE, per="epoch", keep=F.col("phase_group").isNotNull()))
    assert streamed.count() == stored.count() > 100
    assert streamed.select(stored.columns).exceptAll(stored).isEmpty()


@pytest.mark.parametrize("policy", [Policy("baseline", lateness_ms=DAY_MS), Policy("proposed", lateness_ms=DAY_MS)], ids=lambda p: p.mode)
def test_streamed_faulty_meters_equal_stored_ones(spark, feed, policy, tmp_path):
    rows, source = feed
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write, last = faulty_batches(spark, f"{tmp_path}/out", SPARSE), {}

    def twice(batch, batch_id):
        # a repeated batch changes nothing
        write(batch, batch_id)
        if batch_id % 3 == 1:
            write(batch, batch_id)
        last["id"] = batch_id

    (
        emissions_of(fired_windows(stream, policy, SPARSE), policy, SPARSE)
        .writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
        .foreachBatch(twice)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    streamed = spark.read.parquet(f"{tmp_path}/out/faulty").drop("batch")
    stored = faulty_windows(finalize(rows, policy, SPARSE, per="epoch", keep=F.col("phase_group").isNotNull()), SPARSE)
    assert last["id"] > 3 and streamed.count() == stored.count() > 10
    assert streamed.exceptAll(stored).isEmpty()


def test_four_probes_in_one_query(spark, feed, tmp_path):
    rows, _ = feed
    policy, store = Policy("proposed", lateness_ms=DAY_MS), f"{tmp_path}/store"
    fields = [part.split()[0] for part in READINGS.split(", ")]
    filled = rows.withColumns({c: F.lit(None).cast("string") for c in fields if c not in rows.columns})
    for number, low in enumerate((0, 400)):
        part = filled.filter(f"arrival_seq >= {low}" + (" AND arrival_seq < 400" if not number else ""))
        typed = part.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in READINGS.split(", ")])
        typed.coalesce(1).write.parquet(f"{store}/batch={number:012d}")
    lookup = rows.filter("phase_group IS NOT NULL").select("meter_id", "phase_group").distinct()
    rates = BatchRates()
    spark.streams.addListener(rates)
    try:
        fired = fired_from_store(spark, store, lookup, policy, SPARSE, probes="proposed")
        query = (
            fired.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
            .trigger(availableNow=True).start(f"{tmp_path}/fired")
        )
        query.awaitTermination()
        emitted = spark.read.parquet(f"{tmp_path}/fired").filter("why <> 'LATE'").count()
        deadline = time.time() + 20
        # progress comes in after its batch, that of the last batch without input too
        while time.time() < deadline and sum(r[2] for r in rates.rows if r[1].endswith("aggregation")) < emitted:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(rates)
    totals = {r.probe: r.n for r in rates.samples().groupBy("probe").agg(F.sum("count_in_interval").alias("n")).collect()}
    kept = routed(spark.read.schema(READINGS).parquet(f"{store}/batch=*"), lookup).filter("phase_group IS NOT NULL")
    assert totals == {
        "proposed_source_after_ingestion": rows.count(),
        "proposed_source_after_parse": rows.filter("event_ms IS NOT NULL").count(),
        "proposed_post_filter": kept.count(),
        "proposed_post_window_aggregation": emitted,
    } and emitted > 0


class _ListState:
    """List state that counts what is written to it."""

    def __init__(self):
        self.rows, self.written, self.read = [], 0, 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.read += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.written += len(rows)
        self.rows += rows

    def clear(self):
        self.rows = []


class _Status:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.points, self.status, self.timers = _ListState(), _Status(), []

    def getListState(self, *_):
        return self.points

    def getValueState(self, *_):
        return self.status

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("mode", ["fast", "proposed"])
def test_a_batch_writes_its_own_readings_only(mode):
    """What a batch writes doesn't grow with the window, and nothing is read where nothing is emitted."""
    handle, spec = _Handle(), WindowSpec(expected=10_000)
    processor = WindowProcessor(Policy(mode), spec)
    processor.init(handle)
    for batch in range(50):
        rows = [Row(arrival_seq=20 * batch + k, event_ms=k, value=1.0, phase=0) for k in range(20)]
        before = handle.points.written
        assert list(processor.handleInputRows(("SINGLE", "a", 0), iter(rows), _Clock())) == []
        assert handle.points.written - before == 20
    assert handle.points.read == 0 and handle.status.get() == (1000, 0, False)
    assert len(handle.timers) == 1


def test_strict_windows_equal_the_built_in_window(spark, feed, tmp_path):
    rows, source = feed
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    # all readings in one group, so that each of them moves the watermark
    one = stream.withColumn("phase_group", F.lit("SINGLE"))
    # judge late rows by the newest watermark, as the policies do
    setting = "spark.sql.streaming.statefulOperator.allowMultiple"
    spark.conf.set(setting, "false")
    try:
        (
            closed_windows(one, SPARSE)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{tmp_path}/out")
            .awaitTermination()
        )
    finally:
        spark.conf.unset(setting)
    columns = ["meter_id", "window_start_ms", F.col("count").cast("long").alias("count")]
    built_in = spark.read.parquet(f"{tmp_path}/out").filter("meter_id IS NOT NULL").select(*columns)
    stored = finalize(
        rows.withColumn("phase_group", F.lit("SINGLE")), Policy("fast"), SPARSE, {}, per="epoch"
    ).select(*columns)
    assert stored.count() > 100
    assert stored.exceptAll(built_in).isEmpty()
    assert built_in.exceptAll(stored).isEmpty()
