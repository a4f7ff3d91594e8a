"""Files, parsing, metadata, metric files and logs."""

from __future__ import annotations

import gzip
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from finality.config import JobArgs, Policy, parse_duration
from finality.functions.timecols import epoch_ms, local_text
from finality.operators.meters import class_totals, classify_meters, lookup_of, route
from finality.sinks import writers
from finality.sources import lines, metrics, parse


def line(**changes):
    fields = {
        "series_id": "Spänning L1",
        "location_id": "loc",
        "meter_id": "m1",
        "time": "2025-04-16 10:00:00",
        "value": "231.5",
        "value_status": "OK",
        "insert_time": "2025-04-16 10:05:00.5",
        "extract_time": "2025-04-16 10:06:00",
    }
    fields.update(changes)
    return "Struct{" + ",".join(f"{k}={v}" for k, v in fields.items() if v is not None) + "}"


def parsed(spark, texts, how=parse.parse_strict, zone="UTC"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arrival_seq long, value string")
    return how(df, zone).orderBy("arrival_seq").collect()


def write_gz(path, texts):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write("\n".join(texts) + "\n")


def test_strict_parse(spark):
    rows = parsed(
        spark,
        [
            line(),
            line(location_id="a,b"),
            line(location_id="a,b=c"),
            line(value_status=None),
            line(value="x"),
            line(time="2025-04-16 10:00"),
            "{" + line(),
            line() + " ",
            "",
            line(meter_id=" m2 "),
            line(value="NaN"),
            line(location_id="x=y"),
            "Struct{meter_id=first," + line()[7:],
        ],
    )
    assert [r.parse_error for r in rows] == [
        None, None, None, "missing field", "bad value", "bad time",
        "not a Struct{...} line", "not a Struct{...} line", "empty line", None, None, None, None,
    ]
    assert rows[0].event_ms == 1_744_797_600_000 and rows[0].insert_ms % 1000 == 500
    assert rows[0].series_id == "Spänning L1" and rows[0].value == 231.5
    assert rows[1].location_id == "a,b"
    assert rows[2].location_id == "a"
    assert rows[9].meter_id == "m2"
    assert rows[11].location_id == "x=y"
    assert rows[12].meter_id == "m1"  # the last of two equal names counts


def test_bad_line_fails_the_job_or_is_set_apart(spark):
    df = spark.createDataFrame([(0, line()), (1, "junk")], "arrival_seq long, value string")
    table = parse.parse_strict(df, "UTC")
    assert parse.readings_of(table).count() == 1
    assert [(r.arrival_seq, r.raw) for r in parse.quarantine(table).collect()] == [(1, "junk")]
    with pytest.raises(PySparkException, match="junk"):
        parse.readings_of(table, fail=True).select("meter_id").collect()


def test_permissive_parse(spark):
    rows = parsed(
        spark,
        [
            line(),
            "  " + line(value=None, extract_time=None, location_id=None) + "  ",
            line(meter_id=None),
            line(time="never"),
            "junk",
            line(insert_time="?"),
        ],
        parse.parse_permissive,
    )
    assert [r.parse_error for r in rows] == [
        None, None, "missing field", "bad time", "not a Struct{...} line", None,
    ]
    assert rows[5].insert_ms is None and rows[5].event_ms is not None


@pytest.mark.parametrize(
    "text, zone, expected",
    [
        ("2025-01-01 00:00:00", "UTC", 1_735_689_600_000),
        ("2025-01-01 00:00:00.1", "UTC", 1_735_689_600_100),
        ("2025-01-01 00:00:00.123", "UTC", 1_735_689_600_123),
        ("2025-01-01 00:00:00.123999", "UTC", 1_735_689_600_123),
        ("2025-07-01 12:00:00", "Europe/Stockholm", 1_751_364_000_000),
        ("2025-03-30 02:30:00", "Europe/Stockholm", 1_743_298_200_000),  # skipped hour
        ("2025-10-26 02:30:00", "Europe/Stockholm", 1_761_438_600_000),  # first of two
        ("1969-12-31 23:59:59.5", "UTC", -500),
        ("2025-01-01 00:00:00.1234567", "UTC", None),
        ("2025-1-1 00:00:00", "UTC", None),
        ("2025-13-01 00:00:00", "UTC", None),
    ],
)
def test_time_text(spark, text, zone, expected):
    got = spark.range(1).select(epoch_ms(F.lit(text), zone)).first()[0]
    assert got == expected


def test_local_text(spark):
    ms = F.lit(1_751_364_000_999)
    assert spark.range(1).select(local_text(ms, "Europe/Stockholm")).first()[0] == "2025-07-01 12:00:00"
    assert spark.range(1).select(local_text(F.lit(-1), "UTC")).first()[0] == "1969-12-31 23:59:59"


def test_files_and_arrival_order(spark, tmp_path, caplog):
    for day, texts in {"20250417": ["c", "", "d"], "20250416": ["a", "b"], "20250418": ["e"]}.items():
        write_gz(tmp_path / f"raw.log-{day}.gz", texts)
    write_gz(tmp_path / "raw.log-extra.gz", ["z"])
    glob = f"{tmp_path}/raw.log-*.gz"
    names = [p.rsplit("/", 1)[-1] for p in lines.list_files(spark, glob, "20250416", "20250417")]
    assert names == ["raw.log-20250416.gz", "raw.log-20250417.gz", "raw.log-extra.gz"]
    table = lines.read_lines(spark, lines.list_files(spark, glob))
    rows = table.orderBy("arrival_seq").collect()
    assert [r.value for r in rows] == ["a", "b", "c", "d", "e", "z"]
    assert [r.arrival_epoch for r in rows] == [0, 0, 1, 1, 2, 3]
    assert rows[0].day == "20250416" and rows[5].day == "raw.log-extra.gz"
    first = lines.first_records(table, 3).orderBy("arrival_seq").collect()
    assert [r.value for r in first] == ["a", "b", "c"]
    lines.read_lines(spark, lines.list_files(spark, glob), clock=True).write.parquet(f"{tmp_path}/lines")
    progress = lines.ingestion_progress(spark.read.parquet(f"{tmp_path}/lines")).collect()
    assert [(r.event, r.lines_read, r.file_index, r.total_files) for r in progress[:4]] == [
        ("START", 0, 1, 4), ("FINISH", 2, 1, 4), ("START", 2, 2, 4), ("FINISH", 4, 2, 4),
    ]
    assert len(progress) == 8
    present, absent = lines.daily_files(
        spark, f"{tmp_path}/raw.log-{{date}}.gz", date(2025, 4, 17), date(2025, 4, 19)
    )
    assert [p.rsplit("/", 1)[-1] for p in present] == ["raw.log-20250417.gz", "raw.log-20250418.gz"]
    assert absent == ["20250419"]
    assert [r.getMessage() for r in caplog.records if r.name == lines.__name__] == ["no file for 20250419: raw.log-20250419.gz"]


def test_progress_inside_a_file(spark):
    """Two files read side by side; samples each five seconds, lines counted in file order."""
    rows = [(1, "b", 1_000 + 700 * n) for n in range(20)] + [(0, "a", 500 + 100 * n) for n in range(30)]
    table = spark.createDataFrame(rows, "arrival_epoch bigint, file_name string, read_ms bigint")
    found = lines.ingestion_progress(table, every_ms=5_000).collect()
    assert [(r.event, r.current_file, r.lines_read) for r in found] == [
        ("START", "a", 0), ("FINISH", "a", 30),
        ("START", "b", 30), ("PROGRESS", "b", 39), ("PROGRESS", "b", 46), ("FINISH", "b", 50),
    ]
    by_hand = {at: n for n, at in enumerate((at for _, name, at in rows if name == "b"), 1)}
    for r in found[3:5]:
        at = next(ms for ms, n in by_hand.items() if n == r.lines_read - 30)
        assert r.elapsed_sec == (at - 500) // 1000
        assert r.lines_per_sec == pytest.approx(r.lines_read * 1000 / (at - 500), abs=0.006)
    assert (found[0].elapsed_sec, found[0].lines_per_sec, found[0].timestamp) == (0, 0.0, "1970-01-01T00:00:00Z")
    assert lines.ingestion_progress(table.limit(0)).count() == 0


def test_missing_files_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="No files matched"):
        lines.list_files(spark, f"{tmp_path}/nowhere/*.gz")
    write_gz(tmp_path / "x-20250101.gz", ["a"])
    with pytest.raises(ValueError, match="20260101"):
        lines.list_files(spark, f"{tmp_path}/*.gz", from_date="20260101")


def test_date_range():
    assert lines.in_date_range("a-20250416.gz", "20250416", "20250416")
    assert not lines.in_date_range("a-20250415.gz", "20250416", None)
    assert not lines.in_date_range("a-20250417.gz", None, "20250416")
    assert lines.in_date_range("a.gz", "20250416", "20250416")


def test_profile_progress(spark):
    df = spark.createDataFrame(
        [("a", 0, line()), ("a", 0, "junk"), ("b", 1, line())],
        "file_name string, arrival_epoch long, value string",
    )
    rows = lines.profile_progress(parse.parse_permissive(df, "UTC")).orderBy("file_name").collect()
    assert [(r.records, r.errors, r.total_records, r.total_errors) for r in rows] == [
        (1, 1, 1, 1), (1, 0, 2, 1),
    ]


def test_bus_options():
    options = lines.bus_options("cm_meter_values", "host:9092", "group")
    assert options["subscribe"] == "cm_meter_values" and options["startingOffsets"] == "earliest"


def test_lookup_and_routing(spark, tmp_path):
    (tmp_path / "single.csv").write_text("MeterId,type\n a ,1-Phase,1\n\na\n,x\nboth\n", encoding="utf-8")
    (tmp_path / "three.csv").write_text("c,3-Phase,3\nboth\n", encoding="utf-8")
    single = lines.read_meter_ids(spark, str(tmp_path / "single.csv"))
    assert sorted(r.meter_id for r in single.collect()) == ["a", "both"]
    lookup = lookup_of(single, lines.read_meter_ids(spark, str(tmp_path / "three.csv")))
    readings = spark.createDataFrame(
        [(m, s) for m in ("a", "both", "c", "d") for s in ("Spänning L1", "Spänning L2", "Ström L1")],
        "meter_id string, series_id string",
    )
    rows = {(r.meter_id, r.series_id[-2:], r.phase_group) for r in route(readings, lookup).collect()}
    assert rows == {
        ("a", "L1", "SINGLE"), ("both", "L1", "SINGLE"), ("both", "L1", "THREE"),
        ("both", "L2", "THREE"), ("c", "L1", "THREE"), ("c", "L2", "THREE"),
    }


def test_meter_classes(spark):
    texts = [
        "x, m1 ,y, Meter 3-Phase 1-Phase ,3", "x,m2,y,Meter 1-Phase,z,1", "x,m3,y,Meter CT,2",
        "x,m4,y", "x,m5,y,3-Phase", "x,m6,y,3-Phase,1.5", "x,m7,y,1-Phase,1,,",
    ]
    df = classify_meters(spark.createDataFrame([(t,) for t in texts], "value string"))
    rows = {(r.meter_id, r["class"], r.phases) for r in df.collect()}
    assert rows == {("m1", "THREE", 3), ("m2", "SINGLE", 1), ("m3", "OTHER", 2), ("m7", "SINGLE", 1)}
    assert {(r["class"], r.meters) for r in class_totals(df).collect()} == {
        ("THREE", 1), ("SINGLE", 2), ("OTHER", 1),
    }


def test_metric_files(spark, tmp_path):
    path = tmp_path / "standard_throughput_metrics_run8_fast_0.csv"
    path.write_text(
        "timestamp,probe,countInInterval,eventsPerSecond,intervalMs,other\n"
        "2025-01-01T00:00:01.5Z,fast_post_filter,10,5.0,2000,x\n"
        "2025-01-01T00:00:02Z,fast_post_filter,bad,5.0,2000,x\n",
        encoding="utf-8",
    )
    required = ["timestamp", "probe", "countInInterval", "eventsPerSecond", "intervalMs"]
    table = metrics.read_metrics(spark, str(path), metrics.THROUGHPUT, required, snake=True)
    rows = table.select(F.unix_millis("timestamp").alias("ts_ms"), "count_in_interval").collect()
    assert [(r.ts_ms, r.count_in_interval) for r in rows] == [(1_735_689_601_500, 10)]
    with pytest.raises(ValueError, match="cpu_percent"):
        metrics.read_metrics(spark, str(path), metrics.SYSTEM, ["timestamp", "cpu_percent"])
    named = table.select("probe", F.unix_millis("timestamp").alias("ts_ms")).withColumn(
        "file_name", F.lit(path.name)
    )
    row = metrics.with_run(named).first()
    assert (row.run_id, row.method_key, row.time_setting, row.experiment) == ("run8", "fast", "0", "fast_0")
    row = metrics.with_run(named.withColumn("file_name", F.lit("odd.csv"))).first()
    assert (row.run_id, row.method_key, row.experiment) == ("unknown", "fast", "fast_unknown")


def test_files_with_differing_columns(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    header = "mode,runId,timeSetting,totalInputRecords,droppedRecords,droppedRecordRatio"
    (tmp_path / "run_summary.csv").write_text(f"{header}\nfast,r1,0,10,2,0.2\n", encoding="utf-8")
    (tmp_path / "deep" / "run_summary.csv").write_text("mode,droppedRecords\nproposed,3\n", encoding="utf-8")
    (tmp_path / "deep" / "x_run_summary.csv").write_text("mode,droppedRecords\nno,3\n", encoding="utf-8")
    table = metrics.read_all(spark, str(tmp_path), "run_summary.csv", metrics.RUN_SUMMARY)
    rows = {(r.mode, r.runId, r.droppedRecords) for r in table.collect()}
    assert rows == {("fast", "r1", 2), ("proposed", None, 3)}
    assert metrics.read_all(spark, str(tmp_path), "none.csv", metrics.RUN_SUMMARY) is None
    assert spark.range(1).select(metrics.mode_from_name(F.lit("output_counts_r_fast_0.csv"))).first()[0] == "fast"


def test_gc_log(spark):
    texts = [
        "[2026-05-01T15:00:00.123+0200][info][gc] GC(1) Pause Young (Normal) 12M->3M(64M) 4.500ms",
        "[2026-05-01T15:00:01.000+0200][info][gc] GC(2) Pause Remark 0.700ms",
        "[2026-05-01T15:01:00.123+0200][info][gc] GC(3) Pause Full (Ergonomics) 60M->10M(64M) 50.000ms",
        "[2026-05-01T15:01:00.123+0200][info][gc] Concurrent Mark 5.0ms",
    ]
    df = spark.createDataFrame([("run", t) for t in texts], "experiment string, value string")
    events = metrics.gc_events(df).orderBy("ts_ms").collect()
    assert [(e.type, e.before_mb, e.recovered_mb, e.duration_ms) for e in events] == [
        ("Young", 12.0, 9.0, 4.5), ("Remark", None, None, 0.7), ("Full", 60.0, 50.0, 50.0),
    ]
    assert events[0].ts_ms == 1_777_640_400_123
    assert metrics.gc_events(df, metrics.SIZED_PAUSES, sizes_needed=True).count() == 2
    from finality.plans import resources

    series = resources.gc_series(metrics.gc_events(df))
    summary = resources.gc_summary(series).first()
    assert (summary.gc_events, summary.full_gc_events, summary.young_gc_events) == (3, 1, 1)
    assert summary.gc_events_per_min == pytest.approx(3.0)
    assert summary.gc_total_pause_ms == pytest.approx(55.2)
    assert {(r.minute, r.gc_events) for r in resources.gc_per_minute(series).collect()} == {(0, 2), (1, 1)}


def test_csv_quoting(spark, tmp_path):
    path = f"{tmp_path}/out"
    writers.write_csv(
        spark.createDataFrame([("a,b", 'say "x"', None, 1)], "a string, b string, c string, d int").coalesce(1),
        path,
    )
    text = next(tmp_path.glob("out/part-*.csv")).read_text(encoding="utf-8")
    assert text == 'a,b,c,d\n"a,b","say ""x""",,1\n'
    writers.write_csv(spark.range(1).coalesce(1), path, append=True)
    assert len(list(tmp_path.glob("out/part-*.csv"))) == 2
    writers.write_csv(spark.range(1).coalesce(1), path)
    assert len(list(tmp_path.glob("out/part-*.csv"))) == 1


def test_names():
    assert writers.output_path("o", "m", "r 1/x", "fast", "50h") == "o/m_r_1_x_fast_50h"
    assert writers.named_output("a.csv", "r.1") == "a_r_1.csv"
    assert writers.named_output("a.csv", "") == "a.csv"


def test_arguments():
    assert parse_duration("0") == 0 and parse_duration("90m") == 5_400_000
    assert parse_duration("2d") == 172_800_000
    for bad in ("5", "h", "5s", ""):
        with pytest.raises(ValueError):
            parse_duration(bad)
    assert Policy.of("FAST", "50h") == Policy("fast")
    assert Policy.of("delayed", "1h") == Policy("delayed", delay_ms=3_600_000)
    args = JobArgs(mode=" Proposed ", source="GZIP", from_date=" 20250416 ")
    assert (args.mode, args.source, args.from_date) == ("proposed", "gzip", "20250416")
    assert args.policy.lateness_ms == 50 * 3_600_000
    for wrong in ({"mode": "x"}, {"source": "x"}, {"from_date": "2025"}, {"time_setting": "x"}):
        with pytest.raises(ValueError):
            JobArgs(**wrong)


def test_batch_order_is_unique_over_partitions(spark):
    from finality.sources.lines import number_lines

    batch = spark.range(1000).selectExpr("cast(id as string) as value").repartition(4)
    rows = number_lines(batch, 3).collect()
    assert len({r.arrival_seq for r in rows}) == 1000 and all(r.arrival_seq >> 33 == 3 for r in rows)
    given = batch.selectExpr("value", "cast(value as bigint) * 7 as arrival_seq")
    assert all(int(r.value) * 7 == r.arrival_seq for r in number_lines(given, 0).collect())


def test_equal_file_names_in_two_folders(spark, tmp_path):
    import gzip

    from finality.sources.lines import read_lines

    paths = []
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        paths.append(str(tmp_path / folder / "raw.log-20250416.gz"))
        with gzip.open(paths[-1], "wt") as file:
            file.write("".join(f"{folder}{i}\n" for i in range(3)))
    rows = read_lines(spark, paths).orderBy("arrival_seq").collect()
    assert [r.value for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2"]
