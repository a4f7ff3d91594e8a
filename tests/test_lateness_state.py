"""The lateness profile carried from day to day."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from finality.config import WindowSpec
from finality.plans import lateness, lateness_state
from finality.plans.jobs import lateness_job
from test_sources import line, write_gz

SPEC = WindowSpec(size_ms=600_000, zone="UTC")
MODES = (*lateness.MODES, "global")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for n in range(900):
        # half of the readings are of one meter, some hours run over into the next day
        at = n * 100
        event = at - rng.choice([0, 0, 0, 500, 4000, 200_000])
        meter = rng.choice(["hot", "hot", f"m{n // 100}", "x"])
        insert = None if n % 50 == 0 else (at + 900) * 1000
        data.append((n, f"d{at // 30_000}", meter, rng.choice(["L1", "L2"]), event * 1000, insert))
    return spark.createDataFrame(
        data,
        "arrival_seq bigint, day string, meter_id string, series_id string, event_ms bigint, insert_ms bigint",
    )


@pytest.fixture(scope="module")
def state(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("state") / "s")
    for day in ("d0", "d1", "d2"):
        # arrivals are numbered anew in each file
        batch = rows.filter(F.col("day") == day).withColumn("arrival_seq", F.col("arrival_seq") % 300)
        lateness_state.add_batch(folder, day, batch, SPEC, MODES, errors=1)
    return folder


def same(got, want):
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("mode", MODES)
def test_days_from_the_state_equal_those_over_all_readings(spark, rows, state, mode):
    of_mode = F.col("mode") == mode
    same(lateness_state.day_summary(spark, state).filter(of_mode), lateness.day_summary(rows, mode, SPEC))
    same(lateness_state.overall_summary(spark, state).filter(of_mode), lateness.overall_summary(rows, SPEC, (mode,)))
    same(lateness_state.hourly(spark, state, SPEC).filter(of_mode), lateness.hourly(rows, mode, SPEC))
    late = lateness.lateness(rows, mode, SPEC)
    same(lateness_state.cdf(spark, state, ["mode"]).filter(of_mode), lateness.cdf(late, ["mode"]))
    by = ["mode", "day"]
    same(lateness_state.histogram(spark, state, by).filter(of_mode), lateness.histogram(late, by))


def test_a_batch_reads_no_former_readings_and_none_twice(spark, rows, state):
    with pytest.raises(ValueError, match="does not follow d2"):
        lateness_state.add_batch(state, "d1", rows, SPEC, MODES)
    with pytest.raises(ValueError, match="holds the measures"):
        lateness_state.add_batch(state, "d3", rows, SPEC)
    got = [tuple(r) for r in lateness_state.progress(spark, state).orderBy("batch").collect()]
    assert got == [("d0", 300, 1, 300, 1), ("d1", 300, 1, 600, 2), ("d2", 300, 1, 900, 3)]


def test_a_batch_that_failed_is_run_again(spark, rows, tmp_path):
    state = f"{tmp_path}/s"
    first, second = (rows.filter(F.col("day") == d) for d in ("d0", "d1"))
    lateness_state.add_batch(state, "d0", first, SPEC)
    # a run that got as far as the counts and the keys of d1
    rows.withColumn("mode", F.lit("per_meter")).selectExpr(
        "mode", "day", "0L AS hour_s", "1 AS bin", "1L AS n", "1L AS sum_s", "1L AS max_s"
    ).write.parquet(f"{state}/counts/batch=d1")
    spark.createDataFrame([("per_meter", "hot", None, 10**9, "d0")], "mode string, meter_id string, "
        "series_id string, top_s bigint, first_day string").write.parquet(f"{state}/tops/slot=1")
    assert lateness_state.day_summary(spark, state).filter("day <> 'd0'").isEmpty()
    lateness_state.add_batch(state, "d1", second, SPEC)
    want = lateness.day_summary(rows.filter("day < 'd2'"), "per_meter", SPEC)
    same(lateness_state.day_summary(spark, state).filter("mode = 'per_meter'"), want)


def test_an_empty_batch_and_an_empty_folder(spark, rows, tmp_path):
    state = f"{tmp_path}/s"
    assert lateness_state.last_batch(spark, state) is None
    lateness_state.add_batch(state, "001", rows.limit(0), SPEC)
    assert lateness_state.day_summary(spark, state).isEmpty()
    lateness_state.add_batch(state, "002", rows, SPEC)
    assert [r.batch for r in lateness_state.batches(spark, state).orderBy("batch").collect()] == ["001", "002"]
    want = lateness.overall_summary(rows, SPEC)
    same(lateness_state.overall_summary(spark, state), want)


def test_job_goes_on_from_the_days_it_has(spark, tmp_path, caplog):
    raw = tmp_path / "raw"
    raw.mkdir()
    rng = random.Random(2)

    def write(day: int):
        texts = [
            line(
                meter_id=f"m{rng.randrange(4)}",
                time=f"2025-04-{day} {max(n // 10 - rng.choice([0, 0, 5]), 0):02d}:{n % 10 * 6:02d}:00",
            )
            for n in range(200)
        ]
        write_gz(raw / f"raw.log-202504{day}.gz", [*texts, "broken"])

    write(16)
    template, first, last = f"{raw}/raw.log-{{date}}.gz", date(2025, 4, 16), date(2025, 4, 18)
    state, out = f"{tmp_path}/state", f"{tmp_path}/out"
    assert lateness_job(spark, template, first, last, state, out, SPEC) == ["20250417", "20250418"]
    assert "no file for 20250417" in caplog.text
    write(18)
    assert lateness_job(spark, template, first, last, state, out, SPEC) == ["20250417"]
    anew = f"{tmp_path}/anew"
    lateness_job(spark, template, first, last, f"{tmp_path}/other", anew, SPEC)

    def table(folder, name):
        read = spark.read.option("header", True).csv(f"{folder}/{name}")
        return sorted(map(str, read.collect()))

    for name in ("per_day_summary", "histogram", "histogram_overall", "cdf", "cdf_overall", "hourly_data",
                 "compare_summary", "progress", "quarantine"):
        assert table(out, name) and table(out, name) == table(anew, name), name
    days = spark.read.option("header", True).csv(f"{out}/per_day_summary/mode=per_meter")
    assert [(r.date, r.total) for r in days.collect()] == [("20250416", "200"), ("20250418", "200")]
    write(17)
    with pytest.raises(ValueError, match="does not follow 20250418"):
        lateness_job(spark, template, first, last, state, out, SPEC)
