"""Policies against a record-at-a-time simulation, also for very full windows."""

from __future__ import annotations

import dataclasses
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from finality.config import Policy, WindowSpec
from finality.operators import zero_runs
from finality.functions.points import default_content
from finality.operators.replay import finalize, late_records, place
from finality.plans.reports import contract_violations, output_counts
from simulator import SCHEMA, random_readings, simulate, zero_run

HOUR = 3_600_000
POLICIES = [
    Policy("fast"),
    Policy("delayed", delay_ms=HOUR),
    Policy("baseline", lateness_ms=HOUR),
    Policy("proposed", lateness_ms=HOUR),
]


def routed():
    return F.col("phase_group").isNotNull()


def emitted_by_spark(df, policy, spec):
    rows = finalize(df, policy, spec, keep=routed()).collect()
    out = set()
    for r in rows:
        row = (
            r.phase_group, r.meter_id, r.window_start_ms, r.emit_no, r["count"],
            r.fault_indicator, r.voltage_data, r.fire_seq, r.fire_phase,
        )
        if policy.completes_early:
            row += (r.finalization_reason, r.distinct_slot_count, r.finalization_latency_ms,
                    r.watermark_at_purge_ms)
        out.add(row)
    assert len(out) == len(rows)
    return out


def emitted_by_simulation(rows, policy, spec):
    emitted, dropped = simulate(rows, policy, spec)
    out = set()
    for r in emitted:
        row = (
            r["phase_group"], r["meter_id"], r["window_start_ms"], r["emit_no"], r["count"],
            r["fault"], r["text"], r["fire_seq"], r["fire_phase"],
        )
        if policy.completes_early:
            row += (r["why"], r["slots"], r["latency"], r["watermark"])
        out.add(row)
    return out, dropped


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: p.mode)
@pytest.mark.parametrize("seed", [1, 2])
def test_against_simulation(spark, policy, seed):
    rng = random.Random(seed)
    # whole quarter hours in one run: many equal event times, and deadlines met exactly
    step = 900_000 if seed == 2 else 1
    rows = random_readings(rng, 1500, 9, 30 * HOUR, 4 * HOUR, step)
    spec = WindowSpec(expected=4, block_bits=7)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    expected, dropped = emitted_by_simulation(rows, policy, spec)
    assert emitted_by_spark(df, policy, spec) == expected
    late = late_records(place(df, policy, spec, keep=routed()))
    assert sorted(r.arrival_seq for r in late.select("arrival_seq").collect()) == sorted(dropped)


@pytest.mark.parametrize("policy", POLICIES[:3], ids=lambda p: p.mode)
@pytest.mark.parametrize("step", [1, 3_600_000])
def test_very_full_windows(spark, policy, step, monkeypatch):
    """A meter with a third of all readings, small blocks and slots, also with a clock that stands still."""
    rows = random_readings(random.Random(3), 1200, 6, 8 * HOUR, 3 * HOUR, step)
    spec = WindowSpec(expected=4, block_bits=4)
    monkeypatch.setattr(zero_runs, "SLOT_BITS", 18)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    expected, _ = emitted_by_simulation(rows, policy, spec)
    assert emitted_by_spark(df, policy, spec) == expected


@pytest.mark.parametrize("policy", POLICIES[:3], ids=lambda p: p.mode)
def test_no_window_is_gathered_without_a_text(spark, policy):
    """Counts and flags come from a plan without arrays; one window holds all rows."""
    spec = WindowSpec()
    rows = spark.range(300_000).selectExpr(
        "id AS arrival_seq", "id AS arrival_epoch", "'a' AS meter_id", "'Spänning L1' AS series_id",
        "CASE WHEN id = 150000 THEN 7200000 ELSE (id * 7919) % 7200000 END AS event_ms",
        "CASE WHEN id % 5 = 0 THEN 9D ELSE 0D END AS value", "0L AS insert_ms", "'SINGLE' AS phase_group",
    )
    flags = {"fault_indicator": default_content(spec)["fault_indicator"]}
    emitted = finalize(rows, policy, spec, flags)
    plan = emitted._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "collect_list" not in plan
    first = emitted.filter("window_start_ms = 0")
    taken = {"fast": 150_000, "delayed": 299_999, "baseline": 299_999}[policy.mode]
    row = first.agg(F.max("count"), F.count("*"), F.bool_and("fault_indicator")).first()
    assert tuple(row) == (taken, taken - 149_999 if policy.lateness_ms else 1, True)


def test_contract_and_equal_lateness(spark):
    rows = random_readings(random.Random(5), 1000, 7, 20 * HOUR, 4 * HOUR)
    spec = WindowSpec(expected=4, block_bits=7)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert contract_violations(finalize(df, POLICIES[3], spec, keep=routed())).isEmpty()
    kept = sum(r["phase_group"] is not None for r in rows)
    drops = []
    for policy in POLICIES[1:]:
        placed = place(df, policy, spec, keep=routed())
        drops.append(placed.filter("dropped").count())
        assert placed.count() == kept
    assert len(set(drops)) == 1


def test_versions_follow_every_arrival():
    rng = random.Random(7)
    spec, kinds = WindowSpec(), zero_runs.Summaries(3)
    for _ in range(200):
        n = rng.randrange(1, 14)
        seqs = rng.sample(range(100), n)
        zeros = [rng.random() < 0.7 for _ in range(n)]
        order = sorted(range(n), key=seqs.__getitem__)
        leaf = [kinds.code(int(z), int(z), z, False) for z in zeros]
        changes = dict(zero_runs.versions(order, [seqs[i] for i in order], [leaf[i] for i in order], kinds))
        state = kinds.empty
        for seq in sorted(seqs):
            state = changes.get(seq, state)
            seen = [z for s, z in zip(seqs, zeros) if s <= seq]
            points = [(i, i, 0.0 if z else 9.0, 0) for i, z in enumerate(seen)]
            head = next((i for i, z in enumerate(seen) if not z), len(seen))
            tail = next((i for i, z in enumerate(reversed(seen)) if not z), len(seen))
            assert kinds.parts(state) == (min(3, head), min(3, tail), all(seen), zero_run(points, 0, spec))


# ------------------------------------------------------------ golden cases

MINUTE = 60_000
CBW = Policy("proposed", lateness_ms=10 * MINUTE)
ALW = Policy("baseline", lateness_ms=10 * MINUTE)
SPEC = WindowSpec()


def run(spark, policy, points, spec=SPEC, group="SINGLE"):
    """Emissions over ``(event minute, value[, meter[, series]])`` in arrival order."""
    rows = []
    for seq, point in enumerate(points):
        minute, value, meter, series = (*point, *("a", "Spänning L1")[len(point) - 2 :])
        rows.append((seq, seq, meter, series, int(minute * MINUTE), value, 0, group))
    df = spark.createDataFrame(rows, SCHEMA)
    emitted = finalize(df, policy, spec).orderBy("meter_id", "window_start_ms", "emit_no")
    return df, emitted


def test_complete_window_fires_twice_and_swallows(spark):
    points = [(15 * i, 1.0) for i in range(8)] + [(7, 1.0)]
    df, emitted = run(spark, CBW, points)
    rows = emitted.collect()
    assert [(r.result_type, r["count"], r.fire_seq) for r in rows] == [
        ("PRELIMINARY", 6, 5), ("FINAL", 8, 7),
    ]
    assert rows[1].finalization_reason == "COMPLETENESS"
    assert rows[1].distinct_slot_count == 8 and rows[1].completeness == "100.0%"
    # nothing had passed the window end: no latency
    assert rows[1].finalization_latency_ms == 0
    assert rows[1].latency_reduction_ms == CBW.lateness_ms


def test_copies_complete_a_window_without_all_slots(spark):
    points = [(15 * i, 1.0) for i in range(7)] + [(90, 1.0)]
    _, emitted = run(spark, CBW, points)
    final = emitted.filter("result_type = 'FINAL'").first()
    assert final.finalization_reason == "COMPLETENESS" and final.distinct_slot_count == 7


def test_deadline_met_to_the_millisecond_is_not_early(spark):
    points = [(15 * i, 1.0) for i in range(5)] + [(130, 1.0, "b")]
    _, emitted = run(spark, CBW, points)
    final = emitted.filter("meter_id = 'a'").first()
    assert (final.finalization_reason, final.finalization_latency_ms) == (
        "DEADLINE", CBW.lateness_ms - 1,
    )
    counts = output_counts(emitted).filter("meter_id = 'a'").first()
    assert counts.early_purged_raw is True and counts.early_purged is False


def test_first_complete_window_has_no_watermark(spark):
    spec = dataclasses.replace(SPEC, expected=1)
    _, emitted = run(spark, CBW, [(0, 1.0)], spec)
    row = emitted.first()
    assert row.watermark_at_purge_ms is None and row.finalization_latency_ms == 0


def test_lateness_bound_is_exact(spark):
    for top, dropped in ((130 - 1 / MINUTE, 0), (130, 1)):
        df, _ = run(spark, ALW, [(0, 1.0), (top, 1.0, "b"), (1, 1.0)])
        assert late_records(place(df, ALW, SPEC)).count() == dropped


def test_late_updates(spark):
    late_only = [(121, 1.0, "b"), (1, 1.0), (2, 1.0), (3, 1.0)]
    _, emitted = run(spark, ALW, late_only)
    assert [r["count"] for r in emitted.filter("meter_id = 'a'").collect()] == [1, 2, 3]
    mixed = [(1, 1.0), (2, 1.0), (121, 1.0, "b"), (3, 1.0), (4, 1.0), (5, 1.0)]
    _, emitted = run(spark, ALW, mixed)
    rows = emitted.filter("meter_id = 'a'").collect()
    assert [(r["count"], r.fire_phase) for r in rows] == [(2, 1), (3, 0), (4, 0), (5, 0)]


@pytest.mark.parametrize(
    "values, faulty",
    [
        ([(15, 0.0), (30, 0.0), (60, 0.0)], True),  # a missing slot breaks no run
        ([(0, 0.0), (15, 0.0), (30, 5.0), (45, 0.0)], False),
        ([(0, 0.001), (15, -0.001), (30, 0.0)], True),
        ([(0, 0.0011), (15, 0.0), (30, 0.0)], False),
        ([(30, 0.0), (0, 0.0), (45, 9.0), (15, 0.0)], True),  # event order counts
    ],
)
def test_zero_runs(spark, values, faulty):
    _, emitted = run(spark, Policy("fast"), values)
    assert emitted.first().fault_indicator is faulty


def test_three_phase_fault_needs_every_phase(spark):
    zeros = [(15 * i, 0.0, "a", s) for s in ("Spänning L1", "Spänning L2") for i in range(3)]
    _, emitted = run(spark, Policy("fast"), zeros, group="THREE")
    assert emitted.first().fault_indicator is False
    zeros += [(15 * i, 0.0, "a", "Spänning L3") for i in range(3)]
    row = run(spark, Policy("fast"), zeros, group="THREE")[1].first()
    assert row.fault_indicator is True
    assert row.voltage_data == (
        "Spänning L1=[0.000;0.000;0.000]|Spänning L2=[0.000;0.000;0.000]"
        "|Spänning L3=[0.000;0.000;0.000]"
    )


def test_windows_before_1970(spark):
    _, emitted = run(spark, Policy("fast"), [(-1, 1.0)])
    row = emitted.first()
    assert (row.window_start_ms, row.window_end_ms) == (-7_200_000, 0)


def test_epoch_watermark_ignores_the_own_epoch(spark):
    rows = [
        (0, 0, "a", "Spänning L1", 0, 1.0, 0, "SINGLE"),
        (1, 0, "b", "Spänning L1", 500 * MINUTE, 1.0, 0, "SINGLE"),
        (2, 0, "a", "Spänning L1", MINUTE, 1.0, 0, "SINGLE"),
        (3, 1, "a", "Spänning L1", 2 * MINUTE, 1.0, 0, "SINGLE"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    late = late_records(place(df, ALW, SPEC, per="epoch"))
    assert [r.arrival_seq for r in late.collect()] == [3]


def test_rows_are_not_scanned_in_one_task(spark, folder):
    from finality.operators.arrival import replay_watermark
    from finality.plans.standins import readings

    plan = replay_watermark(readings(spark, folder), SPEC)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    # only the table of block groups is brought together
    assert physical.count("SinglePartition") <= 1
    assert "NestedLoop" not in physical and "CartesianProduct" not in physical
