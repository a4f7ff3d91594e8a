"""The four window policies on stored readings.

Input readings need ``arrival_seq`` (unique), ``event_ms``, ``meter_id``,
``series_id`` and ``value``; ``arrival_epoch`` too when the watermark moves per
epoch. The result is one row per emission.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from finality.config import THREE, Policy, WindowSpec
from finality.functions import points as content_of
from finality.functions.windowing import (
    by_phase,
    completeness_text,
    finalization_latency,
    latency_reduction,
    phase_index,
    series_label,
    window_start,
)
from finality.operators.arrival import (
    NO_MORE_INPUT,
    replay_watermark,
    watermark_passes,
)
from finality.operators.zero_runs import GROUP, closing_flags, flag_changes

EMITTED = [*GROUP, "window_end_ms", "emit_no", "k", "closes", "by_seq"]
Content = dict[str, Callable[[Column, Column], Column]]


def place(
    readings: DataFrame,
    policy: Policy,
    spec: WindowSpec,
    route: Callable[[DataFrame], DataFrame] | None = None,
    per: str = "record",
    keep: Column | None = None,
) -> DataFrame:
    """Readings with their window and what the policy does with them.

    ``keep`` drops rows cheaply once they have moved the watermark, ``route``
    then assigns ``phase_group`` (not needed when the column is there already).
    ``late`` marks arrivals after the window closed, ``dropped`` those the
    policy no longer takes.
    """
    seen = replay_watermark(readings, spec, per, keep)
    routed = seen if route is None else route(seen)
    start = window_start(F.col("event_ms"), spec)
    passed = F.col("max_seen_ms") - policy.delay_ms
    return routed.withColumns(
        {"window_start_ms": start, "window_end_ms": start + spec.size_ms}
    ).withColumns(
        {
            "late": F.coalesce(passed >= F.col("window_end_ms"), F.lit(False)),
            "dropped": F.coalesce(
                passed >= F.col("window_end_ms") + policy.lateness_ms, F.lit(False)
            ),
        }
    )


def late_records(placed: DataFrame) -> DataFrame:
    """Readings that arrived too late for their window."""
    return placed.filter("dropped")


def window_counts(placed: DataFrame) -> DataFrame:
    """Per window: on-time, late but taken, taken and dropped readings."""
    return placed.groupBy(*GROUP, "window_end_ms").agg(
        F.count_if(~F.col("late") & ~F.col("dropped")).alias("on_time"),
        F.count_if(F.col("late") & ~F.col("dropped")).alias("late_taken"),
        F.count_if(~F.col("dropped")).alias("taken"),
        F.count_if("dropped").alias("dropped"),
    )


def _point(with_seen: bool = False) -> Column:
    fields = [
        F.col("arrival_seq").alias("seq"),
        F.col("event_ms"),
        F.col("value"),
        phase_index(F.col("series_id")).alias("phase"),
    ]
    if with_seen:
        fields.append(F.col("max_seen_ms"))
    return F.struct(*fields)


def completeness_windows(placed: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per window: counts and the first ``expected`` taken points.

    Blocks of arrivals are cut down to a count and at most ``expected`` points
    per window before the shuffle by window, so a window that holds a large
    share of all rows reaches its task as one short row per block.
    """
    full = by_phase(F.col("phase_group"), spec.expected_for(THREE), spec.expected)
    pieces = (
        placed.groupBy("_blk", *GROUP)
        .agg(
            F.count_if(~F.col("dropped")).alias("n"),
            F.count_if("dropped").alias("n_dropped"),
            F.collect_list(F.when(~F.col("dropped"), _point(with_seen=True))).alias("points"),
        )
        .withColumn("points", F.slice(F.sort_array("points"), F.lit(1), full))
    )
    before = (
        Window.partitionBy(*GROUP).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.greatest(full - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0)).cast("int")
    cut = pieces.withColumn("points", F.slice("points", F.lit(1), room))
    return (
        cut.groupBy(*GROUP)
        .agg(
            F.sum("n").alias("taken"),
            F.sum("n_dropped").alias("dropped"),
            F.sort_array(
                F.collect_list(F.when(F.size("points") > 0, F.struct("_blk", "points")))
            ).alias("parts"),
        )
        .filter("taken > 0")
        .select(
            *GROUP,
            (F.col("window_start_ms") + spec.size_ms).alias("window_end_ms"),
            "taken",
            "dropped",
            F.greatest(F.col("taken") - full, F.lit(0)).alias("swallowed"),
            F.flatten(F.col("parts.points")).alias("points"),
        )
    )


def _completeness_emissions(
    placed: DataFrame, passes: DataFrame, policy: Policy, spec: WindowSpec, content: Content
) -> DataFrame:
    group = F.col("phase_group")
    full = by_phase(group, spec.expected_for(THREE), spec.expected)
    first = by_phase(group, spec.preliminary_for(THREE), spec.preliminary_for("SINGLE"))
    windows = completeness_windows(placed, spec)

    preliminary = F.struct(
        F.lit(1).alias("emit_no"), first.cast("int").alias("k"), F.lit("PRELIMINARY").alias("why")
    )
    has_preliminary = F.coalesce(F.col("taken") >= first, F.lit(False))
    final = F.struct(
        F.when(has_preliminary, 2).otherwise(1).alias("emit_no"),
        F.least(F.col("taken"), full).cast("int").alias("k"),
        F.when(F.col("taken") >= full, "COMPLETENESS").otherwise("DEADLINE").alias("why"),
    )
    steps = F.when(has_preliminary, F.array(preliminary, final)).otherwise(F.array(final))
    fired = (
        windows.join(passes, "window_end_ms", "left")
        .select("*", F.inline(steps))
        .withColumn("by", F.element_at("points", F.col("k")))
        .withColumn("points", F.slice("points", F.lit(1), F.col("k")))
    )
    deadline = F.col("why") == "DEADLINE"
    watermark = F.when(
        deadline,
        F.coalesce(F.col("pass_event_ms") - policy.delay_ms - 1, F.lit(NO_MORE_INPUT)),
    ).otherwise(F.col("by.max_seen_ms") - policy.delay_ms - 1)
    fire_seq = F.when(deadline, F.coalesce("pass_seq", F.lit(NO_MORE_INPUT))).otherwise(
        F.col("by.seq")
    )
    fired = fired.withColumns(
        {
            "watermark_ms": watermark,
            "fire_seq": fire_seq,
            "fire_phase": F.when(deadline, 1).otherwise(0),
        }
    )
    return content_of.with_content(fired, content).select(
        *completeness_columns(policy, spec, content)
    )


def completeness_columns(policy: Policy, spec: WindowSpec, content: Content) -> list[Column]:
    """Emission columns from ``why``, ``k``, ``watermark_ms`` and the content."""
    group = F.col("phase_group")
    full = by_phase(group, spec.expected_for(THREE), spec.expected)
    final = F.col("why") != "PRELIMINARY"
    latency = finalization_latency(
        F.col("watermark_ms"), F.col("window_end_ms"), policy.lateness_ms
    )
    return [
        F.lit(policy.label).alias("mode"),
        group,
        F.col("meter_id"),
        series_label(group).alias("series_id"),
        F.col("window_start_ms"),
        F.col("window_end_ms"),
        F.col("emit_no"),
        F.col("fire_seq"),
        F.col("fire_phase"),
        F.col("k").alias("count"),
        F.when(final, "FINAL").otherwise("PRELIMINARY").alias("result_type"),
        F.col("why").alias("finalization_reason"),
        completeness_text(F.col("k"), full).alias("completeness"),
        *[F.col(name) for name in content],
        F.when(final, F.col("watermark_ms")).alias("watermark_at_purge_ms"),
        F.when(final, F.lit(policy.lateness_ms).cast("bigint")).alias("allowed_lateness_ms"),
        F.when(final, latency).alias("finalization_latency_ms"),
        F.when(final, latency_reduction(latency, policy.lateness_ms)).alias(
            "latency_reduction_ms"
        ),
    ]


def native_columns(policy: Policy, content: Content) -> list[Column]:
    """Emission columns of the policies that do not look at completeness."""
    group = F.col("phase_group")
    empty = F.lit(None).cast("bigint")
    return [
        F.lit(policy.label).alias("mode"),
        group,
        F.col("meter_id"),
        series_label(group).alias("series_id"),
        F.col("window_start_ms"),
        F.col("window_end_ms"),
        F.col("emit_no").cast("int").alias("emit_no"),
        F.col("fire_seq"),
        F.col("fire_phase"),
        F.col("k").cast("int").alias("count"),
        F.lit("NATIVE").alias("result_type"),
        F.lit(None).cast("string").alias("finalization_reason"),
        F.lit("").alias("completeness"),
        *[F.col(name) for name in content],
        empty.alias("watermark_at_purge_ms"),
        empty.alias("allowed_lateness_ms"),
        empty.alias("finalization_latency_ms"),
        empty.alias("latency_reduction_ms"),
    ]


def _closings(taken: DataFrame, content: Content, spec: WindowSpec) -> DataFrame:
    """One emission per window: its count and, if asked for, its fault flag."""
    if "fault_indicator" in content:
        windows = closing_flags(taken, spec)
    else:
        windows = taken.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("k"))
    return windows.withColumns(
        {
            "window_end_ms": F.col("window_start_ms") + spec.size_ms,
            "emit_no": F.lit(1).cast("bigint"),
            "closes": F.lit(True),
            "by_seq": F.lit(None).cast("bigint"),
        }
    )


def _updates(taken: DataFrame, content: Content, spec: WindowSpec) -> DataFrame:
    """An emission when a window closes and one for each late reading.

    Counts and flags are running values over the arrivals of a window, which are scanned in
    blocks; the changes of a flag take part in the scan as rows of their own. A window closes
    on the count and flag of its last reading in time.
    """
    flagged = "fault_indicator" in content
    rows = taken.select(*GROUP, F.col("arrival_seq").alias("seq"), "late", F.lit(True).alias("is_point"))
    values = {
        "k": (F.sum, F.col("is_point").cast("bigint")),
        "lates": (F.sum, F.col("late").cast("bigint")),
        "in_time": (F.sum, (F.col("is_point") & ~F.col("late")).cast("bigint")),
    }
    if flagged:
        changes = flag_changes(taken, spec).withColumns({"late": F.lit(False), "is_point": F.lit(False)})
        rows = rows.withColumn("flag", F.lit(None).cast("boolean")).unionByName(changes)
        values["state"] = (F.max, F.when(F.col("flag").isNotNull(), F.struct("seq", "flag")))
    block = [*GROUP, "_blk"]
    dealt = rows.withColumn("_blk", F.shiftright("seq", spec.block_bits)).repartition(*block)
    totals = dealt.groupBy(*block).agg(*[make(value).alias(name) for name, (make, value) in values.items()])
    blocks = Window.partitionBy(*GROUP).orderBy("_blk")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.rowsBetween(1, Window.unboundedFollowing)
    prior = totals.select(
        *block,
        *[make(name).over(before).alias(f"_before_{name}") for name, (make, _) in values.items()],
        # the readings in time up to here, if none of them comes later
        F.when(F.coalesce(F.sum("in_time").over(after), F.lit(0)) == 0, F.col("in_time")).alias("_last_in_time"),
    )
    upto = Window.partitionBy(*block).orderBy("seq", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    scanned = dealt.withColumns({f"_here_{name}": make(value).over(upto) for name, (make, value) in values.items()})
    scanned = scanned.filter("is_point").join(prior, block)
    whole = {
        name: F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.col(f"_here_{name}") for name in ("k", "lates")
    }
    closes = ~F.col("late") & (F.col("_here_in_time") == F.col("_last_in_time"))
    flag = {}
    if flagged:
        state = F.greatest("_before_state", "_here_state")
        flag = {"fault_indicator": F.coalesce(state["flag"], F.lit(False))}
    return (
        scanned.withColumns(whole | flag | {"closes": closes, "by_seq": F.col("seq")})
        .filter("late OR closes")
        .withColumns(
            {
                "emit_no": F.when(F.col("closes") | (F.col("k") > F.col("lates")), F.col("lates") + 1).otherwise(F.col("lates")),
                "window_end_ms": F.col("window_start_ms") + spec.size_ms,
            }
        )
    )


def _native_emissions(taken: DataFrame, content: Content, spec: WindowSpec, updates: bool) -> DataFrame:
    """Emissions of the policies that do not look at completeness, with their content.

    Counts and fault flags never gather a window. Other content is a function of all points so far: they
    are gathered for the windows that need it, which for the voltage text are the faulty ones.
    """
    emitted = (_updates if updates else _closings)(taken, content, spec)
    others = {n: make for n, make in content.items() if n != "fault_indicator"}
    if not others:
        return emitted.select(*EMITTED, *content)
    gathered = taken
    if set(others) == {"voltage_data"} and "fault_indicator" in content:
        ever = flag_changes(taken, spec).filter("flag") if updates else emitted.filter("fault_indicator")
        gathered = taken.join(ever.select(*GROUP).distinct(), GROUP, "left_semi")
    points = gathered.groupBy(*GROUP).agg(F.sort_array(F.collect_list(_point())).alias("points"))
    asked = emitted.join(points, GROUP, "left").withColumn("points", F.slice("points", F.lit(1), F.col("k").cast("int")))
    return content_of.with_content(asked, others).select(*EMITTED, *content)


def finalize(
    readings: DataFrame,
    policy: Policy,
    spec: WindowSpec = WindowSpec(),
    content: Content | None = None,
    route: Callable[[DataFrame], DataFrame] | None = None,
    per: str = "record",
    keep: Column | None = None,
    counters: Observation | None = None,
) -> DataFrame:
    """Every emission a policy makes over the readings.

    ``content`` names what is computed from the points of a window; each entry
    takes the phase group and the array of points in arrival order. ``fire_seq``
    and ``fire_phase`` order emissions: by the arrival that fired them, and by
    the watermark it moved when the phase is 1. Content is whole for windows of
    every size. ``counters`` observes the number of routed and dropped readings
    on the way.
    """
    content = content_of.default_content(spec) if content is None else content
    placed = place(readings, policy, spec, route, per, keep)
    if counters is not None:
        placed = placed.observe(
            counters, F.count("*").alias("routed"), F.count_if("dropped").alias("dropped")
        )
    if policy.completes_early:
        passes = watermark_passes(readings, spec, policy.delay_ms + policy.lateness_ms, per)
        return _completeness_emissions(placed, passes, policy, spec, content)

    native = {name: make for name, make in content.items() if name != "distinct_slot_count"}
    taken = placed.filter("NOT dropped")
    # without allowed lateness all late readings are dropped, so a window is emitted once
    emitted = _native_emissions(taken, native, spec, updates=policy.lateness_ms > 0)
    passes = watermark_passes(readings, spec, policy.delay_ms, per)
    emitted = emitted.join(passes, "window_end_ms", "left").withColumns(
        {
            "fire_seq": F.when(
                F.col("closes"), F.coalesce("pass_seq", F.lit(NO_MORE_INPUT))
            ).otherwise(F.col("by_seq")),
            "fire_phase": F.when(F.col("closes"), 1).otherwise(0),
        }
    )
    if "distinct_slot_count" in content:
        emitted = emitted.withColumn("distinct_slot_count", F.lit(None).cast("int"))
    return emitted.select(*native_columns(policy, content))
