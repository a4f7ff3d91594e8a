"""The window policies as a stateful streaming operator.

State is kept per phase group, meter and window, so each key is small, has one
timer at a time, and is cleared as a whole. The processor decides when a window
fires; what an emission holds is computed afterwards by the same column
expressions as on stored data.

A micro-batch sees the largest event time of the batches before it, so a
stream equals the stored form with ``per="epoch"``.
"""

from __future__ import annotations

import datetime
from typing import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from finality.config import SINGLE, THREE, Policy, WindowSpec
from finality.functions import points as content_of
from finality.functions.windowing import early_purges, phase_index, series_label, window_start
from finality.operators.arrival import NO_MORE_INPUT
from finality.operators.replay import Content, completeness_columns, native_columns

# an event time past every reading; a record carrying it ends the input
FLUSH_MS = 253_402_300_799_000
LATE = "LATE"
_KEY = ["phase_group", "meter_id", "window_start_ms"]
_POINT = "seq bigint, event_ms bigint, value double, phase int"
_FIRED = (
    "phase_group string, meter_id string, window_start_ms bigint, window_end_ms bigint, "
    "emit_no int, k int, why string, watermark_ms bigint, "
    f"points array<struct<{_POINT.replace(' ', ':').replace(',:', ',')}>>, out_ts timestamp"
)


class WindowProcessor(StatefulProcessor):
    """Fires windows by one policy; late readings come out as ``LATE`` rows.

    Readings are appended to the state of their window and read only where an emission asks for them, so a
    micro-batch writes its own readings and one short status row per window.
    """

    def __init__(self, policy: Policy, spec: WindowSpec):
        self._policy = policy
        self._size_ms = spec.size_ms
        self._full = {g: spec.expected_for(g) for g in (SINGLE, THREE)}
        self._first = {g: spec.preliminary_for(g) for g in (SINGLE, THREE)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._points = handle.getListState("points", _POINT)
        # readings and emissions so far, and whether the window has closed or is final
        self._status = handle.getValueState("status", "count bigint, emitted int, done boolean")

    def close(self) -> None:
        pass

    def _stored(self) -> list:
        return [tuple(p) for p in self._points.get()] if self._points.exists() else []

    def _row(self, key, emit_no: int, why: str, watermark: int | None, points: list, passed: int | None) -> Row:
        group, meter, start = key
        end = start + self._size_ms
        # the time that later operators go by: when the window is over, or now
        out = max(end + self._policy.lateness_ms, passed or 0)
        return Row(
            phase_group=group,
            meter_id=meter,
            window_start_ms=start,
            window_end_ms=end,
            emit_no=emit_no,
            k=len(points),
            why=why,
            watermark_ms=watermark,
            points=list(points),
            out_ts=datetime.datetime.fromtimestamp(out / 1000, datetime.timezone.utc),
        )

    @staticmethod
    def _watermark(timers) -> int | None:
        """Largest event time seen less the delay; none before the first batch."""
        return timers.getCurrentWatermarkInMs() or None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        end = key[2] + self._size_ms
        passed = self._watermark(timerValues)
        known = passed is not None
        arrivals = sorted((r.arrival_seq, r.event_ms, r.value, r.phase) for r in rows)
        if known and passed >= end + self._policy.lateness_ms:
            for point in arrivals:
                yield self._row(key, 0, LATE, None, [point], passed)
            return
        fresh = not self._status.exists()
        count, emitted, done = (0, 0, False) if fresh else self._status.get()
        window = _Window(self._stored, count, emitted, done)
        step = self._complete if self._policy.completes_early else self._native
        yield from step(key, arrivals, window, passed, known and passed >= end)
        if window.finished:
            self._points.clear()
        elif window.fresh:
            self._points.appendList(window.fresh)
        self._status.update((window.count, window.emitted, window.done))
        if fresh:
            late = self._policy.completes_early or (known and passed >= end)
            self._handle.registerTimer(end + (self._policy.lateness_ms if late else 0))

    def _complete(self, key, arrivals, window, passed, _late) -> Iterator[Row]:
        full, first = self._full[key[0]], self._first[key[0]]
        watermark = None if passed is None else passed - 1
        for point in arrivals:
            if window.done:
                return
            window.add(point)
            if window.count == full or window.count == first:
                window.emitted += 1
                why = "COMPLETENESS" if window.count == full else "PRELIMINARY"
                yield self._row(key, window.emitted, why, watermark, window.points(), passed)
            if window.count == full:
                window.done = window.finished = True

    def _native(self, key, arrivals, window, passed, late) -> Iterator[Row]:
        # rows come before expired timers, so a due close is fired here first
        if late and not window.done:
            if window.count:
                window.emitted += 1
                yield self._row(key, window.emitted, "CLOSE", None, window.points(), passed)
            window.done = True
        for point in arrivals:
            window.add(point)
            if late:
                window.emitted += 1
                yield self._row(key, window.emitted, "UPDATE", None, window.points(), passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = key[2] + self._size_ms
        count, emitted, done = self._status.get() if self._status.exists() else (0, 0, False)
        passed = self._watermark(timerValues)
        if self._policy.completes_early:
            if not done and count:
                watermark = NO_MORE_INPUT if passed >= FLUSH_MS - self._policy.delay_ms else passed - 1
                yield self._row(key, emitted + 1, "DEADLINE", watermark, self._stored(), passed)
        elif not done and count:
            yield self._row(key, emitted + 1, "CLOSE", None, self._stored(), passed)
            if passed < end + self._policy.lateness_ms:
                self._status.update((count, emitted + 1, True))
                self._handle.registerTimer(end + self._policy.lateness_ms)
                return
        elif passed < end + self._policy.lateness_ms:
            self._handle.registerTimer(end + self._policy.lateness_ms)
            return
        self._points.clear()
        self._status.clear()


class _Window:
    """What a micro-batch knows and adds of one window; stored points are read once, when first asked for."""

    def __init__(self, read: Callable[[], list], count: int, emitted: int, done: bool):
        self._read, self._old = read, None
        self.count, self.emitted, self.done, self.finished = count, emitted, done, False
        self.fresh: list = []

    def add(self, point: tuple) -> None:
        self.fresh.append(point)
        self.count += 1

    def points(self) -> list:
        if self._old is None:
            self._old = self._read()
        return self._old + self.fresh


def fired_windows(readings: DataFrame, policy: Policy, spec: WindowSpec) -> DataFrame:
    """Raw firings and late readings of a stream of routed readings.

    Needs ``phase_group, meter_id, series_id, event_ms, value, arrival_seq``.
    Readings without a phase group move the watermark and go no further. A reading at
    ``FLUSH_MS`` without a meter ends the input. ``out_ts`` is the event time of a firing for
    operators behind this one: the end of the window's lateness, or the watermark beyond it.
    """
    rows = readings.select(
        "phase_group",
        "meter_id",
        window_start(F.col("event_ms"), spec).alias("window_start_ms"),
        F.timestamp_millis("event_ms").alias("event_ts"),
        "event_ms",
        "value",
        phase_index(F.col("series_id")).alias("phase"),
        "arrival_seq",
    ).withWatermark("event_ts", f"{policy.delay_ms} milliseconds")
    # a condition on the event time stays behind the watermark, which all readings move
    routed = F.when(F.col("event_ts").isNotNull(), F.col("phase_group").isNotNull() & F.col("meter_id").isNotNull())
    return rows.filter(routed).groupBy(*_KEY).transformWithState(
        statefulProcessor=WindowProcessor(policy, spec),
        outputStructType=_FIRED,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="out_ts",
    )


def emissions_of(
    fired: DataFrame,
    policy: Policy,
    spec: WindowSpec,
    content: Content | None = None,
    kept: tuple[str, ...] = (),
) -> DataFrame:
    """Emissions out of the firings, with the columns of the stored form and those of ``kept``.

    A stream does not know which arrival moved the watermark, so ``fire_seq``
    is null where the watermark fired.
    """
    content = content_of.default_content(spec) if content is None else content
    by_watermark = F.col("why").isin("CLOSE", "DEADLINE")
    rows = fired.filter(F.col("why") != LATE).withColumns(
        {
            "fire_phase": F.when(by_watermark, 1).otherwise(0),
            "fire_seq": F.when(~by_watermark, F.element_at("points", -1)["seq"]),
        }
    )
    if policy.completes_early:
        made = content_of.with_content(rows, content)
        return made.select(*completeness_columns(policy, spec, content), *kept)
    native = {name: make for name, make in content.items() if name != "distinct_slot_count"}
    made = content_of.with_content(rows, native)
    if "distinct_slot_count" in content:
        made = made.withColumn("distinct_slot_count", F.lit(None).cast("int"))
    return made.select(*native_columns(policy, content), *kept)


_COUNTED = (
    "phase_group string, meter_id string, window_start_ms bigint, output_count int, early_purged_raw boolean, "
    "early_purged boolean, final_count int, distinct_slot_count int"
)


class CountProcessor(StatefulProcessor):
    """Counts the emissions of a window and gives one row when its allowed lateness has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState(
            "seen", "outputs int, raw boolean, early boolean, last int, count int, slots int"
        )

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = not self._seen.exists()
        outputs, raw, early, last, count, slots = (0, False, False, 0, None, None) if fresh else self._seen.get()
        due = None
        for r in rows:
            outputs, raw, early, due = outputs + 1, raw or r.early_purged_raw, early or r.early_purged, r.due_ms
            if r.emit_no >= last:
                last, count, slots = r.emit_no, r["count"], r.distinct_slot_count
        self._seen.update((outputs, raw, early, last, count, slots))
        if fresh:
            self._handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        outputs, raw, early, _, count, slots = self._seen.get()
        self._seen.clear()
        yield Row(
            phase_group=key[0], meter_id=key[1], window_start_ms=key[2], output_count=outputs,
            early_purged_raw=raw, early_purged=early, final_count=count, distinct_slot_count=slots,
        )


def counted_outputs(fired: DataFrame, policy: Policy, spec: WindowSpec) -> DataFrame:
    """``output_counts`` of a stream of firings: one row per window, written once, after its allowed lateness.

    A second stateful operator behind the one that fires windows.
    """
    content = {name: make for name, make in content_of.default_content(spec).items() if name == "distinct_slot_count"}
    rows = emissions_of(fired, policy, spec, content, kept=("out_ts",)).select(
        *_KEY,
        "emit_no",
        "count",
        "distinct_slot_count",
        "out_ts",
        (F.col("window_end_ms") + policy.lateness_ms).alias("due_ms"),
        *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in early_purges().items()],
    )
    counted = rows.groupBy(*_KEY).transformWithState(
        statefulProcessor=CountProcessor(), outputStructType=_COUNTED, outputMode="Append", timeMode="EventTime"
    )
    return counted.select(
        F.lit(policy.label).alias("mode"),
        "meter_id",
        series_label(F.col("phase_group")).alias("series_id"),
        "window_start_ms",
        (F.col("window_start_ms") + spec.size_ms).alias("window_end_ms"),
        *[part.split()[0] for part in _COUNTED.split(", ")[3:]],
    )


def late_of(fired: DataFrame) -> DataFrame:
    """Readings the stream dropped as too late."""
    return fired.filter(F.col("why") == LATE).select(
        "phase_group", "meter_id", "window_start_ms", F.inline("points")
    )


def closed_windows(readings: DataFrame, spec: WindowSpec) -> DataFrame:
    """Strict windows with the built-in window aggregate: count and sum."""
    return (
        readings.filter("phase_group IS NOT NULL")
        .withColumn("event_ts", F.timestamp_millis("event_ms"))
        .withWatermark("event_ts", "0 seconds")
        .groupBy(F.window("event_ts", f"{spec.size_ms} milliseconds"), "phase_group", "meter_id")
        .agg(F.count("*").alias("count"), F.sum("value").alias("sum_value"))
        .select(
            "phase_group",
            "meter_id",
            F.unix_millis("window.start").alias("window_start_ms"),
            "count",
            "sum_value",
        )
    )


def session_settings() -> dict[str, str]:
    """Settings the stateful operator needs."""
    return {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.python.unix.domain.socket.enabled": "true",
    }
